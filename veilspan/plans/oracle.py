"""DuckDB SQL that the span queries must equal, made from the same recognizers by another construction."""

from __future__ import annotations

from veilspan.functions import recognizers as R


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT WHEN substr(d, i, 1)::INT > 4 THEN substr(d, i, 1)::INT * 2 - 9 ELSE substr(d, i, 1)::INT * 2 END)) % 10 = 0"
_IBAN = "regexp_replace(upper(value), '[^A-Z0-9]', '', 'g')"
_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x::BIGINT ELSE ascii(x)::BIGINT - 55 END)), lambda a, x: CASE WHEN x >= 10 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
VALID = {
    "card": f"(SELECT length(d) BETWEEN 13 AND 19 AND replace(d, substr(d, 1, 1), '') <> '' AND {_LUHN} FROM (SELECT {_DIGITS} AS d))",
    "phone": f"length({_DIGITS}) BETWEEN 7 AND 15",
    "ssn": f"(SELECT length(d) = 9 AND replace(d, substr(d, 1, 1), '') <> '' AND substr(d, 1, 3) NOT IN ('000', '666') AND substr(d, 1, 1) <> '9' AND substr(d, 4, 2) <> '00' AND substr(d, 6) <> '0000' FROM (SELECT {_DIGITS} AS d))",
    "iban": f"(SELECT length(c) BETWEEN 15 AND 34 AND regexp_matches(c, '^[A-Z]{{2}}[0-9]{{2}}') AND {_MOD} FROM (SELECT {_IBAN} AS c))",
    "person": "(SELECT len(w) BETWEEN 1 AND 4 AND length(value) <= 80 AND len(list_filter(w, lambda x: length(trim(x, '.''-')) < 2 OR NOT regexp_matches(trim(x, '.''-'), '^\\p{Lu}'))) = 0 FROM (SELECT list_filter(regexp_split_to_array(value, '\\s+'), lambda x: x <> '') AS w))",
}


def found(source: str, recognizer: R.Recognizer, order: int = 0) -> str:
    """A select of (id, text, ord, entity, priority, span_start, span_end, value) over a select of (id, text)."""
    p = quoted(recognizer.pattern)
    where = f"WHERE {VALID[recognizer.valid]}" if recognizer.valid else ""
    return f"""SELECT id, text, {order} AS ord, '{recognizer.entity}' AS entity, {recognizer.priority} AS priority, span_start, span_start + length(value) AS span_end, value FROM (
  SELECT id, text, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + length(b[i]))::BIGINT AS span_start, v[i] AS value FROM (
    SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT id, text, regexp_split_to_array(text, {p}) AS g, regexp_extract_all(text, {p}, 0) AS w, regexp_extract_all(text, {p}, 1) AS b, regexp_extract_all(text, {p}, 2) AS v
      FROM ({source}) WHERE regexp_matches(text, {p})))) {where}"""


def near(window: tuple[int, int]) -> str:
    return f"lower(substr(text, greatest(span_start - {window[0]}, 0) + 1, span_end + {window[1]} - greatest(span_start - {window[0]}, 0)))"


def _contains(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def candidates(source: str, profile: str = "broad", entities=(), exclude=(), only=()) -> str:
    parts = [found(source, r, k) for k, r in enumerate(R.RECOGNIZERS) if (not entities or r.entity in entities) and r.entity not in exclude and (profile == "broad" or r.transcript) and (not only or r.name in only)]
    union = "\nUNION ALL\n".join(parts)
    if profile == "broad":
        return union
    card = f"(entity <> 'CREDIT_CARD' OR {_contains(near(R.CARD_WINDOW), R.CARD_TERMS)})"
    value, around = "lower(trim(value))", near(R.SECRET_WINDOW)
    keyword = _contains("lower(trim(trim(value), ' \"''`'))", ("secret", "token"))
    benign = f"(trim(value) = '' OR {_contains(value, R.BENIGN_SECRETS)} OR {_contains(around, R.BENIGN_SECRETS)} OR {value} IN ('secret', 'token') OR ({keyword} AND {_contains(around, R.KEYWORD_PLACES)}))"
    return f"SELECT * FROM ({union}) WHERE {card} AND NOT (entity = 'SECRET' AND {benign}) AND entity <> 'MODEL_PRIVATE'"


def chosen(source: str, **options) -> str:
    """(id, text, span_start, span_end, entity, value): candidates accepted one by one."""
    return f"""SELECT id, text, s.span_start, s.span_end, s.entity, s.value FROM (
  SELECT id, text, unnest(list_reduce(list_prepend([]::STRUCT(span_start BIGINT, span_end BIGINT, entity VARCHAR, value VARCHAR)[], cs), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.span_start < x[1].span_end AND x[1].span_start < y.span_end)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS s FROM (
    SELECT id, any_value(text) AS text, list([{{'span_start': span_start, 'span_end': span_end, 'entity': entity, 'value': value}}] ORDER BY priority DESC, span_end - span_start DESC, span_start, ord) AS cs
    FROM ({candidates(source, **options)}) GROUP BY id))"""


def named(source: str, scope: str = "id", first: str = "span_start", **options) -> str:
    """chosen() with surrogate: [TYPE_n] within a scope, by first use."""
    return f"""SELECT c.*, '[' || c.entity || '_' || n.n || ']' AS surrogate FROM ({chosen(source, **options)}) c JOIN (
  SELECT id, entity, value, row_number() OVER (PARTITION BY id, entity ORDER BY first, value) AS n FROM (
    SELECT id, entity, value, min(span_start) AS first FROM ({chosen(source, **options)}) GROUP BY ALL)) n USING (id, entity, value)"""


def rewritten(source: str, **options) -> str:
    """(id, text, redacted) of all texts."""
    return f"""SELECT s.id, s.text, coalesce(r.redacted, s.text) AS redacted FROM ({source}) s LEFT JOIN (
  SELECT id, string_agg(substr(text, before + 1, span_start - before) || surrogate, '' ORDER BY span_start) || substr(any_value(text), max(span_end) + 1) AS redacted FROM (
    SELECT *, coalesce(lag(span_end) OVER (PARTITION BY id ORDER BY span_start), 0) AS before FROM ({named(source, **options)})) GROUP BY id) r USING (id)"""
