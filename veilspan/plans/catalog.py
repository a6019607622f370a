"""The registered queries of the span engine and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import recognizers as R
from veilspan.functions import validators
from veilspan.operators import detectors, payload, reports, requests, surrogates, tokens
from veilspan.operators import spans as S
from veilspan.plans import carriers, oracle
from veilspan.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    _queries[name] = run
    if sql:
        _sql[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# spans of single recognizers, each over a text that exercises it


def _spans(carrier: str, *only: str) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.findings(S.with_spans(carriers.frame(spark, sf_dir, carrier), only=only), ["id"])

    return query, f"SELECT id, entity, span_start, span_end, value FROM ({oracle.chosen(carriers.source(carrier), only=only)})"


for _name, _carrier, _only in (
    ("spans_email", "documents", ["email"]), ("spans_ipv4", "documents", ["ipv4"]), ("spans_phone", "documents", ["phone"]), ("spans_card_luhn", "documents", ["card"]),
    ("spans_secret_context", "documents", ["secret_context"]), ("spans_card_pages", "pages", ["card"]), ("spans_phone_pages", "pages", ["phone"]),
    ("spans_ssn", "ssn", ["ssn"]), ("spans_dob", "dob", ["dob_context"]), ("spans_id", "account", ["id_context"]), ("spans_phone_context", "call", ["phone_context"]),
    ("spans_provider_keys", "key", ["key_sk", "key_sk_ant"]), ("spans_cloud_git_chat_maps", "keys", ["cloud_key", "git_token", "chat_token", "maps_key"]),
    ("spans_jwt", "jwt", ["jwt"]), ("spans_pem", "pem", ["private_key"]), ("spans_bearer", "bearer", ["bearer", "secret_context"]), ("spans_ipv6", "ipv6", ["ipv6"]),
    ("spans_person", "person", ["person"]), ("spans_address", "address", ["address"]), ("spans_project", "project", ["project_context"]),
    ("spans_iban", "iban", ["iban"]), ("spans_url_query", "urls", ["url_query"]),
):
    _add(_name, *_spans(_carrier, *_only))


# candidates, filters and selection


def _candidates(profile: str, carrier: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = carriers.frame(spark, sf_dir, carrier).select("id", F.explode_outer(S.candidates(F.col("text"), profile)).alias("c")).where("c IS NOT NULL")
        return rows.select("id", F.col("c.entity").alias("entity"), F.col("c.priority").alias("priority"), F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"), F.col("c.value").alias("value"))

    return query


for _profile in R.PROFILES:
    for _carrier in ("documents", "card", "secrets"):
        _add(f"candidates_{_profile}_{_carrier}", _candidates(_profile, _carrier), f"SELECT id, entity, priority, span_start, span_end, value FROM ({oracle.candidates(carriers.source(_carrier), _profile)})")


def _chosen(carrier: str, **options) -> tuple[Query, str]:
    return lambda spark, sf_dir: S.findings(S.with_spans(carriers.frame(spark, sf_dir, carrier), **options), ["id"]), f"SELECT id, entity, span_start, span_end, value FROM ({oracle.chosen(carriers.source(carrier), **options)})"


_add("select_nonoverlap", *_chosen("nested"))
_add("entity_filter", *_chosen("nested", entities=("EMAIL", "IP_ADDRESS")))
_add("entity_exclude", *_chosen("documents", exclude=("EMAIL", "PHONE")))


def _redacted(carrier: str, **options) -> tuple[Query, str]:
    return lambda spark, sf_dir: S.redact(carriers.frame(spark, sf_dir, carrier), **options).select("id", "redacted"), f"SELECT id, redacted FROM ({oracle.rewritten(carriers.source(carrier), **options)})"


_add("redact_documents", *_redacted("documents"))
_add("redact_pages", *_redacted("pages"))
_add("redact_nested", *_redacted("nested"))
_add("redact_transcript", *_redacted("secrets", profile="transcript"))
_add("surrogate_per_doc", lambda spark, d: S.with_spans(carriers.frame(spark, d, "nested")).select("id", F.explode_outer(F.arrays_zip(S.numbered(F.col("spans")).alias("n"), F.col("spans").alias("s"))).alias("x")).where("x IS NOT NULL").select("id", F.col("x.s.start").alias("span_start"), F.col("x.n").alias("surrogate")), f"SELECT id, span_start, surrogate FROM ({oracle.named(carriers.source('nested'))})")


# validators


def _validated(carrier: str, recognizer: str) -> tuple[Query, str]:
    bare = R.Recognizer("bare", R.BY_NAME[recognizer].entity, 1, R.BY_NAME[recognizer].value, flags=R.BY_NAME[recognizer].flags)
    kind = R.BY_NAME[recognizer].valid

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = carriers.frame(spark, sf_dir, carrier).select("id", F.explode_outer(S.matches(F.col("text"), bare, 0)).alias("c")).where("c IS NOT NULL")
        return rows.select("id", F.col("c.value").alias("value"), validators.VALID[kind](F.col("c.value")).alias("valid"))

    return query, f"SELECT id, value, {oracle.VALID[kind]} AS valid FROM ({oracle.found(carriers.source(carrier), bare)})"


_add("validate_luhn", *_validated("card", "card"))
_add("validate_iban_mod97", *_validated("iban", "iban"))
_add("validate_ssn", *_validated("ssn", "ssn"))
_add("validate_person", *_validated("person", "person"))


# summaries, gates and reports


def _by(lang: bool) -> tuple[Query, str]:
    keys = ["lang", "entity"] if lang else ["entity"]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = S.with_spans(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text"))
        return S.findings(rows, ["id", "lang"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"))

    return query, f"SELECT {', '.join(keys)}, count(*) AS findings FROM ({oracle.chosen(carriers.source('documents'))}) JOIN documents ON doc_id = id GROUP BY {', '.join(keys)}"


_add("summary_by_type", *_by(False))
_add("summary_by_lang", *_by(True))
_COUNTS = f"SELECT id, entity, count(*) AS n FROM ({oracle.chosen(carriers.source('nested'))}) GROUP BY id, entity"


def _nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_spans(carriers.frame(spark, sf_dir, "nested")).select("id", S.summary(F.col("spans")).alias("counts"))


_add("deny_report", lambda spark, d: _nested_counts(spark, d).select("id", F.array_join(reports.denied(F.col("counts"), ["url", "ip_address"]), ",").alias("denied"), (F.size(reports.denied(F.col("counts"), ["url", "ip_address"])) > 0).alias("is_denied")), f"SELECT id, coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (entity IN ('URL', 'IP_ADDRESS')), '') AS denied, count(*) FILTER (entity IN ('URL', 'IP_ADDRESS')) > 0 AS is_denied FROM ({_COUNTS}) GROUP BY id")
_add("compact_summary", lambda spark, d: _nested_counts(spark, d).select("id", reports.compact(F.col("counts")).alias("by_name"), reports.compact(F.col("counts"), "=").alias("header"), reports.compact(F.col("counts"), fixed_order=True).alias("by_type"), reports.total(F.col("counts")).cast("long").alias("total")), f"SELECT id, string_agg(entity || ':' || n, ',' ORDER BY entity) AS by_name, string_agg(entity || '=' || n, ',' ORDER BY entity) AS header, string_agg(entity || ':' || n, ',' ORDER BY list_position({list(R.ENTITY_TYPES)}, entity)) AS by_type, sum(n)::BIGINT AS total FROM ({_COUNTS}) GROUP BY id")


def _check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.report(carriers.frame(spark, sf_dir, "documents"), "id")
    return rows.agg(F.count_if("changed").alias("changed"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")).crossJoin(reports.check(rows))


_add("check_report", _check, f"SELECT count(*) FILTER (changed) AS changed, sum(strlen(text))::BIGINT AS bytes_in, sum(strlen(redacted))::BIGINT AS bytes_out, bool_or(changed) AS dirty, CASE WHEN bool_or(changed) THEN 2 ELSE 0 END AS exit_code FROM (SELECT text, redacted, text <> redacted AS changed FROM ({oracle.rewritten(carriers.source('documents'))}))")
_add("until_clean", lambda spark, d: reports.until_clean(carriers.frame(spark, d, "documents"), "id", entities=("EMAIL", "IP_ADDRESS", "CREDIT_CARD")).select("id", "text", reports.compact(F.col("findings")).alias("findings"), "passes", "verified_clean"))
_add("latency_stats", lambda spark, d: reports.timings(_table(spark, d, "events"), "value", "event_type"), "SELECT event_type, count(value) AS runs, round(avg(value), 2) AS mean, round(min(value), 2) AS min, round(max(value), 2) AS max, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95 FROM events GROUP BY event_type")
_add("throughput", lambda spark, d: reports.throughput(_table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("ms")), "tokens", "ms", "l_returnflag"), "SELECT l_returnflag, round_even(avg(l_quantity / (l_extendedprice / 1000)), 2) AS tokens_per_second FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag")
_add("label_runs", lambda spark, d: reports.runs(_table(spark, d, "events"), "event_type", ["ts", "event_id"], "user_id"), "SELECT user_id, run::BIGINT AS run, event_type AS label, count(*) AS length FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run, event_type")


# scoped surrogates, vault and restoring


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "concat('org', conv_id % 3) as org_id", "'w' as workspace_id", "concat('c', conv_id) as conversation_id", f"{carriers.CARRIERS['talk'][2]} as text")
    return S.with_spans(rows, only=["email"])


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _talk(spark, sf_dir).select(*surrogates.SCOPE, "turn", F.posexplode_outer("spans").alias("pos", "s")).where("s IS NOT NULL").select(*surrogates.SCOPE, "turn", "pos", F.col("s.entity").alias("entity"), F.col("s.value").alias("value"))
    return surrogates.assign(found, surrogates.SCOPE, ["turn", "pos"])


_TALK = f"SELECT conv_id, turn, 'org' || conv_id % 3 AS org_id, 'w' AS workspace_id, 'c' || conv_id AS conversation_id, CAST({carriers.CARRIERS['talk'][1]} AS BIGINT) AS id, {carriers.CARRIERS['talk'][2]} AS text FROM conversations"
_TALK_SPANS = oracle.chosen(f"SELECT id, text FROM ({_TALK})", only=["email"])
_TALK_MAP = f"SELECT org_id, workspace_id, conversation_id, entity, value, row_number() OVER (PARTITION BY org_id, workspace_id, conversation_id, entity ORDER BY first, value) AS n FROM (SELECT org_id, workspace_id, conversation_id, entity, value, min(turn * 1000000 + span_start) AS first FROM ({_TALK_SPANS}) JOIN (SELECT * EXCLUDE (text) FROM ({_TALK})) USING (id) GROUP BY ALL)"
_add("surrogate_per_conversation", _mapping, f"SELECT *, '[' || entity || '_' || n || ']' AS surrogate FROM ({_TALK_MAP})")
_add("redact_conversations", lambda spark, d: surrogates.rewrite_scoped(_talk(spark, d), ["conv_id", "turn"], surrogates.SCOPE, order=["turn"]).select("conv_id", "turn", "redacted"), f"""SELECT t.conv_id, t.turn, coalesce(r.redacted, t.text) AS redacted FROM ({_TALK}) t LEFT JOIN (
  SELECT id, string_agg(substr(text, before + 1, span_start - before) || surrogate, '' ORDER BY span_start) || substr(any_value(text), max(span_end) + 1) AS redacted FROM (
    SELECT s.id, s.text, s.span_start, s.span_end, '[' || s.entity || '_' || m.n || ']' AS surrogate, coalesce(lag(s.span_end) OVER (PARTITION BY s.id ORDER BY s.span_start), 0) AS before
    FROM ({_TALK_SPANS}) s JOIN (SELECT * EXCLUDE (text) FROM ({_TALK})) t USING (id) JOIN ({_TALK_MAP}) m USING (org_id, workspace_id, conversation_id, entity, value)) GROUP BY id) r USING (id)""")


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = surrogates.rewrite_scoped(_talk(spark, sf_dir), ["conv_id", "turn"], surrogates.SCOPE, order=["turn"])
    return surrogates.restore_scoped(hidden, _mapping(spark, sf_dir), surrogates.SCOPE, "redacted").select("conv_id", "turn", F.col("restored").alias("text"))


def _restored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = surrogates.rewrite_scoped(_talk(spark, sf_dir), ["conv_id", "turn"], surrogates.SCOPE, order=["turn"])
    bodies = hidden.withColumns({"body": F.to_json(F.struct(F.col("redacted").alias("said"))), "content_type": F.lit("application/json")})
    back = requests.answer(bodies, rehydrate="scope", mapping=_mapping(spark, sf_dir))
    return back.select("conv_id", "turn", F.get_json_object("restored", "$.said").alias("text"))


_add("rehydrate_scope_json", _restored_json, f"SELECT conv_id, turn, text FROM ({_TALK})")
_add("rehydrate_scope", _restored, f"SELECT conv_id, turn, text FROM ({_TALK})")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.redact(carriers.frame(spark, sf_dir, "documents"))
    pairs = F.array_distinct(F.transform(F.arrays_zip(S.numbered(F.col("spans")).alias("n"), F.col("spans").alias("s")), lambda x: F.struct(x["n"], x["s"]["value"])))
    return rows.select("id", surrogates.restore(F.col("redacted"), F.map_from_entries(pairs)).alias("text"))


_add("rehydrate_roundtrip", _round_trip, "SELECT doc_id AS id, text FROM documents")
_KEY = b"a key for tests"


def _hashed(block: int) -> str:
    pad = _KEY.ljust(64, b"\0")
    return "'" + "".join(f"\\x{b ^ block:02X}" for b in pad) + "'::BLOB"


_add("vault_hmac", lambda spark, d: _mapping(spark, d).select("conversation_id", "value", surrogates.original_hmac(_KEY).alias("original_hmac")), f"SELECT conversation_id, value, sha256({_hashed(0x5C)} || unhex(sha256({_hashed(0x36)} || encode(org_id) || '\\x00'::BLOB || encode(workspace_id) || '\\x00'::BLOB || encode(conversation_id) || '\\x00'::BLOB || encode(entity) || '\\x00'::BLOB || encode(value)))) AS original_hmac FROM ({_TALK_MAP})")


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of findings, the second with known and new values; originals decrypted again."""
    found = _talk(spark, sf_dir).select(*surrogates.SCOPE, "turn", F.posexplode_outer("spans").alias("pos", "s")).where("s IS NOT NULL").select(*surrogates.SCOPE, "turn", "pos", F.col("s.entity").alias("entity"), F.col("s.value").alias("value"))
    empty = spark.createDataFrame([], surrogates.vault_schema())
    one = surrogates.upsert(empty, found.where("turn = 0"), _KEY, "secret", F.timestamp_seconds(F.lit(0)), ["turn", "pos"])
    two = surrogates.upsert(one, found.where("turn > 0"), _KEY, "secret", F.timestamp_seconds(F.lit(60)), ["turn", "pos"])
    return two.select("conversation_id", "entity", surrogates.decrypt(F.col("original_ciphertext"), "secret").alias("value"), "surrogate", F.length("original_ciphertext").cast("long").alias("cipher_length"), (F.unix_timestamp("last_seen_at") - F.unix_timestamp("created_at")).alias("touched_after"))


_FOUND = f"SELECT t.conversation_id, s.entity, s.value, t.turn, s.span_start FROM ({_TALK_SPANS}) s JOIN (SELECT * EXCLUDE (text) FROM ({_TALK})) t USING (id)"
_add("vault_upsert", _vault, f"""WITH f AS ({_FOUND}), v AS (SELECT conversation_id, entity, value, min(turn * 1000000 + span_start) AS first, min(turn) AS t0, max(turn) AS t1 FROM f GROUP BY ALL)
SELECT conversation_id, entity, value, '[' || entity || '_' || row_number() OVER (PARTITION BY conversation_id, entity ORDER BY t0 > 0, first, value) || ']' AS surrogate, (strlen(value) + 28)::BIGINT AS cipher_length, CASE WHEN t0 = 0 AND t1 > 0 THEN 60::BIGINT ELSE 0::BIGINT END AS touched_after FROM v""")


# JSON payloads

_BODY = """concat('{"model":"m', event_id % 5, '","role":"user","messages":[{"role":"user","content":"mail e', event_id % 7, '@example.com now"},{"content":[{"text":"ip 10.0.', event_id % 256, '.', user_id % 256, '"}]}],"password":"p', event_id, '","max_tokens":', event_id, ',"note":"mail e', event_id % 7, '@example.com","tags":["a@example.org",null,true,1.50]}')"""
_LEAVES = (
    ("messages.*.content", "content", "'mail e' || event_id % 7 || '@example.com now'"), ("messages.*.content.*.text", "text", "'ip 10.0.' || event_id % 256 || '.' || user_id % 256"), ("messages.*.role", "role", "'user'"),
    ("model", "model", "'m' || event_id % 5"), ("note", "note", "'mail e' || event_id % 7 || '@example.com'"), ("password", "password", "'p' || event_id"), ("role", "role", "'user'"), ("tags.*", "*", "'a@example.org'"),
)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # bodies are made of rows a tenth of their size, so what one task reads is dealt out first
    events = _table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
    return events.selectExpr("event_id", f"{_BODY} as body", "'application/json; charset=utf-8' as content_type")


_add("json_leaves", lambda spark, d: payload.explode_leaves(_bodies(spark, d), ["event_id"]).select("event_id", F.array_join("path", ".").alias("path"), "key", "value"), " UNION ALL ".join(f"SELECT event_id, '{p}' AS path, '{k}' AS key, {v} AS value FROM events" for p, k, v in _LEAVES))


def _scrubbed(policy: payload.Policy, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = payload.scrub(_bodies(spark, sf_dir), ["event_id"], policy=policy, **options)
        return out.select("event_id", "is_json", "sanitized", reports.compact(F.col("findings")).alias("findings"), "changed", "reencoded")

    return query


def _scrubbed_sql(schema: bool) -> str:
    ip = "'[IP_ADDRESS_1]'"
    note = "'mail e' || event_id % 7 || '@example.com'" if schema else "'mail [EMAIL_1]'"
    tag = "'a@example.org'" if schema else "'[EMAIL_2]'"
    count = "EMAIL:1,IP_ADDRESS:1,SECRET:1" if schema else "EMAIL:3,IP_ADDRESS:1,SECRET:1"
    body = f"""'{{"max_tokens":' || event_id || ',"messages":[{{"content":"mail [EMAIL_1] now","role":"user"}},{{"content":[{{"text":"ip ' || {ip} || '"}}]}}],"model":"m' || event_id % 5 || '","note":"' || {note} || '","password":"[SECRET_1]","role":"user","tags":["' || {tag} || '",null,true,1.50]}}'"""
    return f"SELECT event_id, true AS is_json, {body} AS sanitized, '{count}' AS findings, true AS changed, false AS reencoded FROM events"


_add("json_all_strings", _scrubbed(payload.Policy()), _scrubbed_sql(False))
_add("json_schema_mode", _scrubbed(payload.Policy(json_mode="schema")), _scrubbed_sql(True))


def _json_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _bodies(spark, sf_dir)
    out = payload.scrub(bodies, ["event_id"]).join(bodies.select("event_id", "content_type"), "event_id")
    back = payload.rehydrate(out, "originals", "sanitized")
    same = payload.rebuilt(F.col("body"), F.col("content_type"), F.transform(payload.leaves(F.col("body"), F.col("content_type")), lambda x: x["value"]))
    return back.select("event_id", "restored").join(bodies.select("event_id", same.alias("expected")), "event_id").select("event_id", (F.col("restored") == F.col("expected")).alias("same"))


_add("json_rehydrate", _json_back, "SELECT event_id, true AS same FROM events")
_KEYS = "concat(case part.p_partkey % 16 when 0 then 'API-Key' when 1 then 'max_tokens' when 2 then 'contact_Email' when 3 then 'mobile' when 4 then 'classname' when 5 then 'DateOfBirth' when 6 then 'ip_address' when 7 then 'firstName' when 8 then 'Account Number' when 9 then 'content' when 10 then 'Session-ID' when 11 then 'é_ssn' when 12 then '' when 13 then '*' when 14 then 'caseId' else 'name' end, '')"
_KEY_SQL = "regexp_replace(lower(k), '[^a-z0-9]', '', 'g')"
_add("key_type", lambda spark, d: _table(spark, d, "part").alias("part").selectExpr("p_partkey", f"{_KEYS} as k").select("p_partkey", "k", payload.key_type(F.col("k")).alias("entity")), f"SELECT p_partkey, k, CASE {' '.join(f'''WHEN {' OR '.join(f'contains({_KEY_SQL}, {oracle.quoted(t)})' for t in terms)} THEN '{entity}' ''' for entity, terms in payload.KEY_TERMS)} END AS entity FROM (SELECT p_partkey, {_KEYS} AS k FROM part)")
_PATHS = ("messages.*.content", "CONTENT", "model", "*", "a.b", "metadata.*")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payload.explode_leaves(_bodies(spark, sf_dir), ["event_id"])
    return rows.select("event_id", F.array_join("path", ".").alias("path"), *[payload.path_matches(F.col("path"), p).alias(f"m{k}") for k, p in enumerate(_PATHS)], payload.scrubbed_path(F.col("path"), payload.Policy(json_mode="schema")).alias("searched"))


_MATCH = {"messages.*.content": "path = 'messages.*.content'", "CONTENT": "key = 'content'", "model": "key = 'model'", "*": "true", "a.b": "false", "metadata.*": "false"}
_add("path_match", _paths, "SELECT event_id, path, " + ", ".join(f"{_MATCH[p]} AS m{k}" for k, p in enumerate(_PATHS)) + ", path IN ('messages.*.content', 'messages.*.content.*.text') AS searched FROM (" + " UNION ALL ".join(f"SELECT event_id, '{p}' AS path, '{k}' AS key FROM events" for p, k, _ in _LEAVES) + ")")
_add("model_extract", lambda spark, d: _bodies(spark, d).select("event_id", requests.model_name(F.col("body")).alias("model")), "SELECT event_id, 'm' || event_id % 5 AS model FROM events")


# requests

_QUERY = "concat('q=find+me+u', c_custkey, '%40example.com&token=t', c_custkey, '&email=x%40y.example&q=plain&empty=')"
_add("query_param_scrub", lambda spark, d: requests.scrub_query(_table(spark, d, "customer").selectExpr("c_custkey", f"{_QUERY} as query"), "query").select("c_custkey", "scrubbed_query", reports.compact(F.col("query_findings")).alias("findings")), "SELECT c_custkey, 'email=%5BEMAIL_1%5D&empty=&q=find+me+%5BEMAIL_2%5D&q=plain&token=%5BSECRET_1%5D' AS scrubbed_query, 'EMAIL:2,SECRET:1' AS findings FROM customer")
_add("target_url", lambda spark, d: _table(spark, d, "customer").select("c_custkey", requests.target_url(F.when(F.col("c_custkey") % 2 == 0, "https://up.example/v1/").otherwise("https://up.example/v1"), F.when(F.col("c_custkey") % 3 == 0, "/chat").otherwise("chat"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("a=1")).alias("url")), "SELECT c_custkey, 'https://up.example/v1/chat' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '?a=1' END AS url FROM customer")
_HEADERS = "map('Authorization', array('x'), 'X-Org-ID', array(case when c_custkey % 4 = 0 then ' ' else concat('o', c_custkey % 7) end), 'Keep-Alive', array('5'), 'x-workspace-id', array(concat('w', c_custkey % 3)), 'X-Conversation-ID', case when c_custkey % 6 = 0 then array('') else array(concat('c', c_custkey)) end, 'Accept', array('a', 'b'), 'X-Correlation-ID', array(concat('r', c_custkey)))"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_HEADERS} as headers")


_add("header_filter", lambda spark, d: _headers(spark, d).select("c_custkey", F.array_join(F.array_sort(F.map_keys(requests.filter_headers(F.col("headers")))), ",").alias("request"), F.array_join(F.array_sort(F.map_keys(requests.filter_headers(F.col("headers"), response=True))), ",").alias("response")), "SELECT c_custkey, 'Accept,X-Conversation-ID,X-Correlation-ID,X-Org-ID,x-workspace-id' AS request, 'Accept,Authorization,X-Conversation-ID,X-Correlation-ID,X-Org-ID,x-workspace-id' AS response FROM customer")
_add("scope_resolve", lambda spark, d: requests.resolve_scope(_headers(spark, d)).select("c_custkey", "org_id", "workspace_id", "conversation_id", "user_id", "rejected", requests.request_id(F.col("headers")).alias("request_id")), "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'default' ELSE 'o' || c_custkey % 7 END AS org_id, 'w' || c_custkey % 3 AS workspace_id, CASE WHEN c_custkey % 6 <> 0 THEN 'c' || c_custkey END AS conversation_id, 'dev-user' AS user_id, CASE WHEN c_custkey % 6 = 0 THEN 'missing conversation' END AS rejected, 'r' || c_custkey AS request_id FROM customer")
_CLAIMS = """concat('{"email":"', case when c_custkey % 3 = 0 then ' ' else concat('u', c_custkey, '@example.com') end, '","sub":"s', c_custkey, '","groups":["g', c_custkey % 4, '",7],"roles":"r"}')"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat('h.', translate(replace(base64({_CLAIMS}), '=', ''), '+/', '-_'), '.s') as token")
    read = rows.withColumn("claims", requests.claims(F.regexp_replace("token", "[\r\n]", "")))
    return read.select("c_custkey", requests.claim(F.col("claims"), requests.USER_CLAIMS).alias("user_id"), F.array_join(requests.claim_list(F.col("claims")), ",").alias("groups"), requests.allowed_group(requests.claim_list(F.col("claims")), ["G1", "g2"]).alias("allowed"))


_add("claims", _claims, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey ELSE 'u' || c_custkey || '@example.com' END AS user_id, 'g' || c_custkey % 4 || ',7,r' AS groups, c_custkey % 4 IN (1, 2) AS allowed FROM customer")


def _processed(spark: SparkSession, sf_dir: str, deny: tuple[str, ...] = ("ip_address",)) -> DataFrame:
    body = """concat('{"model":"m","prompt":"reach 10.1.2.', c_custkey % 300, ' or a', c_custkey % 9, '@example.com"}')"""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{_HEADERS} as headers", "concat('q=u', c_custkey, '%40example.com') as query", f"case when c_custkey % 11 = 0 then concat('{{', repeat('x', 3000)) else {body} end as body", "'application/json' as content_type")
    return requests.process(rows, "id", deny=deny, max_body=2048)


_STATUS = "CASE WHEN c_custkey % 6 = 0 THEN 401 WHEN c_custkey % 11 = 0 THEN 413 WHEN c_custkey % 300 < 256 THEN 400 ELSE 200 END"
_add("request_process", lambda spark, d: _processed(spark, d).select("id", "status", reports.compact(F.col("findings")).alias("findings"), F.array_join("denied", ",").alias("denied"), "sanitized"), f"""SELECT id, status, CASE WHEN status IN (401, 413) THEN 'none' WHEN octet THEN 'EMAIL:2,IP_ADDRESS:1' ELSE 'EMAIL:2' END AS findings, CASE WHEN status = 400 THEN 'IP_ADDRESS' ELSE '' END AS denied,
  CASE WHEN status NOT IN (401, 413) THEN '{{"model":"m","prompt":"reach ' || CASE WHEN octet THEN '[IP_ADDRESS_1]' ELSE '10.1.2.' || id % 300 END || ' or [EMAIL_1]"}}' END AS sanitized FROM (SELECT c_custkey::BIGINT AS id, {_STATUS} AS status, c_custkey % 300 < 256 AS octet FROM customer)""")
_add("audit_rows", lambda spark, d: requests.audit(_processed(spark, d), F.timestamp_seconds(F.lit(0))).groupBy("org_id", "upstream_model", "denied", "status_code").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("request_id").alias("ids")), f"SELECT org_id, 'm' AS upstream_model, status = 400 AS denied, status AS status_code, count(*) AS requests, count(DISTINCT c_custkey) AS ids FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'default' ELSE 'o' || c_custkey % 7 END AS org_id, {_STATUS} AS status FROM customer) WHERE status NOT IN (401, 413) GROUP BY ALL")


def _echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.from_json("echo", "mode string, path string, json_mode string, redacted boolean, elapsed_ms long, response_rehydration_on boolean, sanitized_query string, sanitized_body string, findings map<string,int>")
    read = requests.echo(_processed(spark, sf_dir, deny=()), "id").select("id", report.alias("r")).select("id", "r.*")
    return read.withColumn("findings", reports.compact(F.col("findings")))


_add("echo_report", _echo, f"""SELECT id, 'echo' AS mode, 'redacted' AS path, 'all_strings' AS json_mode, true AS redacted, 0::BIGINT AS elapsed_ms,
  false AS response_rehydration_on, 'q=%5BEMAIL_1%5D' AS sanitized_query, findings, sanitized AS sanitized_body
FROM ({_sql["request_process"]}) WHERE status IN (200, 400)""")


# model tokens

_TOKENS = """array(
  named_struct('word', 'mail', 'entity', 'O-', 'score', 0.1D, 'start', 0L, 'end', 4L),
  named_struct('word', 'u', 'entity', 'B-private_email', 'score', 0.9D, 'start', 5L, 'end', 6L),
  named_struct('word', '@example', 'entity', 'I-private_email', 'score', cast(0.84 + s_suppkey % 3 / 100.0 as double), 'start', 6L, 'end', 14L),
  named_struct('word', 'Ana', 'entity', 'B-private_person', 'score', 0.99D, 'start', 19L, 'end', 22L),
  named_struct('word', ' Li', 'entity', 'E-private_person', 'score', 0.95D, 'start', 22L, 'end', 25L),
  named_struct('word', '555', 'entity', 'S-private_phone', 'score', 0.97D, 'start', 26L, 'end', 29L))"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'mail u@example.com Ana Li 555' as text", f"{_TOKENS} as tokens")


_add("token_group_bies", lambda spark, d: _tokens(spark, d).select("s_suppkey", F.explode(tokens.groups(F.col("tokens"))).alias("g")).select("s_suppkey", F.col("g.start").alias("span_start"), F.col("g.end").alias("span_end"), F.col("g.entity").alias("entity"), F.col("g.score").alias("score")), """SELECT s_suppkey, s.* FROM supplier, (VALUES (0, 5::BIGINT, 6::BIGINT, 'private_email', 0.9::DOUBLE), (1, 5, 14, 'private_email', 0.875), (2, 5, 14, 'private_email', 0.88), (0, 19, 25, 'private_person', 0.97), (1, 19, 25, 'private_person', 0.97), (2, 19, 25, 'private_person', 0.97), (0, 26, 29, 'private_phone', 0.97), (1, 26, 29, 'private_phone', 0.97), (2, 26, 29, 'private_phone', 0.97)) v(m, span_start, span_end, entity, score), LATERAL (SELECT v.span_start, v.span_end, v.entity, v.score) s WHERE s_suppkey % 3 = m""")
_add("template_redact", lambda spark, d: tokens.redact(_tokens(spark, d), template="<{entity}|{text}|{score}>").select("s_suppkey", "redacted"), "SELECT s_suppkey, 'mail <private_email|u@example.com|' || CASE s_suppkey % 3 WHEN 0 THEN '0.9000' WHEN 1 THEN '0.8750' ELSE '0.8800' END || '> <private_person|Ana Li|0.9700> 555' AS redacted FROM supplier")
_DETECTIONS = "array(named_struct('start', s_suppkey % 7, 'end', s_suppkey % 7 + 3, 'entity', 'a', 'score', 0.9D), named_struct('start', 5L, 'end', 9L, 'entity', case when s_suppkey % 2 = 0 then 'a' else 'b' end, 'score', 0.95D), named_struct('start', 20L, 'end', 22L, 'entity', 'c', 'score', 0.86D))"
_add("span_merge", lambda spark, d: _table(spark, d, "supplier").selectExpr("s_suppkey", f"{_DETECTIONS} as found").select("s_suppkey", F.explode(tokens.merged(F.col("found"))).alias("g")).select("s_suppkey", F.col("g.start").alias("span_start"), F.col("g.end").alias("span_end"), F.col("g.entity").alias("entity"), F.col("g.score").alias("score")), """WITH d AS (SELECT s_suppkey, (s_suppkey % 7)::BIGINT AS s, (s_suppkey % 7 + 3)::BIGINT AS e, 'a' AS n, 0.9::DOUBLE AS p FROM supplier UNION ALL SELECT s_suppkey, 5, 9, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END, 0.95 FROM supplier UNION ALL SELECT s_suppkey, 20, 22, 'c', 0.86 FROM supplier),
o AS (SELECT *, max(e) OVER (PARTITION BY s_suppkey ORDER BY s, e, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d), g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY s_suppkey ORDER BY s, e, n) AS i FROM o)
SELECT s_suppkey, min(s) AS span_start, max(e) AS span_end, array_to_string(list_distinct(list(n)), '+') AS entity, max(p) AS score FROM (SELECT * FROM g) GROUP BY s_suppkey, i HAVING len(list_distinct(list(n))) = 1
UNION ALL SELECT s_suppkey, min(s), max(e), first(n ORDER BY s, e, n) || '+' || last(n ORDER BY s, e, n), max(p) FROM g GROUP BY s_suppkey, i HAVING len(list_distinct(list(n))) = 2""")
_MODEL = "array(named_struct('entity', ' Private_Email ', 'score', 0.9D, 'start', 4L, 'end', 8L, 'text', 'x'), named_struct('entity', 'weird', 'score', 0.85D, 'start', 0L, 'end', 2L, 'text', 'ab'), named_struct('entity', 'phone', 'score', 0.5D, 'start', 0L, 'end', 2L, 'text', 'ab'))"


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", f"explode({_MODEL}) as d").select("id", "d.*")
    return detectors.model_findings(rows).select("id", "entity", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


_add("model_findings", _model, "SELECT s_suppkey AS id, 'EMAIL' AS entity, 4::BIGINT AS span_start, 8::BIGINT AS span_end FROM supplier UNION ALL SELECT s_suppkey, 'MODEL_PRIVATE', 0, 2 FROM supplier")


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carriers.frame(spark, sf_dir, "account").where("id IS NOT NULL")
    found = rows.select("id", F.lit("PERSON").alias("entity"), F.lit(0).cast("long").alias("start"), F.lit(14).cast("long").alias("end"), F.substring("text", 1, 14).alias("value"))
    return S.findings(S.with_spans(detectors.attach(rows, "id", found), external="external"), ["id"])


_add("external_detector", _external, "SELECT c_custkey::BIGINT AS id, 'PERSON' AS entity, 0::BIGINT AS span_start, 14::BIGINT AS span_end, 'Account number' AS value FROM customer UNION ALL SELECT c_custkey, 'ID', 18, 26, 'C-' || lpad(c_custkey::VARCHAR, 6, '0') FROM customer")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "concat('k glpat-', repeat('q', cast(18 + s_suppkey % 4 as int)), ' again glpat-', repeat('q', cast(18 + s_suppkey % 4 as int))) as text")
    return S.findings(S.with_spans(detectors.gather(rows, "id", names=["rules"]), external="external", entities=("SECRET",)), ["id"])


_add("rule_table", _rules, "SELECT id, 'SECRET' AS entity, span_start, span_start + length(v) AS span_end, v AS value FROM (SELECT s_suppkey AS id, 'glpat-' || repeat('q', (18 + s_suppkey % 4)::INT) AS v, unnest([2, 2 + 6 + 18 + s_suppkey % 4 + 7])::BIGINT AS span_start FROM supplier WHERE s_suppkey % 4 >= 2)")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
