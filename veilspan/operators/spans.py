"""Finding, filtering, choosing and rewriting sensitive spans.

Everything up to the rewritten text is one projection over the text: no shuffle, no Python. A span is a struct of entity,
start, end (code points, end exclusive) and value; a candidate also has its recognizer's order and priority.
A null text has null spans and stays null, an empty one has none and stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import recognizers as R
from veilspan.functions import validators
from veilspan.functions.dialect import java

_CUT = "\ufdef"
#: Any characters but those that part texts.
ANY_INSIDE = "[^\ufdd0-\ufdef]*?"
CANDIDATE = "array<struct<ord:int,entity:string,priority:int,start:bigint,end:bigint,value:string>>"
SPAN = "array<struct<start:bigint,end:bigint,entity:string,value:string>>"


def _none() -> Column:
    return F.array().cast(CANDIDATE)


def once(value: Column) -> Column:
    """The value, found once a row: the optimizer copies no expression that isn't deterministic into its uses, of which
    those within a lambda would find it again for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def folded(text: Column) -> Column:
    """The text in lower case as word gates read it; the long s folds to s, as patterns see it."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def gate(text: Column, recognizer: R.Recognizer, low: Column | None = None) -> Column:
    """A cheap test that every text with a match of a recognizer passes, and every text around one."""
    if not recognizer.gate:
        return F.lit(True)
    kind, what = recognizer.gate
    if kind == "words":
        return _any(folded(text) if low is None else low, what.split("|"))
    return F.contains(text, F.lit(what)) if kind == "has" else text.rlike(what)


def matches(text: Column, recognizer: R.Recognizer, order: int, low: Column | None = None, inside: bool = False) -> Column:
    """All candidates of one recognizer, leftmost first, without overlaps among themselves. low: folded() of the text;
    inside: nothing is matched across noncharacters. A recognizer that is all value has no groups to be sought for."""
    p = java(recognizer.pattern.replace(".*?", ANY_INSIDE) if inside else recognizer.pattern)
    whole = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    bare = not recognizer.before and not recognizer.after
    before, value = (None, whole) if bare else (F.regexp_extract_all(text, F.lit(p), F.lit(k)) for k in (1, 2))
    # cut at a sign that the text lacks: a pattern to cut at would be compiled for each text
    cut = F.when(F.contains(text, F.lit(_CUT)), F.split(text, p, -1)).otherwise(F.split(F.regexp_replace(text, p, _CUT), _CUT, -1))
    gaps = F.slice(cut, 1, F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), *([whole.alias("value")] if bare else [whole.alias("whole"), before.alias("before"), value.alias("value")]))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        start = begin if bare else begin + F.length(x["before"])
        one = F.struct(
            F.lit(order).alias("ord"), F.lit(recognizer.entity).alias("entity"), F.lit(recognizer.priority).alias("priority"),
            start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"),
        )
        return F.struct((begin + F.length(x["value" if bare else "whole"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out")), step, lambda acc: acc["out"])
    if recognizer.valid:
        found = F.filter(found, lambda c: validators.VALID[recognizer.valid](c["value"]))
    has = gate(text, recognizer, low) & text.rlike(p)
    return F.when(has, found).otherwise(_none())


def around(text: Column, start: Column, end: Column, window: tuple[int, int]) -> Column:
    """The text from some characters before a span to some after it, in lower case."""
    low = F.greatest(start - window[0], F.lit(0))
    return F.lower(F.substr(text, (low + 1).cast("int"), (end + window[1] - low).cast("int")))


def _any(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def false_positive(text: Column, c: Column) -> Column:
    """What the transcript profile leaves out: model findings, and secrets that only talk about secrets."""
    value = F.trim(c["value"])
    low, near = F.lower(value), around(text, c["start"], c["end"], R.SECRET_WINDOW)
    keyword = _any(F.lower(F.btrim(value, F.lit(" \"'`"))), ("secret", "token"))
    benign = (value == "") | _any(low, R.BENIGN_SECRETS) | _any(near, R.BENIGN_SECRETS) | low.isin("secret", "token") | (keyword & _any(near, R.KEYWORD_PLACES))
    return (c["entity"] == "MODEL_PRIVATE") | ((c["entity"] == "SECRET") & benign)


def _runs(profile: str | None, entities: str | Sequence[str] | None, exclude: str | Sequence[str] | None, only: Sequence[str]) -> tuple[str, list[str], list[tuple[int, R.Recognizer]]]:
    """The profile, the types wanted and the recognizers that run, whatever the case in which they are named."""
    profile, chosen, out = R.profile_of(profile), R.entities_of(entities), R.entities_of(exclude, every=True)
    wanted = [e for e in (chosen or R.ENTITY_TYPES) if e not in out]
    return profile, wanted, [(k, r) for k, r in enumerate(R.RECOGNIZERS) if r.entity in wanted and (profile == "broad" or r.transcript) and (not only or r.name in only)]


def candidates(text: Column, profile: str | None = "broad", entities: str | Sequence[str] | None = (), exclude: str | Sequence[str] | None = (), only: Sequence[str] = (), external: Column | None = None, low: Column | None = None, inside: bool = False) -> Column:
    """All candidates of a text. profile: broad or transcript in any case; others are broad. entities: the types wanted, all
    if empty or ALL among them; exclude: types not wanted; only: recognizers by name; external: candidates found elsewhere;
    low: folded() of the text, if it is at hand; inside: see matches(). Recognizers of unwanted types don't run."""
    profile, wanted, runs = _runs(profile, entities, exclude, only)
    parts = []
    for k, r in runs:
        found = matches(text, r, k, low, inside)
        if profile == "transcript" and r.valid == "card":
            found = F.filter(found, lambda c: _any(around(text, c["start"], c["end"], R.CARD_WINDOW), R.CARD_TERMS))
        parts.append(found)
    if external is not None:
        parts.append(F.filter(F.coalesce(external, _none()), lambda c: c["entity"].isin(list(wanted)) if wanted else F.lit(False)))
    found = F.concat(*parts) if parts else _none()
    if profile == "transcript":
        found = F.filter(found, lambda c: ~false_positive(text, c))
    return F.when(text.isNotNull(), found)


def choose(found: Column) -> Column:
    """Spans without overlaps: by priority, then length, then start, then recognizer; the result by start."""
    ranked = F.transform(found, lambda c: F.struct((-c["priority"]).alias("p"), (c["start"] - c["end"]).alias("l"), c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["entity"].alias("entity"), c["value"].alias("value")))
    none = F.array().cast(SPAN)

    def step(acc: Column, c: Column) -> Column:
        one = F.struct(c["start"].alias("start"), c["end"].alias("end"), c["entity"].alias("entity"), c["value"].alias("value"))
        free = ~F.exists(acc, lambda s: (c["start"] < s["end"]) & (s["start"] < c["end"]))
        return F.when(free & (c["start"] < c["end"]), F.concat(acc, F.array(one))).otherwise(acc)

    return F.sort_array(F.aggregate(F.sort_array(ranked), none, step))


def chosen(found: Column) -> Column:
    """choose() for a column of candidates, most of which are empty. The column is read more than once, so it stays a
    projection of its own, in generated code, and only texts with candidates reach the interpreted selection."""
    return F.when(F.size(found) > 0, choose(found)).when(found.isNotNull(), F.array().cast(SPAN))


def numbered(spans: Column) -> Column:
    """The placeholder of each span within its own text: [TYPE_n], n counting the distinct values of a type in order."""
    keys = F.array_distinct(F.transform(spans, lambda s: F.struct(s["entity"].alias("entity"), s["value"].alias("value"))))

    def name(s: Column) -> Column:
        at = F.array_position(keys, F.struct(s["entity"].alias("entity"), s["value"].alias("value"))).cast("int")
        n = F.size(F.filter(F.slice(keys, 1, at), lambda k: k["entity"] == s["entity"]))
        return F.concat(F.lit("["), s["entity"], F.lit("_"), n.cast("string"), F.lit("]"))

    return F.transform(spans, name)


def rewrite(text: Column, spans: Column, names: Column) -> Column:
    """The text with each span replaced by its name."""
    pairs = F.arrays_zip(spans.alias("s"), names.alias("n"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (x["s"]["start"] - acc["at"]).cast("int"))
        return F.struct(x["s"]["end"].alias("at"), F.concat(acc["out"], gap, x["n"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(pairs, start, step, done)).otherwise(text)


def with_spans(df: DataFrame, text_col: str = "text", out: str = "spans", profile: str = "broad", entities: Sequence[str] = (), exclude: Sequence[str] = (), only: Sequence[str] = (), external: str | None = None) -> DataFrame:
    """df with the chosen spans of its text."""
    found = candidates(F.col(text_col), profile, entities, exclude, only, F.col(external) if external else None, F.col("__folded"))
    held = df.withColumn("__folded", folded(F.col(text_col))).withColumn("__candidates", found)
    return held.withColumn(out, chosen(F.col("__candidates"))).drop("__candidates", "__folded")


def findings(df: DataFrame, id_cols: Sequence[str], spans_col: str = "spans") -> DataFrame:
    """One row for each span. The outer form keeps the optimizer from testing the size of the array below the projection
    that makes it, which would find all spans twice."""
    return df.select(*id_cols, F.explode_outer(spans_col).alias("s")).where("s IS NOT NULL").select(*id_cols, F.col("s.entity").alias("entity"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.value").alias("value"))


def redact(df: DataFrame, text_col: str = "text", out: str = "redacted", **options) -> DataFrame:
    """df with the text rewritten by placeholders numbered within each row, and the spans."""
    return with_spans(df, text_col, **options).withColumn("__names", numbered(F.col("spans"))).withColumn(out, rewrite(F.col(text_col), F.col("spans"), F.col("__names"))).drop("__names")


def summary(spans: Column) -> Column:
    """How often each type was replaced, by type."""
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity"])))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(spans, lambda s: s["entity"] == k)))))
