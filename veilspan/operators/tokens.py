"""From the tokens of a labelling model to detections and redacted text.

Tokens are an array of (word, entity, score, start, end) with code-point offsets. All is done within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.dialect import java

DETECTION = "array<struct<start:bigint,end:bigint,entity:string,score:double>>"
# The least score, the template, and labels whose spans are checked.
MIN_SCORE, TEMPLATE = 0.85, "[REDACTED:{entity}]"
EMAILS, PHONES = ("private_email", "email"), ("private_phone", "phone")
_EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"


def label_parts(label: Column) -> Column:
    """(prefix, entity): B, I, E or S before a hyphen, else no prefix."""
    prefix = F.regexp_extract(label, "^([BIES])-(.+)$", 1)
    return F.struct(F.when(prefix != "", prefix).alias("prefix"), F.when(prefix != "", F.regexp_extract(label, "^([BIES])-(.+)$", 2)).otherwise(label).alias("entity"))


def groups(tokens: Column, min_score: float = MIN_SCORE) -> Column:
    """Tokens that belong together: (start, end, entity, score), the score the mean of its tokens'. A new group starts
    at B or S, at another entity, after E or S, after a token without width, and after a gap; a token that is unsure or
    has no entity ends a group."""
    group = "array<struct<start:bigint,end:bigint,entity:string,total:double,n:int>>"
    none = F.struct(F.array().cast(group).alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        part = label_parts(F.coalesce(t["entity"], F.lit("")))
        sure = F.coalesce(~F.isnan(t["score"]) & (t["score"] >= min_score) & (t["score"] < float("inf")), F.lit(False)) & (part["entity"] != "") & t["start"].isNotNull() & t["end"].isNotNull()
        last = F.try_element_at(acc["out"], F.lit(-1))
        joins = F.coalesce(acc["open"] & (last["entity"] == part["entity"]) & ~F.coalesce(part["prefix"].isin("B", "S"), F.lit(False)) & (t["start"] <= last["end"]), F.lit(False))
        more = F.struct(last["start"].alias("start"), F.greatest(last["end"], t["end"].cast("long")).alias("end"), last["entity"].alias("entity"), (last["total"] + t["score"].cast("double")).alias("total"), (last["n"] + 1).alias("n"))
        new = F.struct(t["start"].cast("long").alias("start"), t["end"].cast("long").alias("end"), part["entity"].alias("entity"), t["score"].cast("double").alias("total"), F.lit(1).alias("n"))
        kept = F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        out = F.when(joins, F.concat(kept, F.array(more))).otherwise(F.concat(acc["out"], F.array(new)))
        still = ~F.coalesce(part["prefix"].isin("E", "S"), F.lit(False)) & (t["end"] > t["start"])
        return F.struct(F.when(sure, out).otherwise(acc["out"]).alias("out"), (sure & still).alias("open"))

    done = lambda acc: F.transform(acc["out"], lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["entity"].alias("entity"), F.round(g["total"] / g["n"], 6).alias("score")))
    return F.aggregate(F.coalesce(tokens, F.array().cast("array<struct<word:string,entity:string,score:double,start:bigint,end:bigint>>")), none, step, done)


def located(text: Column, words: Column) -> Column:
    """Where words stand, for models without offsets: each is sought after the one before, as it is, then trimmed; (start,
    end), null where it is not found."""
    place = "array<struct<start:bigint,end:bigint>>"

    def step(acc: Column, w: Column) -> Column:
        at = F.position(w, text, acc["at"].cast("int"))
        lead = F.length(w) - F.length(F.ltrim(w))
        bare = F.trim(w)
        second = F.position(bare, text, acc["at"].cast("int"))
        start = F.when(at > 0, at - 1 + lead).when(second > 0, second - 1)
        ok = (bare != "") & start.isNotNull()
        one = F.struct(F.when(ok, start.cast("long")).alias("start"), F.when(ok, (start + F.length(bare)).cast("long")).alias("end"))
        return F.struct(F.concat(acc["out"], F.array(one)).alias("out"), F.when(ok, (start + F.length(bare) + 1).cast("long")).otherwise(acc["at"]).alias("at"))

    return F.aggregate(words, F.struct(F.array().cast(place).alias("out"), F.lit(1).cast("long").alias("at")), step, lambda acc: acc["out"])


def normalised(text: Column, found: Column) -> Column:
    """Detections trimmed of white space; an e-mail is the first whole address that it overlaps, or dropped; a phone number with fewer
    than seven digits is dropped."""
    part = lambda d: F.substr(text, (d["start"] + 1).cast("int"), (d["end"] - d["start"]).cast("int"))
    lead = lambda d: F.length(part(d)) - F.length(F.regexp_replace(part(d), r"^\s+", ""))
    tail = lambda d: F.length(part(d)) - F.length(F.regexp_replace(part(d), r"\s+$", ""))
    shape = lambda d, s, e: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), d["entity"].alias("entity"), d["score"].alias("score"))
    trimmed = F.transform(found, lambda d: shape(d, F.least(d["start"] + lead(d), d["end"]), F.greatest(d["end"] - tail(d), F.least(d["start"] + lead(d), d["end"]))))
    p = java(_EMAIL)
    mails = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    gaps = F.slice(F.split(text, p, -1), 1, F.size(mails))
    spans = F.aggregate(F.arrays_zip(gaps.alias("g"), mails.alias("m")), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out")), lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("s"), (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e")))).alias("out")), lambda a: a["out"])
    hit = lambda d: F.try_element_at(F.filter(spans, lambda m: (d["start"] < m["e"]) & (m["s"] < d["end"])), F.lit(1))
    fixed = F.transform(trimmed, lambda d: F.when(d["entity"].isin(*EMAILS), F.when(hit(d).isNotNull(), shape(d, hit(d)["s"], hit(d)["e"]))).when(d["entity"].isin(*PHONES) & (F.length(F.regexp_replace(part(d), "[^0-9]", "")) < 7), F.lit(None)).otherwise(d))
    return F.filter(fixed, lambda d: d.isNotNull() & (d["start"] < d["end"]))


def merged(found: Column) -> Column:
    """Detections that overlap or touch, made one: the last end, the highest score, the entities joined by +."""

    def step(acc: Column, d: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        names = F.when(F.array_contains(F.split(last["entity"], r"\+"), d["entity"]), last["entity"]).otherwise(F.concat(last["entity"], F.lit("+"), d["entity"]))
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], d["end"]).alias("end"), names.alias("entity"), F.greatest(last["score"], d["score"]).alias("score"))
        return F.when((F.size(acc) == 0) | (d["start"] > last["end"]), F.concat(acc, F.array(d))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one)))

    # equal spans stay in the order of their entities
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].cast("long").alias("start"), d["end"].cast("long").alias("end"), d["entity"].alias("entity"), d["score"].cast("double").alias("score"))))
    return F.aggregate(ordered, F.array().cast(DETECTION), step)


def rewritten(text: Column, found: Column, template: str = TEMPLATE) -> Column:
    """The text with each detection replaced by a template of {entity}, {text} and {score}."""
    part = lambda d: F.substr(text, (d["start"] + 1).cast("int"), (d["end"] - d["start"]).cast("int"))
    name = lambda d: F.replace(F.replace(F.replace(F.lit(template), F.lit("{entity}"), d["entity"]), F.lit("{text}"), part(d)), F.lit("{score}"), F.format_string("%.4f", d["score"]))
    step = lambda acc, d: F.struct(d["end"].alias("at"), F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (d["start"] - acc["at"]).cast("int")), name(d)).alias("out"))
    return F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))


def detect(df: DataFrame, text_col: str = "text", tokens_col: str = "tokens", min_score: float = MIN_SCORE) -> DataFrame:
    """df with detections; none for an empty text."""
    if not 0 <= min_score <= 1:
        raise ValueError("the least score must be from 0 to 1")
    text = F.col(text_col)
    held = df.withColumn("__groups", groups(F.col(tokens_col), min_score)).withColumn("__spans", normalised(text, F.col("__groups")))
    return held.withColumn("detections", F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(DETECTION)).otherwise(merged(F.col("__spans")))).drop("__groups", "__spans")


def redact(df: DataFrame, text_col: str = "text", tokens_col: str = "tokens", min_score: float = MIN_SCORE, template: str = TEMPLATE) -> DataFrame:
    """df with detections and redacted."""
    return detect(df, text_col, tokens_col, min_score).withColumn("redacted", rewritten(F.col(text_col), F.col("detections"), template))
