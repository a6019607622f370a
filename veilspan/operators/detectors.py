"""Findings from elsewhere: registered detectors, rule tables and model findings.

A detector is a function from a frame (id, text) to a frame (id, entity, start, end, value); it may be plain
expressions, a Python UDTF or mapInPandas. Its findings compete at one priority with those of the recognizers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import recognizers as R
from veilspan.functions.dialect import java

Detector = Callable[[DataFrame], DataFrame]
_registered: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    _registered[name] = detector


def registered() -> dict[str, Detector]:
    return dict(_registered)


def gather(df: DataFrame, id_col: str, text_col: str = "text", names: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """df with two columns. external: the valid findings of detectors, as candidates; a finding whose bounds don't fit its
    text is left out. errors: the detectors that raised while they planned, each as name and reason; they are skipped, or stop
    the query with strict. What a detector raises while rows run always stops the query."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts, errors = [], []
    for name in names if names is not None else _registered:
        try:
            parts.append(_registered[name](base).select("id", "entity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value"))
        except Exception as error:
            if strict:
                raise
            errors.append(f"{name}: {type(error).__name__}")
    df = df.withColumn("errors", F.array(*map(F.lit, errors)).cast("array<string>"))
    if not parts:
        return df.withColumn("external", F.array().cast("array<struct<ord:int,entity:string,priority:int,start:bigint,end:bigint,value:string>>"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return attach(df, id_col, found, text_col)


def attach(df: DataFrame, id_col: str, found: DataFrame, text_col: str = "text") -> DataFrame:
    """df with a column external of the findings (id, entity, start, end, value)."""
    one = F.struct(F.lit(len(R.RECOGNIZERS)).alias("ord"), "entity", F.lit(R.EXTERNAL_PRIORITY).alias("priority"), "start", "end", "value")
    lists = found.where("start >= 0 AND start < end").groupBy(F.col("id").alias(id_col)).agg(F.sort_array(F.collect_set(one)).alias("external"))
    joined = df.join(lists, id_col, "left")
    return joined.withColumn("external", F.filter(F.coalesce("external", F.array().cast("array<struct<ord:int,entity:string,priority:int,start:bigint,end:bigint,value:string>>")), lambda c: c["end"] <= F.length(text_col)))


def model_entity(label: Column) -> Column:
    """The type of a model's label."""
    names = F.create_map(*[F.lit(x) for pair in R.MODEL_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.trim(label))), F.lit("MODEL_PRIVATE"))


def model_findings(detections: DataFrame, min_score: float = 0.85) -> DataFrame:
    """(id, entity, start, end, value) of model detections (id, entity, score, start, end, text) that are sure enough."""
    return detections.where(F.col("score") >= min_score).select("id", model_entity(F.col("entity")).alias("entity"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("value"))


def occurrences(text: Column, value: Column) -> Column:
    """Where a value stands in a text, without overlaps."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    fold = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, g: F.struct((a["at"] + F.length(g) + F.length(value)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(g))).alias("out")), lambda a: a["out"])
    return F.when(F.length(value) > 0, fold).otherwise(F.array().cast("array<bigint>"))


def rule_detector(rules: dict[str, str]) -> Detector:
    """A detector for secrets from a table of rules (name, pattern). Group 1, if there is one, is the secret, else the whole
    match; each secret is then found at all its places in the text."""

    def detect(base: DataFrame) -> DataFrame:
        found = []
        for pattern in rules.values():
            p = java(pattern)
            groups = 1 if _has_group(pattern) else 0
            found.append(F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(p), F.lit(groups))).otherwise(F.array().cast("array<string>")))
        secrets = F.filter(F.array_distinct(F.concat(*found)), lambda s: s != "")
        rows = base.select("id", "text", F.explode(secrets).alias("value"))
        rows = rows.select("id", "value", F.explode(occurrences(F.col("text"), F.col("value"))).alias("start"))
        return rows.select("id", F.lit("SECRET").alias("entity"), "start", (F.col("start") + F.length("value")).alias("end"), "value").distinct()

    return detect


def _has_group(pattern: str) -> bool:
    import re

    return re.compile(pattern).groups > 0


#: A small rule table of token formats that the recognizers lack.
RULES = {
    "payment key": r"\b(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "package token": r"\bnpm_[0-9A-Za-z]{36}\b",
    "mail key": r"\bSG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}\b",
    "private repository token": r"\bglpat-[0-9A-Za-z_\-]{20,}\b",
}
register_detector("rules", rule_detector(RULES))
