"""Summaries, checks, the fixpoint, and statistics of timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.recognizers import ENTITY_TYPES
from veilspan.operators import spans as S


def total(counts: Column) -> Column:
    """The sum of a map of counts."""
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)


def merge(left: Column, right: Column) -> Column:
    """Two maps of counts added up."""
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def compact(counts: Column, between: str = ":", fixed_order: bool = False) -> Column:
    """TYPE:n joined by commas, by name or in the order of types; none if empty."""
    if fixed_order:
        keys = F.filter(F.array(*map(F.lit, ENTITY_TYPES)), lambda k: F.coalesce(F.element_at(counts, k), F.lit(0)) > 0)
    else:
        keys = F.array_sort(F.map_keys(counts))
    parts = F.transform(keys, lambda k: F.concat(k, F.lit(between), F.element_at(counts, k).cast("string")))
    return F.when(F.size(parts) > 0, F.array_join(parts, ",")).otherwise("none")


def denied(counts: Column, types: Sequence[str]) -> Column:
    """The types found that are not allowed, by name."""
    return F.array_sort(F.array_intersect(F.map_keys(counts), F.array(*[F.lit(t.strip().upper()) for t in types]).cast("array<string>")))


def by_type(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("findings"))


def report(df: DataFrame, path_col: str, text_col: str = "text", **options) -> DataFrame:
    """A row for each text: path, changed, bytes_in, bytes_out, findings; and the rewritten text."""
    out = S.redact(df, text_col, **options)
    return out.select(F.col(path_col).alias("path"), (~F.col("redacted").eqNullSafe(F.col(text_col))).alias("changed"), F.octet_length(text_col).cast("long").alias("bytes_in"), F.octet_length("redacted").cast("long").alias("bytes_out"), S.summary(F.col("spans")).alias("findings"), "redacted")


def summary_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("path", "changed", "bytes_in", "bytes_out", "findings")).alias("value"))


def summary_text(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("%s changed=%s findings=%s", "path", F.col("changed").cast("string"), compact(F.col("findings"), fixed_order=True)).alias("value"))


def check(rows: DataFrame) -> DataFrame:
    """(dirty, exit_code): whether any text changed, and 2 if so."""
    any_ = F.coalesce(F.bool_or("changed"), F.lit(False))
    return rows.agg(any_.alias("dirty"), F.when(any_, 2).otherwise(0).alias("exit_code"))


def until_clean(df: DataFrame, id_col: str, text_col: str = "text", passes: int = 3, **options) -> DataFrame:
    """(id, text, findings, passes, verified_clean): each text rewritten until a pass leaves it as it is, passes times at
    most; then one more pass tells whether it is clean. Texts that are clean take no part in later passes."""
    if passes < 1:
        raise ValueError("at least one pass is needed")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    state = df.select(F.col(id_col), F.col(text_col).alias("text"), none.alias("findings"), F.lit(0).alias("passes"), F.lit(False).alias("verified_clean"))
    for _ in range(passes):
        live = ~F.col("verified_clean")
        once = S.redact(state.withColumn("__live", F.when(live, F.col("text"))), "__live", "__out", **options)
        changed = ~F.col("__out").eqNullSafe(F.col("__live"))
        state = once.select(id_col, F.when(live, F.col("__out")).otherwise(F.col("text")).alias("text"), F.when(live, merge(F.col("findings"), F.coalesce(S.summary(F.col("spans")), none))).otherwise(F.col("findings")).alias("findings"), (F.col("passes") + live.cast("int")).alias("passes"), (F.col("verified_clean") | ~changed).alias("verified_clean"))
    last = S.with_spans(state, "text", "__spans", **options)
    return last.select(id_col, "text", "findings", "passes", (F.col("verified_clean") | (F.coalesce(F.size("__spans"), F.lit(0)) <= 0)).alias("verified_clean"))


def timings(df: DataFrame, value_col: str, *keys: str) -> DataFrame:
    """mean, min, max and nearest-rank p50 and p95, rounded to two digits half up."""
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value_col})")
    made = df.groupBy(*keys).agg(F.count(value_col).alias("runs"), F.avg(value_col).alias("mean"), F.min(value_col).alias("min"), F.max(value_col).alias("max"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))
    return made.select(*keys, "runs", *[F.round(c, 2).alias(c) for c in ("mean", "min", "max", "p50", "p95")])


def throughput(df: DataFrame, tokens_col: str, ms_col: str, *keys: str) -> DataFrame:
    """The mean over runs of tokens a second; runs without a time or tokens are left out. Rounded half even."""
    return df.groupBy(*keys).agg(F.bround(F.avg(F.when(F.col(ms_col) > 0, F.col(tokens_col) / (F.col(ms_col) / 1000))), 2).alias("tokens_per_second"))


def runs(df: DataFrame, label_col: str, order: Sequence[str], *keys: str) -> DataFrame:
    """Runs of equal labels that follow one another: (keys, run, label, length)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.lag(label_col).over(own).eqNullSafe(F.col(label_col)) & (F.row_number().over(own) > 1), 0).otherwise(1)
    marked = df.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(own))
    return marked.groupBy(*keys, "run", F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("length"))
