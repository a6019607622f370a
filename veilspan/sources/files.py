"""Reading texts and payloads, bounded bodies, and sinks that never write where they read."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.requests import MAX_BODY, within


def scan_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text): each file whole, a row each."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, body): each file's bytes."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("content").alias("body"))


def bounded(df: DataFrame, body_col: str = "body", most: int = MAX_BODY) -> tuple[DataFrame, DataFrame]:
    """The rows whose body is small enough, and the others with a reason."""
    fits = within(F.col(body_col), most)
    return df.where(fits), df.where(~fits).withColumn("reason", F.lit(f"body exceeds {most} bytes"))


def write_new_version(df: DataFrame, root: str, version: str) -> str:
    """Write rewritten rows beside their source, as a version of their own; the source stays as the backup. The committer
    makes a version appear whole or not at all, and an existing one is never overwritten."""
    path = str(PurePosixPath(root) / f"version={version}") if "://" not in root else f"{root.rstrip('/')}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def write_changed(report: DataFrame, root: str, version: str) -> str:
    """Only the rows that changed, as a version."""
    return write_new_version(report.where("changed"), root, version)


def write_summary(report: DataFrame, path: str) -> None:
    """One JSON line for each text."""
    from veilspan.operators.reports import summary_json

    summary_json(report).write.mode("error").text(path)


def validate_options(paths: list[str], in_place: bool = False, output: str | None = None, check: bool = False, until_clean: bool = False, passes: int = 3, backup: bool = False, remove_backup: bool = False) -> None:
    """Raise ValueError for options that don't go together."""
    if passes < 1:
        raise ValueError("passes must be at least 1")
    if in_place and not paths:
        raise ValueError("rewriting in place needs paths")
    if in_place and output:
        raise ValueError("rewriting in place and an output exclude each other")
    if check and (in_place or output):
        raise ValueError("a check writes nothing")
    if output and len(paths) > 1:
        raise ValueError("an output takes a single input")
    if backup and not in_place:
        raise ValueError("a backup is only made in place")
    if remove_backup and not (backup and until_clean):
        raise ValueError("removing a backup needs a backup and passes until clean")
    if until_clean and check:
        raise ValueError("a check makes a single pass")
