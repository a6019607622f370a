"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from veilspan.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veilspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The frame written to the shared folder and read again: its rows are made once and outlive lost executors."""
    return Scratch(df.sparkSession).stored(df, name, compression)


class Scratch:
    """Tables of an operator in the shared folder, so that it can delete those that it no longer needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def clear(self, keep: tuple[DataFrame, ...] = ()) -> None:
        """Delete all tables but some, by the file system that holds them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path, df in list(self.paths.items()):
            if not any(df is k for k in keep):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
                del self.paths[path]


def whole_ids(df: DataFrame, column: str) -> None:
    """Raise ValueError unless a column of ids holds whole numbers."""
    if not isinstance(df.schema[column].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"{column} must hold whole numbers, not {df.schema[column].dataType.simpleString()}")


def field_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
