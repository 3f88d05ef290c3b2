"""Shared folder, tables that cut lineage, and column helpers for the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, the context's checkpoint folder, else (a local master only: tests, a notebook) one below the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/callgauge/{label}-{uuid.uuid4().hex}"


#: Bytes of a row group of intermediate tables: what a task that writes one holds of it.
ROW_GROUP = 32 << 20


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there and columns prune."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one call in the shared folder; those not kept are deleted when the call is done with them.

    A table may go once everything made from it is written; a plan that is returned unrun may read kept ones only.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        path = shared_dir(self.spark, label)
        if not keep:
            self.paths.append(path)
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


#: Bytes of rows, as a task holds them, up to which small() broadcasts.
SMALL = 32 << 20


def small(rows: DataFrame, each: Column | int = 128) -> DataFrame:
    """``rows``, a written table, to be broadcast if all of it has SMALL bytes at most (``each``: of a row); else as they are, for a join by shuffle."""
    size = rows.agg(F.sum(F.lit(each) if isinstance(each, int) else each)).first()[0] or 0
    return F.broadcast(rows) if size <= SMALL else rows


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that owns it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(col: str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Rows that repeat, made at a time.
COPIES = 4096


def copies(rows: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, numbered by _copy from 0; arrays stay short however often one repeats."""
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {COPIES}"))))
    first = F.col("_run") * COPIES
    return runs.withColumn("_copy", F.explode(F.sequence(first, F.least(F.col(times), first + COPIES) - 1))).drop("_run")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
