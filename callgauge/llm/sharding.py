"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash over buckets that fit in memory. Pass two shuffles each bucket
by Fisher-Yates (Spark's ``shuffle`` of an array) and writes it. A bucket's place in the global order is the
number of records in the buckets before it, so a record's place is known where it is written, and place
times shards over records gives its shard: the numbers of rows of two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import Scratch, shared_dir, small, text_of

BUCKET_BYTES = 8 << 20
TASKS = 100_000  #: partitions that buckets are dealt over at most; with more buckets a task takes several, one after another
OFTEN = 100  #: rows equal in id and text from which on they may be dealt over buckets


def write_shards(docs: DataFrame, n_shards: int, path: str | None = None, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all columns of ``docs`` as Parquet, a folder a shard, and return the table read back.

    Added columns: shard (int, 0 to n_shards - 1; a folder) and slot (long, gapless from 0 within the shard).
    Clashing columns of ``docs`` of these names, in any case, are replaced. Null ids and texts are records like any other.
    Records that are equal in id and text are all kept; where they alone fill two buckets they are dealt over all of
    them. Empty input gives an empty table. ``bucket_bytes`` bounds what one task holds: buckets are sorted and
    gathered one at a time, and one has this much text on average, more only by chance or by one very long record.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "shards")
    held = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    record = docs.select(F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("_h"), F.struct(*held).alias("_r"))
    total = docs.select(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_of(text_col)) + 16).alias("b")).first()
    n, buckets = total["n"], max(1, -(-(total["b"] or 0) // bucket_bytes))
    with Scratch(spark) as scratch:
        hot = scratch.written(record.groupBy("_h").count().filter(F.col("count") > max(OFTEN, 2 * n // buckets)).select("_h"), "shard-hot")
        if not hot.isEmpty():  # written with where they go, as both passes below have to agree on it
            apart = record.join(hot, "_h").select(F.xxhash64("_h", F.monotonically_increasing_id()).alias("_h"), "_r")
            record = record.join(hot, "_h", "left_anti").unionByName(scratch.written(apart, "shard-apart"))
        record = record.withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        # a row a bucket, up to TASKS of them small enough to broadcast: a join by shuffle would move the buckets again
        places = small(scratch.written(record.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from")), "shard-places"), 64)
        # in hash order first: a task that runs again shuffles the same array
        by_hash = lambda a, b: F.when(a["_h"] < b["_h"], -1).when(a["_h"] > b["_h"], 1).otherwise(0)
        dealt = record.select("_b", F.struct("_h", "_r").alias("_x"))
        dealt = dealt.repartitionById(buckets, F.col("_b")) if buckets <= TASKS else dealt.repartition(TASKS, F.col("_b"))
        scattered = dealt.groupBy("_b").agg(F.collect_list("_x").alias("_xs"))
        dealt = scattered.join(places, "_b").select("_from", F.posexplode(F.shuffle(F.array_sort("_xs", by_hash), F.lit(seed))).alias("_p", "_x"))
        at = F.col("_from") + F.col("_p")
        shard = F.expr(f"cast((_from + _p) * {n_shards}L div {max(n, 1)}L as int)")
        first = F.expr(f"(_shard * {n}L + {n_shards - 1}L) div {n_shards}L")  # the first place of a shard
        out = dealt.select(at.alias("_at"), shard.alias("_shard"), "_x").select("_x._r.*", F.col("_shard").alias("shard"), (F.col("_at") - first).alias("slot"))
        # by sorting, an aggregation holds one bucket; by hashing, all those of its task
        hashing = "spark.sql.execution.useObjectHashAggregateExec"
        was = spark.conf.get(hashing)
        spark.conf.set(hashing, "false")
        try:
            out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(hashing, was)
    schema = docs.select(*held).schema.add("slot", T.LongType()).add("shard", T.IntegerType())
    return spark.read.schema(schema).parquet(path)
