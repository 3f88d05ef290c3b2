"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

All of it is DataFrame operations. The first pass aggregates by (hash, whole text): equal hashes meet in one
task and the text in the key compares their bytes, and the map-side half of that aggregation leaves one row of
a hot text per input split. Its result, a row a text without the text, is written to the shared folder. The
second pass counts (id, hash), so that rows that repeat are one row a split as well, and joins the counts to it; a hot
hash is split by the skew join of adaptive execution. Only where two texts share a hash does that pass carry texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import Scratch, copies, small, text_of

#: A run of white space, without the single space that would be replaced by itself.
SPACE_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), SPACE_RUN, " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row a row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text: empty. Null id: ranks behind every id, kept only where the whole group has none. Of rows that
    repeat with the same id and text exactly one is kept. Empty input: no rows. Other columns are ignored.
    ``hashed`` may be weak: rows of one hash and different bytes stay apart. A very long text is held once
    a task, like any value of a column.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_t"))
    keyed = rows.select("_id", "_t", hashed(F.col("_t")).alias("_h"))
    with Scratch(docs.sparkSession) as scratch:
        texts = keyed.groupBy("_h", "_t").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        groups = scratch.written(texts.select("_h", F.unhex(F.sha2("_t", 256)).alias("_s"), "_keep", "_n"), "exact-groups", keep=True)
        met = scratch.written(groups.groupBy("_h").count().filter("count > 1").select("_h"), "exact-met", keep=True)
        split = not met.isEmpty()
    held = keyed.select("_id", "_h").groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_c")).join(groups.join(met, "_h", "left_anti") if split else groups, "_h")
    if split:  # two texts of one hash: their rows are told apart by the texts themselves
        apart = keyed.join(met, "_h", "left_semi")
        known = apart.groupBy("_h", "_t").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        apart = apart.groupBy("_id", "_h", "_t").agg(F.count(F.lit(1)).alias("_c")).join(known, ["_h", "_t"])
        held = held.unionByName(apart.withColumn("_s", F.unhex(F.sha2("_t", 256))).select(held.columns))
    return copies(held, "_c").select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 0)).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only the ids that go are joined to the rows; a row whose id repeats with the same text is kept once, by
    the rank among such rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = exact_duplicates(docs, id_col, text_col)
        gone = scratch.written(
            found.groupBy(F.col(id_col).alias("_cg_id"), F.col("text_sha256").alias("_cg_of")).agg(F.max(F.col("kept").cast("int")).alias("_cg_any"), F.count(F.lit(1)).alias("_cg_rows")).filter("_cg_any = 0 OR _cg_rows > 1").drop("_cg_rows"),
            "exact-gone", keep=True,
        )
    sha = F.sha2(normalised(text_col), 256)
    # joined by id; only rows whose id is found are normalised and hashed
    marked = docs.join(small(gone), F.col(id_col).eqNullSafe(F.col("_cg_id")) & F.when(F.col("_cg_of").isNotNull(), F.col("_cg_of") == sha), "left")
    kept = marked.filter("_cg_any IS NULL").select(*docs.columns)
    if gone.filter("_cg_any = 1").isEmpty():
        return kept
    again = marked.filter("_cg_any = 1").dropDuplicates(["_cg_id", "_cg_of"])
    return kept.unionByName(again.select(*docs.columns))
