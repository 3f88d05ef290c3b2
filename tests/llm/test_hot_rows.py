"""A third of all rows equal in id and text, and columns that clash by case: every operator that orders or groups rows."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from callgauge.llm import byte_bpe, ctph, exact_dedup, secret_scan, sharding


@pytest.fixture(scope="module")
def hot(spark):
    own = F.concat(F.lit("text "), F.col("id").cast("string"))
    return spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, own).alias("text"), F.lit("x").alias("SHARD"), F.lit(1).alias("Slot"))


def test_sharding(hot):
    out = sharding.write_shards(hot, 7, bucket_bytes=4000)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "slot", "shard"]
    rows = out.collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 3000 and sorted(map(len, slots.values()))[0] >= 428 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    assert got == sorted((str(r["doc_id"]), str(r["text"])) for r in hot.collect())
    per_shard = [sum(r["doc_id"] is None for r in rows if r["shard"] == k) for k in range(7)]
    assert min(per_shard) > 60  # the equal rows are spread


def test_exact_dedup(hot):
    out = exact_dedup.exact_duplicates(hot).collect()
    assert len(out) == 3000 and sum(r["kept"] for r in out) == 1001
    assert {r["keep_id"] for r in out if r["doc_id"] is None} == {2}
    kept = exact_dedup.keep_first(hot.filter("doc_id IS NULL"))
    assert [tuple(r) for r in kept.collect()] == [(None, None, "x", 1)]


def test_next_rows(hot):
    assert ctph.compare_with_next(hot).groupBy().agg(F.count("fingerprint"), F.count("near_next")).first()[:] == (3000, 3000)


def test_long_copies(spark):
    long = "the same long words " * 300
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(long).alias("text"))
    out = byte_bpe.encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, chunk=1000, overlap=100)
    rows = out.collect()
    assert len(rows) == 900 and len({zlib.crc32(r["ids"]) for r in rows}) == 1 and sum(r["doc_id"] is None for r in rows) == 300


def test_a_scan_that_lost_half_of_its_files(spark, tmp_path):
    """What is left is whole, and the next scan does the rest."""
    path = f"{tmp_path}/ledger"
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("token=abcdefghijkl"), F.col("id").cast("string")).alias("text")).repartition(4)
    want = sorted(map(str, secret_scan.scan_secrets(df, f"file://{path}").collect()))
    files = sorted(tmp_path.glob("ledger/*.parquet"))
    if len(files) < 2:  # written in one piece: in four
        secret_scan.BlobLedger(spark, f"file://{path}").rows().repartition(4).write.parquet(f"file://{path}2")
        path, files = f"{path}2", sorted(tmp_path.glob("ledger2/*.parquet"))
    for f in files[::2]:
        f.unlink()
    ledger = secret_scan.BlobLedger(spark, f"file://{path}")
    left = ledger.rows().count()
    assert 0 < left < 200 and ledger.rows().filter("size(found) = 1").count() == left
    assert sorted(map(str, secret_scan.scan_secrets(df, f"file://{path}").collect())) == want and ledger.rows().count() == 200
