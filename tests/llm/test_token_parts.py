"""Documents coded in parts, wide ids, and rows that repeat an id."""

import numpy as np
import public_tokenizers
import pytest

from callgauge.llm import token_output
from callgauge.llm.tokenizing import ids_of


@pytest.mark.parametrize("part", [256, 512, 1 << 20])
def test_parts_decode_to_the_same_ids(part, monkeypatch):
    monkeypatch.setattr(token_output, "PART", part)
    rng = np.random.default_rng(3)
    tokens = np.array([0, 1, 255, 256, 257, 5000, 0, 40, 1024, 3])
    ids = rng.zipf(1.4, tokens.sum()).clip(0, 900).astype(np.uint32)
    lengths = token_output.code_lengths(np.bincount(ids))
    data, offsets = token_output.coded_block(ids, tokens, lengths, token_output.canonical(lengths))
    _, sizes = token_output.lanes(tokens)
    assert len(offsets) == len(sizes)
    table, longest = token_output.decode_table(lengths)
    assert np.array_equal(token_output.unpack(data, offsets, sizes, table, longest), ids)


def test_repeated_ids_are_spread(spark):
    """Rows of one id fill several parts, and all come back."""
    df = spark.range(0, 4000, 1, 4).selectExpr("cast(1 AS long) AS doc_id", "'the same words' AS text")
    file = public_tokenizers.path("word_bpe_49k.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be joined
    try:
        path = token_output.write_tokens(df, file, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 1
    got = token_output.read_tokens(spark, path).collect()
    ids = ids_of(file).packed("the same words") + (2).to_bytes(4, "little")
    assert len(got) == 4000 and {bytes(r["ids"]) for r in got} == {ids}
    assert sorted(r["start"] for r in got) == list(range(0, 4000 * len(ids) // 4, len(ids) // 4))
