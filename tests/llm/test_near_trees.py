"""The candidates of the near-dedup come from vantage-point trees over SimHash fingerprints."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_near_copies import prose

from callgauge.llm import near_copies, simhash
from callgauge.llm.common import Scratch


def groups(items, near):
    """Each of ``items`` with the smallest that it reaches."""
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in items}


@pytest.mark.parametrize("leaf", [30, 1 << 14])
def test_fingerprints_within_three_bits_propose_their_texts(spark, monkeypatch, leaf):
    """Against brute force: texts with two fingerprints each, many of them some bits from another's; a leaf of 30 makes cuts and blocks."""
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 64, (500, 2), dtype=np.uint64)
    for k in range(250, 500):
        flipped = rng.choice(64, int(rng.integers(0, 6)), replace=False).astype(np.uint64)
        prints[k, k % 2] = prints[rng.integers(0, k), k % 2] ^ np.bitwise_xor.reduce(np.uint64(1) << flipped)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(near_copies, "BANDS", 1)
    rows = [(b"%04d" % k, 10, p.view(np.int64).tolist()) for k, p in enumerate(prints)]
    marks = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in rows], "node binary, n long, keys array<long>").repartition(3)
    with Scratch(spark) as scratch:
        got = [(bytes(r["a"]), bytes(r["b"])) for r in near_copies.candidates(marks, 0.8, scratch).collect()]
    close = (np.bitwise_count(prints[:, None] ^ prints[None]) <= 3).any(2)
    names = [r[0] for r in rows]
    want = groups(names, [(names[i], names[j]) for i, j in np.argwhere(close) if i != j])
    assert len(set(want.values())) < 450 and groups(names, got) == want


def test_whole_texts_within_the_radius_meet_without_a_short_fingerprint(spark, monkeypatch):
    """The short fingerprints are made random; whole texts' own, a bit or two apart, still find the copies."""

    def strange(hashes):
        return np.random.default_rng(hashes[:4].tolist() + [len(hashes)]).integers(0, 1 << 64, near_copies.BANDS, dtype=np.uint64)

    monkeypatch.setattr(near_copies, "short_prints", strange)
    rnd, rows, want = random.Random(5), [], set()
    while len(want) < 12:
        w, k = prose(rnd, 300), 2 * len(want)
        a, b = " ".join(w), " ".join([*w, "more"])
        p, q = (simhash.majority(np.unique(simhash.shingle_hashes(t, 5))) for t in (a, b))
        if 1 <= (p ^ q).bit_count() <= 3:
            rows += [(k, a), (k + 1, b)]
            want.add(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.one_of_near(spark, df, "").collect()} == want
