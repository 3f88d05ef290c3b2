"""Groups of near copies that are larger than a block, against brute-force Jaccard similarity; recall of the short fingerprints."""

import random

import numpy as np
from test_near_copies import kept, left, prose

from callgauge.llm import near_copies


def drifting(rnd, n, steps):
    """A chain of texts, each an edit of an earlier one, so that first and last need not be alike."""
    texts = [prose(rnd, n)]
    for _ in range(steps):
        w = list(rnd.choice(texts[-6:]))
        for _ in range(rnd.randint(1, 2)):
            w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        texts.append(w)
    return [" ".join(w) for w in texts]


def test_groups_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEMBERS", 8)
    rnd = random.Random(12)
    base = prose(rnd, 120)
    copies = [" ".join([*base, f"end{k}"]) for k in range(60)]
    texts = copies + drifting(rnd, 100, 60) + drifting(rnd, 60, 30) + [" ".join(prose(rnd, 80)) for _ in range(30)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    texts = [texts[k] for k in order]
    want = left(texts)
    assert 35 < len(want) < 130 and kept(spark, texts) == want


def test_pairs_at_the_similarity_share_a_fingerprint():
    rng, missed, tried = np.random.default_rng(5), 0, 0
    for n in (10, 50, 200):
        for _ in range(1000):
            h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            both = int(np.ceil(0.8 * n))
            side = both + (n - both) // 2
            a, b = np.unique(h[:side]), np.unique(np.concatenate([h[:both], h[side:]]))
            missed += not (near_copies.short_prints(a) == near_copies.short_prints(b)).any()
            tried += 1
    assert missed / tried < 0.003  # 3.6e-4 by the formula


def test_equal_rows_and_nulls_in_large_numbers(spark):
    """A third of all rows with one text, a third null: one row of each stays."""
    rnd = random.Random(1)
    own = [" ".join(prose(rnd, 20)) for _ in range(300)]
    texts = [t for k in range(300) for t in ("one and the same text of seven words", None, own[k])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in near_copies.keep_one(df).collect()}
    assert got == {0, 1} | {3 * k + 2 for k in range(300)}
