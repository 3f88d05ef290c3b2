"""Plain re-tellings, by other means, of what operators 1, 6, 8 and 10 compute."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import EDGES, lcs, prose, text

from callgauge.llm import ctph, license_scan, quality, queries


def test_op1_sizes_and_sums(spark, sf_dir):
    texts = {r["doc_id"]: text(r["text"]).encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op1_sharding(spark, sf_dir).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out} == {(i, len(t) + 16, zlib.crc32(t), "rows", None) for i, t in texts.items()}
    per = {k: sorted(r["slot"] for r in out if r["shard"] == k) for k in range(40)}
    assert all(s == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1


def signature(data, size, hashes):
    """A letter a chunk, byte by byte."""
    out, chunk = "", b""
    for at, b in enumerate(data):
        chunk += bytes([b])
        if hashes[at] % size == size - 1 and len(out) < ctph.LENGTH - 1:
            out, chunk = out + ctph.LETTERS[zlib.crc32(chunk) & 63], b""
    return out + (ctph.LETTERS[zlib.crc32(chunk) & 63] if chunk else "")


def slow_fingerprint(t):
    data = t.encode()
    hashes = []
    for at in range(len(data)):
        h = sum(int(ctph.TABLES[k][data[at - k]]) for k in range(min(ctph.WINDOW, at + 1))) & 0xFFFFFFFF
        hashes.append(h ^ h >> 15)
    size = ctph.LEAST
    while size * ctph.LENGTH < len(data):
        size *= 2
    while size > ctph.LEAST and sum(h % size == size - 1 for h in hashes) + 1 < ctph.LENGTH // 2:
        size //= 2
    return size, signature(data, size, hashes), signature(data, 2 * size, hashes)


def slow_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for s, m in ((a[1], a[0]), (a[2], 2 * a[0])):
        for t, n in ((b[1], b[0]), (b[2], 2 * b[0])):
            k = min(ctph.WINDOW, max(1, min(len(s), len(t)) // 2))
            if m == n and s and t and any(s[i : i + k] in t for i in range(len(s) - k + 1)):
                best = max(best, 1 - (len(s) + len(t) - 2 * lcs(s, t)) / (len(s) + len(t)))  # insertions and deletions over the lengths
    return best


def test_op6_fingerprints_and_likeness(spark):
    rnd = random.Random(3)
    texts = [prose(k, rnd.choice([0, 1, 5, 40, 200, 500])) for k in range(40)]
    texts += [t[: len(t) // 2] + " changed " + t[len(t) // 2 :] for t in texts[:20]] + [t for _, t in EDGES if t and len(t) < 5000]
    rnd.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in ctph.compare_with_next(rows).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    shown = lambda p: ":".join(map(str, p))
    for i, t in enumerate(texts):
        n = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        e = slow_fingerprint(t[: len(t) - q] + n[:q])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (shown(prints[i]), shown(e))
        assert got[i]["near_next"] == pytest.approx(slow_likeness(prints[i], prints[(i + 1) % len(texts)]))
        assert got[i]["near_edited"] == pytest.approx(slow_likeness(prints[i], e))


def test_op8_discriminant(spark):
    """The posterior by densities written out, over the same statistics."""
    rows = [(k, prose(k, 20 + k % 50) if k % 3 else prose(k, 30).upper() + " $$ 12") for k in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    x = np.array([quality.statistics(t) for _, t in rows])
    y = np.array([int(k % 3 > 0) for k in range(300)])
    learn = np.array([zlib.crc32(str(k).encode()) % 5 != 0 for k in range(300)])
    own = [np.cov(x[learn & (y == c)].T, bias=True) for c in (0, 1)]
    count = [int((learn & (y == c)).sum()) for c in (0, 1)]
    pooled = (own[0] * count[0] + own[1] * count[1]) / sum(count)
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    logs = []
    for c in (0, 1):
        cov = ((1 - quality.SHRINK) * own[c] + quality.SHRINK * pooled) / np.outer(unit, unit)
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.eye(len(unit))
        z = (x - x[learn & (y == c)].mean(0)) / unit
        logs.append(math.log(count[c] / sum(count)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose([got[k] for k in range(300)], want, atol=1e-6)


def test_op10_labels_and_scores(spark):
    """Every template laid at every place where its key phrase stands."""
    rnd = random.Random(8)
    pool = [t.words for t in license_scan.TEMPLATES] + [t.key for t in license_scan.TEMPLATES] + ["the", "license", "under", "public", "cc by", "version 3", "of", "Mit", "GNU"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in license_scan.scan_licenses(df).withColumn("labels", F.array_sort(F.array_distinct("matches.label"))).collect():
        words, want = re.findall("[a-z0-9]+", texts[r["doc_id"]].lower()), []
        for t in license_scan.TEMPLATES:
            whole, key = t.words.split(), t.key.split()
            lead = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
            for at in range(len(words) - len(key) + 1):
                if words[at : at + len(key)] == key:
                    agree = sum(0 <= at - lead + i < len(words) and words[at - lead + i] == w for i, w in enumerate(whole))
                    want.append((at - lead, t.label, agree / len(whole)))
        assert sorted((m["start"], m["label"], m["share"]) for m in r["matches"]) == sorted(want)
        assert r["labels"] == sorted({x for _, x, _ in want})
