"""Cross-checks of task sets, logs and batches, labels of reports, and retrieval by injected models."""

import json

import pytest
from pyspark.sql import functions as F

from callgauge.functions import forms
from callgauge.operators import prompts, reporting, retrieval
from callgauge.plans import crosscheck
from callgauge.sources import files


def values(spark, column, rows):
    return [r["v"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", column.alias("v")).orderBy("i").collect()]


def test_instructions_of_chat_models(spark):
    assert values(spark, prompts.extra_instruction(F.col("x")), ["a/b-Instruct-7b", "openai/x", "google/y", "a/openai/", "b"]) == [prompts.CHAT_EXTRA] * 3 + ["", ""]


def test_labels(spark):
    def broken(s, threshold):
        i = s.find(" ", len(s) // 3)
        return s if len(s) <= threshold or i < 0 else s[:i] + "\n" + s[i + 1 :]

    labels = ["short", "a label of some words", "one twothreefour", "nospaceinthislabelatall", "x y z w v u t", " "]
    assert values(spark, reporting.broken_label(F.col("x"), 8), labels) == [broken(s, 8) for s in labels]
    assert values(spark, reporting.rotated(F.col("x")), ["Endpoint vanilla"]) == [r"\makebox[20pt][l]{\rotatebox{45}{endp. UD}}"]
    assert values(spark, reporting.shortened(F.col("x")), ["Mean argument Jaccard"]) == ["Mean arg. Jaccard"]


def test_logs_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "0001_code.js", "m\n", "out", 0), (0, "0000_code.js", "no call", None, None)], "idx int, f string, m string, o string, x int")
    held = df.withColumn("entry", files.log_entry(F.col("f"), F.col("m"), F.col("o"), F.col("x")))
    files.write_log(held, f"file://{tmp_path}/log")
    text = "".join(p.read_text() for p in sorted(tmp_path.glob("log/part-*")))
    assert text == "\n### Now processing 0000_code.js ###\nno call\n\n### Now processing 0001_code.js ###\nm\nout\nExit code: 0\n"
    files.write_batch(spark.createDataFrame([(7, "hi")], "custom_id int, prompt string"), f"file://{tmp_path}/batch", "m", max_tokens=5)
    lines = [json.loads(x) for p in tmp_path.glob("batch/part-*") for x in p.read_text().splitlines()]
    assert lines == [{"custom_id": "7", "method": "POST", "url": "/v1/chat/completions", "body": {"model": "m", "messages": [{"role": "user", "content": "hi"}], "max_tokens": 5}}]


def test_task_sets_are_written_if_right(spark, sf_dir, tmp_path):
    protocols = crosscheck.task_check(spark, sf_dir)
    tasks = spark.range(3)
    assert not crosscheck.write_if_right(tasks, protocols, f"file://{tmp_path}/t") and not (tmp_path / "t").exists()
    assert crosscheck.write_if_right(tasks, protocols.filter("protocol = 'OK'"), f"file://{tmp_path}/t") and spark.read.json(f"file://{tmp_path}/t").count() == 3


def test_a_hostile_form(spark):
    with pytest.raises(ValueError):
        forms.decoded("a[999999999]=x")
    assert values(spark, forms.body_json(F.col("x")), ["a[3]=x", "a[999999999]=x"]) == ['{"a": [null, null, null, "x"]}', None]


def test_injected_models(spark):
    def load():
        return lambda texts: [[float(t.count(c)) for c in "abc"] for t in texts]

    rows = spark.createDataFrame([(1, "aab"), (2, "c"), (3, "")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in retrieval.embedded(rows, load, "id", "t").collect()}
    assert got == {1: [2.0, 1.0, 0.0], 2: [0.0, 0.0, 1.0], 3: [0.0, 0.0, 0.0]}
    pairs = spark.createDataFrame([("a", "aa", 0.1), ("b", "aa", 0.9)], "q string, c string, score double")
    again = retrieval.reranked(pairs, lambda: lambda texts: [float(c.count(q)) for q, c in texts], "q", "c").collect()
    assert {(r["q"], r["score"]) for r in again} == {("a", 2.0), ("b", 0.0)}
    both = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r["v"] for r in both.select(retrieval.cosine(F.col("a"), F.col("b")).alias("v")).collect()] == [1.0, 0.0]


def test_best_by_scan_and_by_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 13}" for j in range(1, 9))) for k in range(60)] + [(99, None), (98, "")], "d long, t string").repartition(3)
    queries = spark.createDataFrame([(k, f"w{k} w{2 * k} zz") for k in range(6)] + [(7, "")], "q long, t string")
    args = docs, queries, "d", "q", F.col("t"), F.col("t")
    scan = [retrieval.cfidf_topk(*args, 5), retrieval.containment_topk(*args, 5)]
    scan = [sorted(map(tuple, x.collect())) for x in scan]
    monkeypatch.setattr(retrieval, "FITS", 3)
    joins = [sorted(map(tuple, x.collect())) for x in (retrieval.cfidf_topk(*args, 5), retrieval.containment_topk(*args, 5))]
    assert scan == joins and len(scan[0]) > 10
    pairs = spark.createDataFrame([(1, 5), (2, 6), (7, 1)], "q long, d long")
    some = {(r["q"], r["d"]): r["containment"] for r in retrieval.containment(*args, pairs).collect()}
    every = {(r["q"], r["d"]): r["containment"] for r in retrieval.containment(*args).collect()}
    assert some == {k: v for k, v in every.items() if k in {(1, 5), (2, 6), (7, 1)}}


def test_endpoints_by_injected_models(spark):
    """A bag-of-letters embedder finds the text that it is given, a scorer turns the order round; the wrap names title and server."""
    from callgauge.plans import retrieve
    from callgauge.plans import specs as mini
    from callgauge.sources import specs

    own = mini.mini(spark).filter("spec = 'mini'")
    texts = specs.documents(own).filter("error IS NULL").select("path", "method", "content").collect()
    tasks = spark.createDataFrame([(i, t["content"]) for i, t in enumerate(texts)], "task_id long, task string")
    letters = "abcdefghijklmnopqrstuvwxyz{}/: "

    def embed():
        return lambda held: [[float(t.lower().count(c)) for c in letters] for t in held]

    first = {r["task_id"]: (r["path"], r["method"]) for r in retrieve.found_by_vectors(tasks, own, embed, 2).filter("rank = 1 AND score = 0").collect()}
    assert all(first[i] == (t["path"], t["method"]) for i, t in enumerate(texts) if sum(x["content"] == t["content"] for x in texts) == 1)
    again = retrieve.found_by_vectors(tasks.limit(1), own, embed, 3, lambda: lambda pairs: [-float(len(c)) for _, c in pairs]).orderBy("rank").collect()
    assert [r["rank"] for r in again] == [1, 2, 3] and [r["score"] for r in again] == sorted((r["score"] for r in again), reverse=True)
    told = retrieve.wrapped(retrieve.found_by_vectors(tasks.limit(1), own, embed, 2), own).first()["context"]
    assert told.startswith("title:") and "server_url: https://shop.example.com/v1" in told
    cut = retrieve.wrapped(retrieve.found_by_vectors(tasks.limit(1), own, embed, 2), own, 30).first()["context"]
    assert cut == told[:30] + retrieve.CUT
