"""Calls read as requests, and the evaluation from code to verdicts."""

import json

import pytest
from pyspark.sql import functions as F

from callgauge.functions import calls
from callgauge.operators import generation
from callgauge.plans import evaluate


def test_requests_of_calls():
    got = calls.request_of("""axios.post(`https://h/${a.b[1]}` + '/x?q=1&e=&q=2', {n: -1.5, 'k': [true, null, `t`], s, ...more}, {headers: {A: "it\\'s"}, params: {q: 9}})""", {"a": {"b": [0, 7]}, "more": {"z": 1}})
    assert got["url"] == "https://h/7/x" and got["params"] == {"q": "2", "e": True} and got["headers"] == {"A": "it's"}
    assert got["data"] == {"n": -1.5, "k": [True, None, "t"], "s": "${s}", "z": 1}
    assert calls.request_of("axios({url: 'u', method: 'PUT', data: 'a=1&b[]=2'})") == {"url": "u", "method": "put", "headers": {}, "params": {}, "data": {"a": "1", "b": ["2"]}}
    assert calls.request_of("await axios.get('u' + 1)")["url"] == "u1" and calls.request_of("axios.get(`u${8}`)")["url"] == "u8"
    for bad in ("fetch('u')", "axios.get('u', {a: })", "axios.get('u', {a 1})", "axios.get(#)"):
        with pytest.raises(ValueError):
            calls.request_of(bad)


def test_evaluation(spark, sf_dir):
    rows = {r["sample_id"]: r for r in evaluate.request_evaluation(spark, sf_dir).collect()}
    assert [rows[i]["verdict"] for i in range(8)] == ["correct", "illegal", "wrong", "illegal", "correct", "illegal", "nonexecutable", "nonexecutable"]
    assert [rows[i]["error"] for i in (6, 7)] == ["timeout", "no_request"] and rows[5]["url"] == "nonexistent_endpoint" and rows[3]["method"] == "nonexistent_method"
    facts = {(r["sample_id"], r["key"]): r["verdict"] for r in evaluate.request_arguments(spark, sf_dir).collect()}
    assert facts[1, "$limit"] == "incorrect_value" and facts[1, "tags"] == "unnecessary_key" and facts[1, "page"] == "illegal_key" and facts[0, "$limit"] == "correct" and facts[6, "$limit"] == "missing_key"


def test_generation(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "idx int, prompt string")
    out = generation.generated(prompts, lambda: lambda held: [h.upper() for h in held], repetitions=2).orderBy("idx", "repetition").collect()
    assert [(r["idx"], r["repetition"], r["output"]) for r in out] == [(1, 0, "A"), (1, 1, "A"), (2, 0, "B"), (2, 1, "B")]


def test_variables_of_tasks(spark):
    df = spark.createDataFrame([("axios.get(u)", json.dumps({"u": "https://h"})), ("axios.get(u)", None), (None, None)], "c string, v string")
    got = [r["r"]["url"] for r in df.select(calls.captured(F.col("c"), F.col("v")).alias("r")).collect()]
    assert got == ["https://h", "${u}", None]


def test_retrieval_of_endpoints(spark, sf_dir):
    from callgauge.plans import retrieve

    first = {r["task_id"]: r["method"] for r in retrieve.spec_retrieval(spark, sf_dir).filter("rank = 1").collect()}
    assert first == {0: "delete", 1: "get", 2: "post"}
    held = {r["task_id"]: r["context"] for r in retrieve.spec_context(spark, sf_dir).collect()}
    assert held[2].startswith("// POST /items") and all(len(c) <= 311 for c in held.values())
    rows = retrieve.spec_endpoints(spark, sf_dir).collect()
    assert len(rows) == 6 and "$limit [required | in: query | type: integer] how many" in rows[0]["content"]


def test_masks(spark):
    from callgauge.operators import constraints

    rules = [constraints.Rule("digits", "<", ">", r"\d+>")]
    df = spark.createDataFrame([("a", ["1", "x", ">", "$"], [0.1, 0.9, 0.5, 0.2]), ("a<", ["1", "x", ">", "$"], [0.1, 0.9, 0.5, 0.2]), ("a<x", ["1", "x", ">", "$"], [0.1, 0.9, 0.5, 0.2])], "t string, n array<string>, s array<double>")
    low = float("-inf")
    got = [r["m"] for r in df.select(constraints.masked(rules, F.col("t"), F.col("n"), F.col("s"), 2, 3).alias("m")).collect()]
    assert got == [[0.1, 0.9, 0.5, 0.2], [0.1, low, low, low], [low, low, low, 0.2]]
    assert constraints.allowed(rules, [(True, 2)], "a<", [(0, "1")], 1, -1.0) == ([], True)


def test_each_sample_is_held_against_its_own_api(spark, sf_dir):
    """Two descriptions share a path and a host: other legal arguments, and of equal templates the first declared."""
    facts, samples = evaluate.evaluated(*evaluate.tasks(spark), evaluate.descriptions(spark))
    got = {(r["sample_id"], r["location"], r["key"]): r["verdict"] for r in facts.collect()}
    assert got[8, "params", "page"] == "unnecessary_key" and got[8, "params", "tags"] == "illegal_key" and got[8, "params", "$limit"] == "correct"
    assert got[1, "params", "page"] == "illegal_key" and got[1, "params", "tags"] == "unnecessary_key"
    assert got[9, "path_params", "a"] == "correct" and (9, "path_params", "b") not in got
    micro = {r["location"]: r for r in evaluate.metrics.micro_metrics(evaluate.settled(facts, samples)).collect()}
    assert micro["params"]["n_illegal"] == 2 and micro["params"]["n_all_total"] > micro["params"]["n_all"]


def test_samples_with_an_error_keep_what_was_expected(spark):
    """Only expected arguments count; a special header alone leaves a row of zeros, which an executable sample hasn't."""
    from callgauge.operators import metrics, verdicts

    rows = [
        (1, "headers", "Accept", "correct", None), (1, "params", "a", "correct", None), (2, "headers", "Accept", "missing_key", "timeout"), (2, "params", "a", "missing_key", "timeout"),
        (2, "params", "b", "illegal_key", "timeout"), (3, "headers", "X", "correct", None), (3, "headers", "Y", "missing_key", None),
    ]
    args = spark.createDataFrame(rows, "sample_id int, location string, key string, verdict string, error string")
    counts = verdicts.sample_counts_and_owed(args.drop("error"), verdicts.is_special()).join(args.select("sample_id", "error").distinct(), "sample_id")
    held = metrics.settled(counts)
    got = {(r["sample_id"], r["location"]): (r["n_all"], r["n_expected"], r["n_missing"], r["n_illegal"]) for r in held.collect()}
    assert got == {(1, "params"): (1, 1, 0, 0), (1, "all"): (1, 1, 0, 0), (2, "headers"): (0, 0, 0, 0), (2, "params"): (1, 1, 1, 0), (2, "all"): (1, 1, 1, 0), (3, "headers"): (2, 2, 1, 0), (3, "all"): (2, 2, 1, 0)}
    macro = {r["location"]: r for r in metrics.macro_metrics(held).collect()}
    assert macro["headers"]["recall_executable"] == 0.5 and macro["headers"]["recall_total"] == 0.25  # the zeros count in the mean over all
    assert macro["params"]["recall_executable"] == 1.0 and macro["params"]["recall_total"] == 0.5 and macro["params"]["precision_total"] == 1.0


def test_a_second_name_of_an_endpoint(spark):
    df = spark.createDataFrame([("/v1/emoticons", ["/v1/emotes"]), ("/v1/emoticons", ["/v1/x"]), ("/v1/emotes", ["/v1/emoticons"]), (None, [])], "w string, c array<string>")
    assert [r["a"] for r in df.select(evaluate._aliases(F.col("w"), F.col("c")).alias("a")).collect()] == [True, False, False, False]
