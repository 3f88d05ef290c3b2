"""Edges of single operators, against values worked out by hand."""

import json

import yaml
from pyspark.sql import functions as F

from callgauge.functions import forms, jsons, openapi
from callgauge.functions import text as fn
from callgauge.operators import constraints, metrics, prompts, reporting, retrieval, urls, verdicts
from callgauge.plans import specs as mini
from callgauge.sources import files, specs
from callgauge.streaming import batch_state


def one(spark, expr, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(expr.alias("v")).first()["v"]


def test_verdicts_of_arguments(spark):
    keys = ["sample_id", "location", "key"]
    kind = "sample_id int, location string, key string, value string"
    e = spark.createDataFrame([(1, "data", "a", "1"), (1, "data", "b", "2"), (1, "data", "c", "3")], kind)
    a = spark.createDataFrame([(1, "data", "a", "1"), (1, "data", "b", "9"), (1, "data", "d", "4"), (1, "data", "x", "5")], kind)
    legal = spark.createDataFrame([(1, "data", "d")], "sample_id int, location string, key string")
    got = {r["key"]: r["verdict"] for r in verdicts.compare_arguments(e, a, legal, keys).collect()}
    assert got == {"a": "correct", "b": "incorrect_value", "c": "missing_key", "d": "unnecessary_key", "x": "illegal_key"}


def test_sample_without_arguments_follows_its_endpoint(spark):
    v = verdicts.sample_verdict(F.col("e"), F.col("p"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    assert one(spark, v, e=None, p="correct") == "correct"
    assert one(spark, v, e=None, p="illegal") == "illegal"
    assert one(spark, v, e="timeout", p="correct") == "nonexecutable"


def test_execution_verdicts(spark):
    def v(code, call="x", complete=True, exit_code=0):
        return one(spark, verdicts.execution_verdict(F.col("c"), F.lit(call).cast("string"), F.lit(complete), F.lit(exit_code)), c=code)

    assert v("a //timeout\n") == "timeout" and v("a//unsatisfiable_constraints") == "unsatisfiable"
    assert v("a", call=None) == "no_request" and v("a", complete=False) == "incomplete_request" and v("a", exit_code=1) == "runtime_error" and v("a") is None


def test_ratios_of_no_samples(spark):
    none = spark.createDataFrame([], "verdict string, endpoint string")
    row = metrics.verdict_ratios(none).first()
    assert row["samples_total"] == 0 and row["samples_correct_wrt_total"] is None and row["samples_correct_wrt_executable"] == 0.0


def test_invariants_are_broken_where_counts_are(spark):
    counts = spark.createDataFrame([(2, 1, 0, 0, 1, 2, 0, 0)], ", ".join(f"n_{c} int" for c in verdicts.COUNTERS))
    broken = {r["law"]: r["broken"] for r in metrics.violations(counts).collect()}
    assert broken["all_is_expected_and_unexpected"] == 1 and broken["right_values_have_right_names"] == 1 and broken["expected_is_named_and_missing"] == 0


def test_templates(spark):
    paths = spark.createDataFrame([(1, "/a/b"), (2, "/a/x:append"), (3, "/a/b/c"), (4, "/a/"), (5, "/a/b&c")], "id int, path string")
    templates = spark.createDataFrame([(0, "/{x}/{y}"), (1, "/a/{y}"), (2, "/a/b"), (3, "/a/{y}:append")], "ordinal int, template string")
    found = urls.match_templates(paths, templates, ["id"])
    best = {r["id"]: r["template"] for r in urls.best_template(found, ["id"]).collect()}
    assert best == {1: "/a/b", 2: "/a/{y}:append"}
    assert {r["template"] for r in found.filter("id = 2").collect()} == {"/{x}/{y}", "/a/{y}", "/a/{y}:append"}


def test_servers_in_order(spark):
    u = spark.createDataFrame([(1, "https://h/v1/a"), (2, "https://h"), (3, "http://other/")], "id int, url string")
    s = spark.createDataFrame([(0, ""), (1, "https://h/v1"), (2, "https://h")], "ordinal int, server string")
    assert {r["id"]: r["rest"] for r in urls.strip_server(u, s, ["id"]).collect()} == {1: "/a", 2: "", 3: None}


def test_url_decoding_and_queries(spark):
    assert one(spark, urls.url_decoded(F.col("u")), u="a+b%20c") == "a+b c" and one(spark, urls.url_decoded(F.col("u")), u="100%") == "100%"
    u = spark.createDataFrame([(1, "https://h/p?a=1&b=&a=2&c#x?d=1")], "id int, url string")
    assert {(r["name"], r["value"]) for r in urls.query_parameters(u, ["id"]).collect()} == {("a", "2"), ("b", "true"), ("c", "true")}


def test_api_specific_urls(spark):
    f = urls.api_specific(F.col("u"))
    assert one(spark, f, u="https://api.telegram.org/bot123:x/getMe") == "https://api.telegram.org/bot{token}/getMe"
    assert one(spark, f, u="https://api.etherscan.io/api?module=a&x=1&action=b") == "https://api.etherscan.io/api?module=a&action=b"
    assert one(spark, f, u="https://api.etherscan.io/api?x=1") == "https://api.etherscan.io/api?x=1"


def test_canonical_json(spark):
    c = lambda t, strict=False: one(spark, jsons.canonical(F.col("t"), strict), t=t)
    assert c('{"b": 1.0, "a": [true, 1e0]}') == '{"a":[true,1],"b":1}' == c('{"a":[true,1],"b":1}')
    assert c("true", True) == "1" and c("{") is None and c('"é"') == '"é"'
    assert one(spark, jsons.unwrapped(F.col("t")), t="[1]") == "1" and one(spark, jsons.unwrapped(F.col("t")), t="[1,2]") == "[1,2]"


def test_text_functions(spark):
    assert one(spark, F.array_join(F.transform(fn.tokens(F.col("t")), fn.stem), " "), t="Running runs bed ringed as X-ray's") == "runn run bed ring as x ray s"
    assert one(spark, fn.trigrams(fn.trigram_text(F.col("t"))), t="Ab, c") == ["ab ", "b c"] and one(spark, fn.trigrams(F.col("t")), t="ab") == []
    assert one(spark, fn.type_name(F.lit(None).cast("string"), F.lit("get"), F.col("t")), t="/a-b/{id}/cD") == "GetABCDRequest"
    assert one(spark, fn.truncate_lines(F.col("t"), 5), t="ab\ncdef") == "ab\n[TRUNCATED]" and one(spark, fn.truncate_lines(F.col("t"), 5), t="abcdefg") == "abcde[TRUNCATED]"
    assert one(spark, fn.inline_comment(F.col("t"), 10), t="first line that goes on") == "first"
    assert one(spark, fn.literal(F.col("t")), t='say "x"') == '"say \\"x\\""' and one(spark, fn.literal(F.col("t")), t="-1.5") == "-1.5"
    assert one(spark, fn.property_name(F.col("t")), t="a-b") == '"a-b"'


def test_prompts(spark):
    a, b = prompts.split_prompt(F.col("t"))
    assert one(spark, a, t="x\n* a\n* b\nrest") == "x\n* a\n* b" and one(spark, b, t="x\n* a\n* b\nrest") == "rest" and one(spark, a, t="x") == ""
    built = prompts.instantiate("{task} {api}", {"task": F.col("t"), "api": F.lit("A")})
    assert one(spark, built, t="use {api}") == "use {api} A"
    call, complete = prompts.extract_call(F.col("t"))
    assert one(spark, call, t="// x\naxios.get(f(1)).then()") == "axios.get(f(1))" and one(spark, complete, t="\n  axios.get(1)") is False
    assert one(spark, call, t="let a = axios.get(1);") is None


def test_reports(spark):
    t = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.5, 1.0), ("c", None, 1.0)], "m string, x double, y double")
    g = reporting.gains(t, "x", "y")
    assert {r["m"]: r["gain"] for r in g.collect()} == {"a": None, "b": 1.0}
    assert {r["m"]: r["gain"] for r in reporting.summary_rows(g, "m", ["x", "y", "gain"]).collect()}["Average"] == 1.0
    long = spark.createDataFrame([("m", 1.0), ("m", 1.0), ("m", None), ("m", 0.5)], "metric string, value double")
    assert [r["best"] for r in reporting.best_flags(long, "metric", "value", F.lit(False)).collect()].count(True) == 2
    assert r"\textbf{1.00}" in reporting.latex(t.filter("m = 'b'"), "m", ["x", "y"])
    runs = spark.createDataFrame([(1, 2.0), (2, 0.0), (2, 0.0)], "k int, v double")
    got = {r["k"]: r for r in reporting.runtime_statistics(runs, ["k"], "v", F.lit(10)).collect()}
    assert got[1]["stdev"] == 0.0 and got[1]["rate"] == 5.0 and got[2]["rate"] == 0.0


def test_idf_below_zero_and_cosine(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d")], "d int, t string")
    q = spark.createDataFrame([(9, "b"), (8, "zzz"), (7, "")], "q int, t string")
    got = retrieval.cfidf_scores(docs, q, "d", "q", F.col("t"), F.col("t")).collect()
    assert [(r["q"], r["d"]) for r in got] == [(9, 1)]
    weights = {r["term"]: r["idf"] for r in retrieval.idf(retrieval.document_frequencies(retrieval.term_frequencies(docs, "d", F.col("t"))), 3).collect()}
    assert weights["a"] < 0 < weights["b"]


def test_vectors_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    a = retrieval.vector_topk(v.filter("vec_id % 10 = 0"), v, 4, block=2).collect()
    b = retrieval.vector_topk(v.filter("vec_id % 10 = 0"), v, 4).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 24


def test_references(spark):
    root = {"c": {"A": {"$ref": "#/c/B"}, "B": {"$ref": "#/c/C"}, "C": {"type": "array", "items": {}}, "L": {"x": {"$ref": "#/c/L"}}, "a/b~c": 1}}
    assert openapi.inlined({"$ref": "#/c/A"}, root) == {"type": "C"}
    assert openapi.inlined({"$ref": "#/c/C", "k": 1}, root) == {"type": "C", "items": {}, "k": 1}
    assert root["c"]["C"]["type"] == "array"
    assert openapi.pointer(root, "#/c/a~1b~0c") == 1
    for bad in ("#/c/L", "other.yaml#/x", "#/none"):
        try:
            openapi.inlined({"$ref": bad}, root, levels=5)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert openapi.without_all_of({"allOf": [{"required": ["a"]}, {"required": ["b"], "x": {"y": 1}}], "x": {"z": 2}}) == {"required": ["a", "b"], "x": {"y": 1, "z": 2}}


def test_security_is_required_only_alone():
    spec = {"components": {"securitySchemes": {"a": {"type": "http", "description": "A"}, "b": {"type": "oauth2", "description": "B"}, "c": {"type": "openIdConnect"}, "k": {"type": "apiKey", "in": "query", "name": "k"}}}}
    alone = openapi.security_parameters(spec, {"security": [{"a": []}, {"b": []}, {"c": []}]})
    assert [(p["name"], p["description"], p["required"]) for p in alone] == [("Authorization", "A | B", True)]
    assert not any(p["required"] for p in openapi.security_parameters(spec, {"security": [{"a": [], "k": []}]}))


def test_broken_description_is_a_row(spark):
    rows = specs.operations(mini.mini(spark)).collect()
    assert sum(r["error"] is not None for r in rows) == 1 and len(rows) == 7


def test_every_snippet(spark, sf_dir):
    assert [r["intent"] for r in mini.constraint_match(spark, sf_dir).filter("NOT ok").collect()] == []


def test_rules_are_stable_and_partial():
    a, b = (constraints.Compiler(yaml.safe_load(mini.MINI)).rules() for _ in range(2))
    assert a == b
    get = next(r for r in a if r.name == "get")
    text = "axios.get('https://shop.example.com/v1/it"
    active, at = constraints.advance(get, False, 0, text)
    assert active and constraints.holds(get, at, text) and not constraints.holds(get, at, text + "x")
    assert constraints.match_code(a, text, partial=True) == "get"


def test_stream_is_the_automaton(spark, sf_dir):
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {}
    for r in mini.constraint_stream(spark, sf_dir).collect():
        got.setdefault(r["id"], {})[r["step"]] = (r["active"], r["valid"])
    import re

    for i, text in texts.items():
        state, valid, grown = [(r.starter is None, 0) for r in mini.PROSE], True, ""
        for step, token in enumerate(re.split("(?<= )", text)):
            grown += token
            state = [constraints.advance(r, *s, grown) for r, s in zip(mini.PROSE, state, strict=True)]
            valid = valid and all(constraints.holds(r, p, grown) for r, (on, p) in zip(mini.PROSE, state, strict=True) if on)
            assert got[i][step] == (any(on for on, _ in state), valid)


def test_batch_states():
    assert batch_state.step("absent", 0, "submit", 1)[0] == "absent"
    assert batch_state.step("submitted", 0, "result", 3600 * 25) == ("absent", 3600 * 25, True)


def test_forms(spark):
    assert forms.decoded("a[b][]=1&a[b][]=2&c[1]=x") == {"a": {"b": ["1", "2"]}, "c": [None, "x"]}
    body = '--x\r\nContent-Disposition: form-data; name="f"\r\n\r\nv\r\n--x--'
    assert json.loads(one(spark, forms.multipart_json(F.col("t")), t=body)) == {"f": "v"}


def test_tasks_and_index(spark, tmp_path):
    (tmp_path / "tasks.json").write_text(json.dumps([{"task": "a", "config": {"url": "u"}}, {"task": "b", "api": "own", "config": {}}]))
    rows = files.read_tasks(spark, f"file://{tmp_path}/tasks.json", "given").orderBy("idx").collect()
    assert [(r["idx"], r["api"], r["task"]) for r in rows] == [(0, "given", "a"), (1, "own", "b")] and json.loads(rows[0]["config"]) == {"url": "u"}
    path = f"file://{tmp_path}/index"
    assert files.open_index(spark, path, "1") is None
    files.write_index(spark.range(3), path, "1")
    assert files.open_index(spark, path, "1").count() == 3 and files.open_index(spark, path, "2") is None
    (tmp_path / "0007_config.json").write_text(json.dumps({"url": "x", "method": "get", "params": {"a": 1}}))
    (tmp_path / "readme.txt").write_text("x")
    assert [(r["idx"], r["params"]) for r in files.read_configs(spark, f"file://{tmp_path}").collect()] == [(7, '{"a":1}')]


def test_parameters_inside_a_segment(spark):
    """An action behind a parameter, two parameters in one segment, and pattern characters in a template."""
    m = spark.createDataFrame(
        [(1, "/v4/sheets/s1/values/A1:append", "/v4/sheets/{id}/values/{range}:append"), (2, "/a/x.y.json", "/a/{n}.{k}.json"), (3, "/a/b+c", "/a/{z}+c"), (4, "/a/b", "/a/b")], "id int, path string, template string"
    )
    got = {(r["id"], r["name"]): r["value"] for r in urls.path_parameters(m, ["id"]).collect()}
    assert got == {(1, "id"): "s1", (1, "range"): "A1", (2, "n"): "x", (2, "k"): "y", (3, "z"): "b"}


def test_templates_of_one_api_alone(spark):
    paths = spark.createDataFrame([(1, "p", "/a/b"), (2, "q", "/a/b")], "id int, api string, path string")
    templates = spark.createDataFrame([("p", 0, "/a/{x}"), ("q", 0, "/{y}/b")], "api string, ordinal int, template string")
    got = {r["id"]: r["template"] for r in urls.match_templates(paths, templates, ["id"], ("api",)).collect()}
    assert got == {1: "/a/{x}", 2: "/{y}/b"}
    u = spark.createDataFrame([(1, "p", "https://h/v1/a"), (2, "q", "https://h/v1/a")], "id int, api string, url string")
    s = spark.createDataFrame([("p", 0, "https://h"), ("q", 0, "https://h/v1")], "api string, ordinal int, server string")
    assert {r["id"]: r["rest"] for r in urls.strip_server(u, s, ["id"], ("api",)).collect()} == {1: "/v1/a", 2: "/a"}
