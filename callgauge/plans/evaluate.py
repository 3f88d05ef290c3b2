"""The whole evaluation: expected requests and generated code in, verdicts and metrics out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions import calls, jsons
from callgauge.operators import metrics, prompts, urls, verdicts
from callgauge.plans import evaluation
from callgauge.plans import specs as mini
from callgauge.plans.tables import table
from callgauge.sources import specs
from callgauge.sources.files import kept

LOCATIONS = ("headers", "params", "path_params", "data")
KEYS = ["sample_id", "location", "key"]


def requests(code: DataFrame) -> DataFrame:
    """``code`` (sample_id, spec, code) as captured requests: sample_id, spec, url, method, headers, params, data, error."""
    call, complete = prompts.extract_call(F.col("code"))
    held = code.select("sample_id", "spec", "code", call.alias("_call"), complete.alias("_complete"))
    read = held.select("*", calls.captured(F.col("_call")).alias("_r"))
    error = verdicts.execution_verdict(F.col("code"), F.col("_call"), F.col("_complete"), F.when(F.col("_r.error").isNotNull(), 1).otherwise(0))
    return read.select("sample_id", "spec", "_r.url", "_r.method", "_r.headers", "_r.params", "_r.data", error.alias("error"))


def located(sent: DataFrame, servers: DataFrame, templates: DataFrame) -> DataFrame:
    """``sent`` with candidates (the templates of its own API that its URL fits), best and path_params."""
    rest = urls.strip_server(sent.select("sample_id", "spec", urls.api_specific(F.col("url")).alias("url")).filter("url IS NOT NULL"), servers, ["sample_id"], ("spec",))
    fits = urls.match_templates(rest.select("sample_id", "spec", urls.path_part(F.col("rest")).alias("path")).filter("path IS NOT NULL"), templates, ["sample_id"], ("spec",))
    best = urls.best_template(fits, ["sample_id"])
    found = fits.groupBy("sample_id").agg(F.collect_set("template").alias("candidates"))
    filled = urls.path_parameters(best, ["sample_id"]).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.to_json(F.struct(F.col("value").alias("v"))).alias("_v")))).alias("_p"))
    values = F.transform_values("_p", lambda k, v: F.regexp_extract(v, r'(?s)^\{"v":(.*)\}$', 1))
    none = F.create_map().cast("map<string,string>")
    return (
        sent.join(found, "sample_id", "left").join(best.select("sample_id", F.col("template").alias("best")), "sample_id", "left")
        .join(filled.select("sample_id", values.alias("path_params")), "sample_id", "left").withColumn("path_params", F.coalesce("path_params", none))
    )


def arguments(sent: DataFrame) -> DataFrame:
    """KEYS and value (canonical JSON; outside of the body a list of one is its element); null fields are left out."""
    each = [F.transform(F.map_entries(F.coalesce(F.col(loc), F.create_map().cast("map<string,string>"))), _placed(loc)) for loc in LOCATIONS]
    held = sent.select("sample_id", F.explode(F.concat(*each)).alias("_x")).select("sample_id", "_x.*").filter("value IS NOT NULL AND value <> 'null'")
    plain = held.withColumn("value", jsons.canonical(F.col("value"), booleans_are_numbers=True))
    return plain.withColumn("value", F.when(F.col("location") == "data", F.col("value")).otherwise(jsons.unwrapped(F.col("value"))))


def _placed(location: str):
    def place(e: Column) -> Column:
        return F.struct(F.lit(location).alias("location"), e["key"].alias("key"), e["value"].alias("value"))

    return place


def evaluated(expected: DataFrame, code: DataFrame, descriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arguments with verdicts, samples with verdicts) of ``expected`` (sample_id, spec, a request's fields) and ``code`` (sample_id, code).

    Descriptions and code are read once, and the requests with their endpoints are kept in the shared folder; the rest is one
    plan over them. Each sample is held against the description that its ``spec`` names: servers, templates in declared order and legal arguments.
    """
    servers = kept(specs.servers(descriptions).filter("error IS NULL"), "servers")
    catalog = kept(specs.operations(descriptions).filter("error IS NULL").select("spec", "path", "method", "ordinal"), "operations")
    templates = catalog.groupBy("spec", "path").agg(F.min("ordinal").alias("ordinal"), F.collect_set("method").alias("methods"))
    listed = templates.select("spec", "ordinal", F.col("path").alias("template"))
    actual = kept(requests(code.join(expected.select("sample_id", "spec"), "sample_id")), "requests")
    want, got = kept(located(expected, servers, listed), "expected"), kept(located(actual, servers, listed), "actual")
    named = want.select("sample_id", "spec", F.col("best").alias("_want"), F.col("method").alias("_want_method"))
    legal = (
        specs.legal_arguments(descriptions).filter("error IS NULL").select("spec", F.col("path").alias("_want"), F.col("method").alias("_want_method"), "location", F.col("name").alias("key"))
        .join(named, ["spec", "_want", "_want_method"]).select(*KEYS).distinct()
    )
    ran = actual.filter("error IS NULL").select("sample_id")
    facts = verdicts.compare_arguments(arguments(want), arguments(got.join(ran, "sample_id", "left_semi")), legal, KEYS)
    counts = verdicts.sample_counts(verdicts.without_special(facts))
    offered = got.select("sample_id", "spec", F.explode("candidates").alias("path")).join(templates, ["spec", "path"]).groupBy("sample_id").agg(F.flatten(F.collect_list("methods")).alias("_offered"))
    side = named.join(got.select("sample_id", "candidates", "method", "error"), "sample_id").join(offered, "sample_id", "left")
    ends = side.select(
        "sample_id", "error", verdicts.url_verdict(F.col("_want"), F.col("candidates"), _aliases(F.col("_want"), F.col("candidates"))).alias("url"), verdicts.method_verdict(F.col("_want_method"), F.col("method"), F.col("_offered")).alias("method"),
    ).withColumn("endpoint", verdicts.endpoint_verdict(F.col("url"), F.col("method")))
    total = counts.filter("location = 'all'")
    verdict = verdicts.sample_verdict(F.col("error"), F.col("endpoint"), F.col("n_all"), F.col("n_correct_value"), F.col("n_illegal"))
    return facts, ends.join(total, "sample_id", "left").select("sample_id", "error", "url", "method", "endpoint", verdict.alias("verdict"), *[F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in verdicts.COUNTERS])


#: Fixed value: an endpoint that is known to be another one by a second name.
ALIASES = {"/v1/emoticons": "/v1/emotes"}


def _aliases(wanted: Column, candidates: Column) -> Column:
    """Whether a candidate is the second name of the wanted endpoint."""
    return F.coalesce(F.array_contains(candidates, F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), wanted)), F.lit(False))


def settled(facts: DataFrame, samples: DataFrame) -> DataFrame:
    """Counters a sample and location of evaluated()'s two results, as metrics.micro_metrics() and macro_metrics() take them."""
    counts = verdicts.sample_counts_and_owed(facts, verdicts.is_special())
    return metrics.settled(counts.join(samples.select("sample_id", "error"), "sample_id"))


#: expected request as JSON, generated code.
TASKS = [
    ({"url": "https://shop.example.com/v1/items", "method": "get", "params": {"$limit": 3, "api_key": "k"}}, "// c\naxios.get('https://shop.example.com/v1/items', {params: {api_key: 'k', $limit: 3.0}});"),
    ({"url": "https://shop.example.com/v1/items", "method": "get", "params": {"$limit": 3, "api_key": "k"}}, "// c\naxios.get('https://shop.example.com/v1/items?$limit=3', {params: {api_key: ['k'], tags: 'x', page: 1}});"),
    ({"url": "https://shop.example.com/v1/items/7", "method": "get", "params": {"api_key": "k"}}, "// c\naxios.get(`https://shop.example.com/v1/items/${8}`, {params: {api_key: 'k'}, headers: {Accept: 'x'}});"),
    ({"url": "https://shop.example.com/v1/items/7", "method": "delete", "headers": {"Authorization": "t"}}, "// c\naxios.put('https://shop.example.com/v1/items/7');"),
    ({"url": "https://shop.example.com/v1/items", "method": "post", "params": {"api_key": "k"}, "data": {"name": "a", "parts": [{"num": 1}]}}, "// c\naxios.post('https://shop.example.com/v1/items', {parts: [{num: 1}], name: 'a'}, {params: {api_key: 'k'}});"),
    ({"url": "https://shop.example.com/v1/items", "method": "post", "data": {"name": "a"}}, "// c\naxios.post('https://shop.example.com/v1/nothing', {name: 'a'});"),
    ({"url": "https://shop.example.com/v1/items", "method": "get", "params": {"$limit": 1}}, "// c\naxios.get('https://shop.example.com/v1/items', {params: {\n//timeout"),
    ({"url": "https://shop.example.com/v1/items", "method": "get"}, "let a = 1;"),
]


#: A second API with a path of the first one's, other arguments and the same host.
DEPOT = """
openapi: 3.0.0
servers: [{url: 'https://shop.example.com/v1'}]
paths:
  /items:
    get: {parameters: [{name: page, in: query, schema: {type: integer}}, {name: $limit, in: query, schema: {type: integer}}]}
  /items/{a}: {get: {parameters: [{name: a, in: path, required: true, schema: {type: string}}]}}
  /items/{b}: {get: {parameters: [{name: b, in: path, required: true, schema: {type: string}}]}}
"""
DEPOT_TASKS = [
    ({"url": "https://shop.example.com/v1/items", "method": "get", "params": {"$limit": 3}}, "// c\naxios.get('https://shop.example.com/v1/items', {params: {page: 1, tags: 'x', $limit: 3}});"),
    ({"url": "https://shop.example.com/v1/items/7", "method": "get"}, "// c\naxios.get('https://shop.example.com/v1/items/7');"),
]


def tasks(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    as_json = lambda d: {k: json.dumps(v) for k, v in (d or {}).items()}
    kind = "sample_id int, spec string, url string, method string, headers map<string,string>, params map<string,string>, data map<string,string>"
    held = [("mini", *t) for t in TASKS] + [("depot", *t) for t in DEPOT_TASKS]
    expected = spark.createDataFrame([(i, spec, e["url"], e["method"], *(as_json(e.get(k)) for k in ("headers", "params", "data"))) for i, (spec, e, _) in enumerate(held)], kind)
    return expected, spark.createDataFrame([(i, c) for i, (*_, c) in enumerate(held)], "sample_id int, code string")


def descriptions(spark: SparkSession) -> DataFrame:
    return mini.mini(spark).filter("spec = 'mini'").unionByName(spark.createDataFrame([("depot", DEPOT)], "spec string, content string"))


def request_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(*tasks(spark), descriptions(spark))[1]


def request_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(*tasks(spark), descriptions(spark))[0]


def request_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.verdict_ratios(request_evaluation(spark, sf_dir))


#: Two APIs of one path that differ in methods and legal arguments.
LEFT = """
openapi: 3.0.0
servers: [{url: 'https://api.example.com/v1'}]
paths: {'/{lang}/{id}': {get: {parameters: [{name: q, in: query, schema: {type: integer}}, {name: page, in: query, schema: {type: integer}}]}}}
"""
RIGHT = """
openapi: 3.0.0
servers: [{url: 'https://api.example.com/v1'}]
paths: {'/{lang}/{id}': {get: {parameters: [{name: q, in: query, schema: {type: integer}}]}, post: {parameters: [{name: page, in: query, schema: {type: integer}}]}}}
"""


def page_tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A sample a page: its path is asked for by generated code, with other values, methods and arguments by remainders of its id."""
    i = F.col("page_id")
    path = urls.path_of(F.col("url"))
    pages = table(spark, sf_dir, "pages").filter(path.rlike("^[A-Za-z0-9/._-]*$")).select(i.alias("sample_id"), F.when(i % 2 == 0, "left").otherwise("right").alias("spec"), F.concat(F.lit("https://api.example.com/v1"), path).alias("url"), i)
    none = F.create_map().cast("map<string,string>")
    expected = pages.select("sample_id", "spec", "url", F.lit("get").alias("method"), none.alias("headers"), F.create_map(F.lit("q"), i.cast("string")).alias("params"), none.alias("data"))
    method, q = F.when(i % 11 == 0, "post").otherwise("get"), (i + F.when(i % 7 == 0, 1).otherwise(0)).cast("string")
    before = F.when(i % 11 == 0, "null, ").otherwise("")
    call = F.concat(F.lit("// c\naxios."), method, F.lit("('"), F.col("url"), F.lit("', "), before, F.lit("{params: {q: "), q, F.when(i % 5 == 0, ", page: 1").otherwise(""), F.lit("}});"))
    code = pages.select("sample_id", F.when(i % 13 == 0, F.concat(call, F.lit("\n//timeout"))).otherwise(call).alias("code"))
    return expected, code, spark.createDataFrame([("left", LEFT), ("right", RIGHT)], "spec string, content string")


def page_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(*page_tasks(spark, sf_dir))[1]


def page_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.verdict_ratios(page_evaluation(spark, sf_dir))


_PAGES = r"""p AS (SELECT page_id AS sample_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT sample_id, sample_id % 2 = 0 AS is_left, regexp_full_match(path, '/[^/?&]+/[^/?&]+') AS fits, sample_id % 11 = 0 AS posts, sample_id % 5 = 0 AS paged, sample_id % 7 <> 0 AS right_q, CASE WHEN sample_id % 13 = 0 THEN 'timeout' END AS error
      FROM p WHERE regexp_full_match(path, '[A-Za-z0-9/._-]*')),
n AS (SELECT *, CASE WHEN fits AND is_left THEN 1 ELSE 0 END AS page_legal, CASE WHEN fits THEN 2 ELSE 0 END AS named, CASE WHEN error IS NULL THEN 1 ELSE 0 END AS ran, CASE WHEN paged THEN 1 ELSE 0 END AS extra FROM f),
k AS (SELECT sample_id, error, fits, is_left, posts,
        1 + named + ran * extra AS n_all, 1 + named AS n_expected, ran * extra AS n_unexpected, (1 - ran) * (1 + named) AS n_missing, ran * (1 + named) AS n_correct_name,
        ran * (named + CASE WHEN right_q THEN 1 ELSE 0 END) AS n_correct_value, ran * extra * page_legal AS n_unnecessary, ran * extra * (1 - page_legal) AS n_illegal FROM n)"""
_EVALUATED = _PAGES + """,
v AS (SELECT *, CASE WHEN fits THEN 'correct' ELSE 'nonexistent_endpoint' END AS url, CASE WHEN NOT posts THEN 'correct' WHEN fits AND NOT is_left THEN 'wrong_method' ELSE 'nonexistent_method' END AS method FROM k),
e AS (SELECT *, CASE WHEN url = 'correct' AND method = 'correct' THEN 'correct' WHEN url = 'nonexistent_endpoint' OR method = 'nonexistent_method' THEN 'illegal' ELSE 'wrong' END AS endpoint FROM v),
r AS (SELECT sample_id, error, url, method, endpoint, CASE WHEN error IS NOT NULL THEN 'nonexecutable' WHEN endpoint = 'correct' AND n_correct_value = n_all THEN 'correct' WHEN endpoint = 'illegal' OR n_illegal > 0 THEN 'illegal' ELSE 'wrong' END AS verdict,
        n_all, n_expected, n_unexpected, n_missing, n_correct_name, n_correct_value, n_unnecessary, n_illegal FROM e)"""

SQL: dict[str, str] = {
    "page_evaluation": f"WITH {_EVALUATED} SELECT * FROM r",
    "page_ratios": f"WITH {_EVALUATED}, verdicts AS (SELECT * FROM r), c AS (" + evaluation.SQL["sample_verdict_ratios"].split(", c AS (", 1)[1],
}
QUERIES = {f.__name__: f for f in (request_evaluation, request_arguments, request_ratios, page_evaluation, page_ratios)}
