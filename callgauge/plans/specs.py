"""Queries of the description, constraint and streaming families over small descriptions of our own, ``benchmark`` and ``events``."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions import forms
from callgauge.operators import constraints
from callgauge.plans.tables import table
from callgauge.sources import files, specs
from callgauge.streaming import automaton, batch_state

MINI = """
openapi: 3.0.0
servers:
  - url: https://shop.example.com/v1
  - url: https://{region}.shop.example.com/v1
security:
  - key: []
paths:
  /items:
    parameters:
      - {name: trace, in: header, schema: {type: string}}
    get:
      operationId: list items
      description: Lists items. It pages.
      parameters:
        - {name: tags, in: query, schema: {type: array, items: {type: string}}}
        - {name: $limit, in: query, required: true, description: how many, schema: {type: integer}}
      responses: {'200': {content: {application/json: {schema: {type: array, items: {$ref: '#/components/schemas/Item'}}, example: [{id: 1}]}}}}
    post:
      summary: Adds an item
      requestBody: {required: true, content: {application/json: {schema: {$ref: '#/components/schemas/NewItem'}}}}
      responses: {default: {description: none}}
  /items/{item-id}:
    get:
      description: One item
      parameters: [{name: item-id, in: path, required: true, schema: {type: integer}}]
    delete:
      security: [{login: []}]
      parameters: [{name: item-id, in: path, required: true, schema: {type: integer}}]
  /items/{item-id}/notes.txt:
    put:
      parameters: [{name: item-id, in: path, required: true, schema: {type: string}}]
      requestBody: {content: {text/plain: {schema: {type: string}}, text/x-markdown: {schema: {type: string}}}}
  /search/{kind}:
    post:
      parameters: [{name: kind, in: path, required: true, schema: {type: string, enum: [new, used]}}]
components:
  securitySchemes:
    key: {type: apiKey, in: query, name: api_key, description: the key}
    login: {type: http, scheme: bearer, description: a token}
  schemas:
    Size: {type: string, enum: [s, m, l]}
    Parts: {type: array, items: {$ref: '#/components/schemas/Part'}}
    Part: {type: object, required: [num], properties: {num: {type: integer}, size: {$ref: '#/components/schemas/Size'}}}
    NewItem:
      type: object
      required: [name]
      properties: {name: {type: string, description: its name}, size: {$ref: '#/components/schemas/Size'}, parts: {$ref: '#/components/schemas/Parts'}, free: {}}
    Item:
      allOf:
        - $ref: '#/components/schemas/NewItem'
        - {type: object, required: [id], properties: {id: {type: integer}}}
"""
BROKEN = "paths: {/x: {get: {parameters: [{$ref: '#/components/none'}]}}}"

#: intent, code, and the rule that has to match (None: none).
SNIPPETS = [
    ("get with a list", "axios.get('https://shop.example.com/v1/items', {params: {tags: ['a', 'b'], $limit: 3, api_key: 'k'}});", "get"),
    ("names in another order", "axios.get(\"https://shop.example.com/v1/items\", { params: { 'api_key': key, $limit: n } }).then(r => r)", "get"),
    ("header and parameters", "axios.get('https://shop.example.com/v1/items', {headers: {trace: 't'}, params: {$limit: 1, api_key: 'k'}})\n", "get"),
    ("server variable", "axios.get(`https://${region}.shop.example.com/v1/items`, {params: {$limit: 1, api_key: 'k'}});", "get"),
    ("path value", "axios.get('https://shop.example.com/v1/items/12', {params: {api_key: 'k'}});", "get"),
    ("path interpolation", "axios.get(`https://shop.example.com/v1/items/${id}`, {params: {api_key: 'k'}});", "get"),
    ("path concatenation", "axios.get('https://shop.example.com/v1/items/' + id, {params: {api_key: 'k'}});", "get"),
    ("inner concatenation", "axios.put('https://shop.example.com/v1/items/' + id + '/notes.txt', 'text', {params: {api_key: 'k'}});", "put"),
    ("body", "axios.post('https://shop.example.com/v1/items', {name: 'a \\' b', size: 'm', parts: [{num: 1, size: \"s\"}, {num: 2}], free: [1]}, {params: {api_key: 'k'}});", "post"),
    ("body in a variable", "axios.post('https://shop.example.com/v1/items', body, {params: {api_key: 'k'}});", "post"),
    ("empty body", "axios.post('https://shop.example.com/v1/search/new', null, {params: {api_key: 'k'}});", "post"),
    ("bearer", "axios.delete('https://shop.example.com/v1/items/1', {headers: {Authorization: `Bearer ${t}`}});", "delete"),
    ("unknown path", "axios.get('https://shop.example.com/v1/item', {params: {$limit: 3, api_key: 'k'}});", None),
    ("wrong method", "axios.patch('https://shop.example.com/v1/items', {params: {$limit: 3, api_key: 'k'}});", None),
    ("wrong server", "axios.get('https://shop.example.org/v1/items', {params: {$limit: 3, api_key: 'k'}});", None),
    ("wrong type", "axios.get('https://shop.example.com/v1/items', {params: {$limit: 'three', api_key: 'k'}});", None),
    ("unknown name", "axios.get('https://shop.example.com/v1/items', {params: {$limit: 3, api_key: 'k', page: 1}});", None),
    ("name twice", "axios.get('https://shop.example.com/v1/items', {params: {$limit: 3, $limit: 4, api_key: 'k'}});", None),
    ("missing parameter", "axios.get('https://shop.example.com/v1/items', {params: {api_key: 'k'}});", None),
    ("missing credential", "axios.get('https://shop.example.com/v1/items/12');", None),
    ("missing brace", "axios.get('https://shop.example.com/v1/items', {params: {$limit: 3, api_key: 'k'});", None),
    ("missing comma", "axios.get('https://shop.example.com/v1/items', {params: {$limit: 3 api_key: 'k'}});", None),
    ("query in the URL", "axios.get('https://shop.example.com/v1/items?$limit=3', {params: {api_key: 'k'}});", None),
    ("bad value of an enum", "axios.post('https://shop.example.com/v1/items', {name: 'a', size: 'xl'}, {params: {api_key: 'k'}});", None),
    ("missing attribute", "axios.post('https://shop.example.com/v1/items', {size: 'm'}, {params: {api_key: 'k'}});", None),
    ("missing inner attribute", "axios.post('https://shop.example.com/v1/items', {name: 'a', parts: [{size: 's'}]}, {params: {api_key: 'k'}});", None),
    ("four objects", "axios.post('https://shop.example.com/v1/items', {name: 'a', parts: [{num: 1}, {num: 2}, {num: 3}, {num: 4}]}, {params: {api_key: 'k'}});", None),
    ("body where none is", "axios.post('https://shop.example.com/v1/search/new', {a: 1}, {params: {api_key: 'k'}});", None),
    ("bad enum in the path", "axios.post('https://shop.example.com/v1/search/old', null, {params: {api_key: 'k'}});", None),
    ("no end", "axios.get('https://shop.example.com/v1/items/12', {params: {api_key: 'k'}})", None),
]
#: A rule over prose: from ``th`` on, letters up to the next full stop.
PROSE = [constraints.Rule("sentence", r"\bth", r"\.", r"[a-zà-ÿ ,]*\."), constraints.Rule("words", None, None, r"[^<>]*")]
FORMS = ["a=1&b=two%20words", "a[]=1&a[]=2", "a[b][0]=x&a[b][1]=y&c=", '{"k": 1}', "null", "", "u%5Bv%5D=w&u%5Bz%5D=+"]


def mini(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("mini", MINI), ("broken", BROKEN)], "spec string, content string")


def spec_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.legal_arguments(mini(spark))


def spec_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.operations(mini(spark))


def spec_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.declarations(mini(spark).filter("spec = 'mini'")).drop("error")


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.documents(mini(spark).filter("spec = 'mini'")).drop("error")


def rules() -> list[constraints.Rule]:
    return constraints.Compiler(yaml.safe_load(MINI)).rules()


def constraint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame(SNIPPETS, "intent string, code string, expected string")
    return s.withColumn("matched", constraints.match_column(rules(), F.col("code"))).withColumn("ok", F.col("matched").eqNullSafe(F.col("expected")))


def constraint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``benchmark`` as a token; a row a token."""
    path = files.scratch(spark, "tokens")
    kind = "id long, step long, token string"
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(F.split("text", "(?<= )")).alias("step", "token")).withColumn("step", F.col("step").cast("long"))
    words.select("id", "step", "token").write.parquet(f"{path}/in")
    stream = automaton.followed(spark.readStream.schema(kind).parquet(f"{path}/in"), PROSE)
    return automaton.drained(stream, f"{path}/out", f"{path}/state", automaton.OUT, spark)


def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user's jobs, events standing for what happens to them."""
    path = files.scratch(spark, "jobs")
    kind = F.when(F.col("event_type") == "error", "submit").when(F.col("event_id") % 2 == 0, "collect").otherwise("result")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("at"), kind.alias("kind"))
    e.write.parquet(f"{path}/in")
    stream = batch_state.tracked(spark.readStream.schema(e.schema).parquet(f"{path}/in"))
    out = automaton.drained(stream, f"{path}/out", f"{path}/state", batch_state.OUT, spark)
    return out.groupBy("job").agg(F.max_by(F.struct("state", "events", "expired"), "events").alias("s")).select("job", "s.*")


def form_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame([(i, t) for i, t in enumerate(FORMS)], "id int, body string")
    return f.withColumn("decoded", forms.body_json(F.col("body")))


SQL: dict[str, str] = {
    "batch_state": """WITH RECURSIVE e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i, floor(epoch(ts)) AS t,
            CASE WHEN event_type = 'error' THEN 'submit' WHEN event_id % 2 = 0 THEN 'collect' ELSE 'result' END AS kind FROM events),
        s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS i, 'absent' AS state, CAST(0 AS DOUBLE) AS since, false AS expired FROM e
            UNION ALL SELECT s.job, e.i, CASE WHEN state IN ('absent', 'collected') AND kind = 'collect' THEN 'collected' WHEN state = 'collected' AND kind = 'submit' THEN 'submitted'
                    WHEN state = 'submitted' AND kind = 'result' THEN CASE WHEN t - since > 86400 THEN 'absent' ELSE 'completed' END ELSE state END,
                CASE WHEN (state IN ('absent', 'collected') AND kind = 'collect') OR (state = 'collected' AND kind = 'submit') THEN t ELSE since END,
                expired OR (state = 'submitted' AND kind = 'result' AND t - since > 86400) FROM s JOIN e ON s.job = e.job AND e.i = s.i + 1)
        SELECT job, max_by(state, i) AS state, max(i) AS events, max_by(expired, i) AS expired FROM s GROUP BY job""",
}
QUERIES = {f.__name__: f for f in (spec_catalog, spec_resolved, spec_typescript, spec_documents, constraint_match, constraint_stream, form_decode)} | {"batch_state": batch_states}
