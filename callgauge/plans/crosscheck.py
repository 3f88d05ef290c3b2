"""Task sets held against their APIs' descriptions: a protocol a sample, written only where all of it is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.operators import urls
from callgauge.plans.evaluate import located
from callgauge.plans.tables import table
from callgauge.sources import specs
from callgauge.sources.files import kept

#: The words of a protocol, and the places of arguments as it names them.
QUERY_IN_URL = "URL '%s' seems to contain query parameters (which should be placed in `params`).\n"
NO_PATH = "URL '%s' could not be matched to an existing path in the specification.\n"
NO_METHOD = "Method '%s' does not exist for path '%s'.\n"
UNDEFINED = "Argument '%s' is not defined for location '%s', method '%s', and URL '%s'.\n"
MISSING = "Required argument '%s' is missing in location '%s'.\n"
RIGHT = "OK"
PLACES = {"headers": "header", "params": "query", "data": "request body"}


def _place(location: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shown in PLACES.items():
        out = F.when(location == name, shown).otherwise(out)
    return out


def cross_checked(tasks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """sample_id, protocol: what is wrong with each of ``tasks`` (sample_id, spec, url, method, headers, params, data), or ``OK``.

    A query in the URL, an unknown path or method end a protocol; else it names arguments that the operation doesn't define, then
    required ones that are absent (two anti-joins), each by place and name.
    """
    servers = kept(specs.servers(descriptions).filter("error IS NULL"), "servers")
    catalog = kept(specs.operations(descriptions).filter("error IS NULL").select("spec", "path", "method", "ordinal"), "operations")
    legal = kept(specs.legal_arguments(descriptions).filter("error IS NULL").select("spec", "path", F.col("method").alias("_m"), "location", F.col("name").alias("key"), "required"), "legal")
    listed = catalog.groupBy("spec", "path").agg(F.min("ordinal").alias("ordinal")).withColumnRenamed("path", "template")
    found = located(tasks.select("sample_id", "spec", "url", "method", "headers", "params", "data"), servers, listed)
    known = catalog.select("spec", F.col("path").alias("best"), "method", F.lit(True).alias("_known"))
    base = kept(found.join(known, ["spec", "best", "method"], "left"), "cross-checked")
    first = (
        F.when(F.col("url").contains("?"), F.format_string(QUERY_IN_URL, "url")).when(F.col("best").isNull(), F.format_string(NO_PATH, "url")).when(F.col("_known").isNull(), F.format_string(NO_METHOD, "method", "url"))
    )
    sound = base.filter(first.isNull()).select("sample_id", "spec", F.col("best").alias("path"), F.col("method").alias("_m"), "url", *PLACES)
    none = F.create_map().cast("map<string,string>")
    keys = F.flatten(F.array(*[F.transform(F.map_keys(F.coalesce(F.col(p), none)), _located(p)) for p in PLACES]))
    held = sound.select("sample_id", "spec", "path", "_m", "url", F.explode(keys).alias("_x")).select("sample_id", "spec", "path", "_m", "url", "_x.*")
    undefined = held.join(legal, ["spec", "path", "_m", "location", "key"], "left_anti")
    undefined = undefined.select("sample_id", F.lit(0).alias("_o"), "location", "key", F.format_string(UNDEFINED, "key", _place(F.col("location")), "_m", "url").alias("_t"))
    required = legal.filter(F.col("required") & F.col("location").isin(*PLACES))
    absent = sound.select("sample_id", "spec", "path", "_m").join(required, ["spec", "path", "_m"]).join(held.select("sample_id", "location", "key"), ["sample_id", "location", "key"], "left_anti")
    absent = absent.select("sample_id", F.lit(1).alias("_o"), "location", "key", F.format_string(MISSING, "key", _place(F.col("location"))).alias("_t"))
    told = undefined.unionByName(absent).groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "location", "key", "_t"))), lambda x: x["_t"]), "").alias("_protocol"))
    return base.select("sample_id", first.alias("_first")).join(told, "sample_id", "left").select("sample_id", F.coalesce("_first", "_protocol", F.lit(RIGHT)).alias("protocol"))


def _located(place: str):
    return lambda k: F.struct(F.lit(place).alias("location"), k.alias("key"))


def write_if_right(tasks: DataFrame, protocols: DataFrame, path: str) -> bool:
    """Write ``tasks`` as JSON if every protocol is ``OK``; whether it was."""
    if not protocols.filter(F.col("protocol") != RIGHT).isEmpty():
        return False
    tasks.write.mode("overwrite").json(path)
    return True


#: Two APIs of one path, an argument required by one of them alone.
OPEN = """
openapi: 3.0.0
servers: [{url: 'https://api.example.com/v1'}]
paths: {'/{lang}/{id}': {get: {parameters: [{name: q, in: query, schema: {type: integer}}, {name: page, in: query, schema: {type: integer}}]}, post: {responses: {}}}}
"""
STRICT = """
openapi: 3.0.0
servers: [{url: 'https://api.example.com/v1'}]
paths: {'/{lang}/{id}': {get: {parameters: [{name: q, in: query, required: true, schema: {type: integer}}, {name: trace, in: header, required: true, schema: {type: string}}]}}}
"""


def task_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task a page: method, arguments and a query in the URL go by remainders of its id."""
    i = F.col("page_id")
    path = urls.path_of(F.col("url"))
    none = F.create_map().cast("map<string,string>")
    q, page = F.when(i % 3 > 0, F.create_map(F.lit("q"), F.lit("1"))).otherwise(none), F.when(i % 5 == 0, F.create_map(F.lit("page"), F.lit("1"))).otherwise(none)
    url = F.concat(F.lit("https://api.example.com/v1"), path, F.when(i % 17 == 0, "?a=1").otherwise(""))
    tasks = table(spark, sf_dir, "pages").filter(path.rlike("^[A-Za-z0-9/._-]*$")).select(
        i.alias("sample_id"), F.when(i % 2 == 0, "open").otherwise("strict").alias("spec"), url.alias("url"), F.when(i % 11 == 0, "post").otherwise("get").alias("method"), none.alias("headers"), F.map_concat(q, page).alias("params"), none.alias("data")
    )
    return cross_checked(tasks, spark.createDataFrame([("open", OPEN), ("strict", STRICT)], "spec string, content string"))


SQL = {
    "task_check": r"""WITH p AS (SELECT page_id AS i, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
t AS (SELECT i, i % 2 = 0 AS open, regexp_full_match(path, '/[^/?&]+/[^/?&]+') AS fits, CASE WHEN i % 11 = 0 THEN 'post' ELSE 'get' END AS m, 'https://api.example.com/v1' || path || CASE WHEN i % 17 = 0 THEN '?a=1' ELSE '' END AS url
      FROM p WHERE regexp_full_match(path, '[A-Za-z0-9/._-]*')),
u AS (SELECT *, CASE WHEN i % 5 = 0 AND (m = 'post' OR NOT open) THEN 'Argument ''page'' is not defined for location ''query'', method ''' || m || ''', and URL ''' || url || '''.' || chr(10) ELSE '' END
        || CASE WHEN i % 3 > 0 AND m = 'post' THEN 'Argument ''q'' is not defined for location ''query'', method ''' || m || ''', and URL ''' || url || '''.' || chr(10) ELSE '' END
        || CASE WHEN NOT open THEN 'Required argument ''trace'' is missing in location ''header''.' || chr(10) ELSE '' END
        || CASE WHEN NOT open AND i % 3 = 0 THEN 'Required argument ''q'' is missing in location ''query''.' || chr(10) ELSE '' END AS said FROM t)
SELECT i AS sample_id, CASE WHEN i % 17 = 0 THEN 'URL ''' || url || ''' seems to contain query parameters (which should be placed in `params`).' || chr(10)
    WHEN NOT fits THEN 'URL ''' || url || ''' could not be matched to an existing path in the specification.' || chr(10)
    WHEN m = 'post' AND NOT open THEN 'Method ''post'' does not exist for path ''' || url || '''.' || chr(10) WHEN said = '' THEN 'OK' ELSE said END AS protocol FROM u"""
}
QUERIES = {"task_check": task_check}
