"""Queries of the URL family over ``pages``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.operators import urls, verdicts
from callgauge.plans.tables import table

#: In order: a prefix of another, one with part of a path, an empty one.
SERVERS = ["https://blog.tionsh.example.net/en", "https://blog.tionsh.example.net", "http://blog.tionsh.example.net", "", "https://www.ththhe.example.com", "https://m.ththth.example.net"]
TEMPLATES = ["/{lang}/{id}", "/en/{id}", "/{lang}/12", "/fr/{id}", "/{lang}/{id}.html", "/{lang}/{section}/{id}", "/en/1"]
ROUTES = [("get", "/{lang}/{id}"), ("post", "/en/<id>"), ("put", "/fr/{id}"), ("put", "/{lang}/{id}"), ("delete", "/de/{id}")]
METHODS = ["get", "post", "put", "delete"]


def catalog(spark: SparkSession, values: list, names: str) -> DataFrame:
    return spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"ordinal int, {names}")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", method.alias("method"), urls.path_of(F.col("url")).alias("path"))


def url_server_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.strip_server(pages(spark, sf_dir), catalog(spark, SERVERS, "server string"), ["page_id"])


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.match_templates(pages(spark, sf_dir), catalog(spark, TEMPLATES, "template string"), ["page_id"])


def url_template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.best_template(matches(spark, sf_dir), ["page_id"])


def url_segment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.match_segments(pages(spark, sf_dir), catalog(spark, ROUTES, "method string, template string"), ["page_id"])


def url_path_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every template that a path fits, parameters inside a segment among them."""
    return urls.path_parameters(matches(spark, sf_dir), ["page_id", "template"])


def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.query_parameters(table(spark, sf_dir, "pages"), ["page_id"])


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected template is one of three by page, expected and offered methods go by remainders."""
    expected = F.when(F.col("page_id") % 3 == 0, "/en/{id}").when(F.col("page_id") % 3 == 1, "/{lang}/{id}").otherwise("/fr/{id}")
    offered = F.when(F.col("template") == "/en/{id}", F.array(F.lit("get"), F.lit("post"))).when(F.col("template") == "/fr/{id}", F.array(F.lit("put"))).otherwise(F.array(F.lit("get"), F.lit("delete")))
    found = matches(spark, sf_dir).withColumn("_offered", offered).groupBy("page_id").agg(F.collect_set("template").alias("_c"), F.array_distinct(F.flatten(F.collect_list("_offered"))).alias("_o"))
    p = pages(spark, sf_dir).select("page_id", expected.alias("expected_path"), "method", F.when(F.col("page_id") % 5 == 0, "get").otherwise(F.col("method")).alias("expected_method")).join(found, "page_id", "left")
    url, method = verdicts.url_verdict(F.col("expected_path"), F.col("_c")), verdicts.method_verdict(F.col("expected_method"), F.col("method"), F.col("_o"))
    return p.select("page_id", url.alias("url_verdict"), method.alias("method_verdict"), verdicts.endpoint_verdict(url, method).alias("endpoint_verdict"))


def path_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    found = url_segment_match(spark, sf_dir).select("page_id", F.col("template").isNotNull().alias("_ok"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).join(found, "page_id").groupBy("host").agg(F.count_if("_ok").alias("matched"), F.count_if(~F.col("_ok")).alias("unmatched"))


def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgauge.functions.text import property_name, type_name

    p = pages(spark, sf_dir)
    return p.select("page_id", type_name(F.lit(None).cast("string"), F.col("method"), F.col("path")).alias("type_name"), property_name(F.regexp_replace("path", "^/", "")).alias("property"))


def _values(rows: list, names: str) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quote(v) for v in (i, *(r if isinstance(r, tuple) else (r,)))) + ")" for i, r in enumerate(rows)) + f") AS v(ordinal, {names})"


PAGES = r"""p AS (SELECT page_id, url, ['get', 'post', 'put', 'delete'][1 + page_id % 4] AS method, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)"""
MATCHES = PAGES + rf""",
t AS (SELECT ordinal, template, len(regexp_extract_all(template, '\{{[^{{}}]+\}}')) AS n_params,
        replace(regexp_replace(template, '\{{[^{{}}]+\}}', '[^/?&]+', 'g'), '.html', '\.html') AS pattern FROM {_values(TEMPLATES, "template")}),
m AS (SELECT page_id, path, ordinal, template, n_params FROM p JOIN t ON regexp_full_match(path, pattern))"""
BEST = MATCHES + """,
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_params, length(template) DESC, ordinal) = 1)"""
ROUTED = PAGES + rf""",
r AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(template, ':[A-Za-z]+$', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '\{{.*\}}|<.*>') THEN '*' ELSE s END) AS ts,
        regexp_extract(template, '(:[A-Za-z]+)$', 1) AS ta FROM {_values(ROUTES, "method, template")}),
q AS (SELECT *, list_filter(string_split(regexp_replace(path, ':[A-Za-z]+$', ''), '/'), lambda s: s <> '') AS us, regexp_extract(path, '(:[A-Za-z]+)$', 1) AS ua FROM p),
g AS (SELECT q.page_id, min_by(r.template, r.ordinal) AS template FROM q JOIN r ON q.method = r.method AND len(us) = len(ts) AND ua = ta
        AND len(list_filter(range(1, len(us) + 1), lambda i: ts[i] <> '*' AND us[i] <> ts[i])) = 0 GROUP BY q.page_id)"""

SQL = {
    "url_server_strip": f"""WITH s AS (SELECT * FROM {_values(SERVERS, "server")}), b AS (SELECT page_id, min_by(server, ordinal) AS server FROM pages JOIN s ON server <> '' AND starts_with(url, server) GROUP BY page_id)
        SELECT page_id, url, server, CASE WHEN server IS NOT NULL THEN substr(url, length(server) + 1) END AS rest FROM pages LEFT JOIN b USING (page_id)""",
    "url_template_match": f"WITH {BEST} SELECT page_id, path, ordinal, template, n_params FROM b",
    "url_segment_match": f"WITH {ROUTED} SELECT p.page_id, p.method, g.template FROM p LEFT JOIN g USING (page_id)",
    "url_path_params": rf"""WITH {MATCHES}, z AS (SELECT page_id, path, template, regexp_extract_all(template, '\{{([^{{}}]+)\}}', 1) AS names,
            replace(regexp_replace(template, '\{{[^{{}}]+\}}', '([^/?&]+)', 'g'), '.html', '\.html') AS pattern FROM m),
        x AS (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM z)
        SELECT page_id, template, names[i] AS name, CASE i WHEN 1 THEN regexp_extract(path, '^' || pattern || '$', 1) WHEN 2 THEN regexp_extract(path, '^' || pattern || '$', 2) ELSE regexp_extract(path, '^' || pattern || '$', 3) END AS value FROM x""",
    "url_query_params": r"""WITH x AS (SELECT page_id, regexp_extract(regexp_extract(url, '^([^#]*)', 1), '\?(.*)$', 1) AS q FROM pages),
        e AS (SELECT page_id, unnest(string_split(q, '&')) AS kv, unnest(range(len(string_split(q, '&')))) AS i FROM x WHERE q <> '')
        SELECT page_id, split_part(kv, '=', 1) AS name, max_by(CASE WHEN regexp_extract(kv, '=(.*)$', 1) = '' THEN 'true' ELSE regexp_extract(kv, '=(.*)$', 1) END, i) AS value FROM e WHERE kv <> '' GROUP BY 1, 2""",
    "url_verdicts": f"""WITH {MATCHES},
        f AS (SELECT page_id, list(template) AS c, flatten(list(CASE template WHEN '/en/{{id}}' THEN ['get', 'post'] WHEN '/fr/{{id}}' THEN ['put'] ELSE ['get', 'delete'] END)) AS o FROM m GROUP BY page_id),
        w AS (SELECT p.page_id, p.method, c, o, CASE p.page_id % 3 WHEN 0 THEN '/en/{{id}}' WHEN 1 THEN '/{{lang}}/{{id}}' ELSE '/fr/{{id}}' END AS ep, CASE WHEN p.page_id % 5 = 0 THEN 'get' ELSE p.method END AS em FROM p LEFT JOIN f USING (page_id)),
        v AS (SELECT page_id, CASE WHEN c IS NULL THEN 'nonexistent_endpoint' WHEN list_contains(c, ep) THEN 'correct' ELSE 'wrong_endpoint' END AS url_verdict,
              CASE WHEN em = method THEN 'correct' WHEN coalesce(list_contains(o, method), false) THEN 'wrong_method' ELSE 'nonexistent_method' END AS method_verdict FROM w)
        SELECT *, CASE WHEN url_verdict = 'correct' AND method_verdict = 'correct' THEN 'correct' WHEN url_verdict = 'nonexistent_endpoint' OR method_verdict = 'nonexistent_method' THEN 'illegal' ELSE 'wrong' END AS endpoint_verdict FROM v""",
    "path_tally": f"WITH {ROUTED} SELECT regexp_extract(p.url, '^[a-z]+://([^/]+)', 1) AS host, count(g.template) AS matched, count(*) - count(g.template) AS unmatched FROM p LEFT JOIN g USING (page_id) GROUP BY 1",
    "type_names": rf"""WITH {PAGES}, w AS (SELECT page_id, path, list_filter(string_split(regexp_replace(method || regexp_replace(path, '\{{[^{{}}]*\}}', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda s: s <> '') AS parts FROM p)
        SELECT page_id, array_to_string(list_transform(parts, lambda s: upper(s[1]) || s[2:]), '') || 'Request' AS type_name,
               CASE WHEN regexp_full_match(ltrim(path, '/'), '[A-Za-z_$][A-Za-z0-9_$]*') THEN regexp_replace(path, '^/', '') ELSE '"' || regexp_replace(path, '^/', '') || '"' END AS property FROM w""",
}

QUERIES = {f.__name__: f for f in (url_server_strip, url_template_match, url_segment_match, url_path_params, url_query_params, url_verdicts, path_tally, type_names)}
