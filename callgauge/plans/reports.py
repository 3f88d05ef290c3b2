"""Queries of the reporting, prompt and file families, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.functions import jsons
from callgauge.functions import text as fn
from callgauge.operators import prompts, reporting
from callgauge.plans import evaluation
from callgauge.plans.tables import table
from callgauge.sources import files

LANGS = ["de", "en", "es", "fr"]
LOWER = ["es", "fr"]  # languages of which a lower value counts as better


def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {
        "model": sorted(r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()), "api": ["google_calendar_v3", "google_sheet_v4"],
        "setup": ["invocation", "endpoint"], "setting": ["vanilla", "constrained", "spec"],
    }
    return reporting.experiment_grid(spark, axes)


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return reporting.todo(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), done, ["o_orderkey"])


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


def settings_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.pivoted(quality(spark, sf_dir), ["source"], "lang", LANGS, F.round(F.avg("quality"), 6))


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.gains(settings_pivot(spark, sf_dir), "de", "en").select("source", "de", "en", "gain")


def settings_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.summary_rows(gains(spark, sf_dir), "source", ["de", "en", "gain"])


def best_value_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = settings_pivot(spark, sf_dir).unpivot(["source"], LANGS, "lang", "value")
    excluded = spark.createDataFrame([("src1", "en"), ("src2", "fr")], "source string, lang string")
    lower = F.col("lang").isin(LOWER)
    flagged = reporting.best_flags(reporting.mask(long, excluded, ["source", "lang"]), "lang", "value", lower)
    shown, label = reporting.inverted(F.col("value"), F.col("lang"), lower)
    return flagged.select("source", "lang", label.alias("label"), F.round(shown, 6).alias("value"), "best")


def runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.runtime_statistics(table(spark, sf_dir, "events"), ["user_id"], "value", F.col("event_id"))


def set_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "events").select("event_type").distinct()
    return reporting.not_in(have, spark.createDataFrame([("click",), ("view",)], "event_type string"))


def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each order that is required and has no line, and each line of no order; ``OK`` counts the rest."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    missing = orders.join(lines, "k", "left_anti").select("k", F.lit("missing required argument").alias("message"))
    unknown = lines.join(orders, "k", "left_anti").select("k", F.lit("unknown argument").alias("message"))
    fine = orders.join(lines, "k", "left_semi").select("k", F.lit("OK").alias("message"))
    return missing.unionByName(unknown).unionByName(fine).groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer beside the question of the same conversation and place."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"])


def api_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    api = F.col("s_nationkey").cast("string")
    named = prompts.display_name(api, {"1": "One", "2": "Two", "15": "Fifteen"}, {"2": "Second", "16": "Sixteenth", "20": "Twentieth"})
    return table(spark, sf_dir, "supplier").select("s_suppkey", named.alias("api_name"))


def config_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.explode(jsons.entries(F.col("props"))).alias("key", "value"))
    return e.filter("value IS NOT NULL")


def canonical_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties against a copy written with other spaces, numbers and order of keys."""
    k = F.get_json_object("props", "$.k")
    mine = F.concat(F.lit('{"a": [1, true], "k": '), k, F.lit("}"))
    other = F.concat(F.lit('{ "k":'), k, F.when(F.col("event_id") % 3 == 0, ".0").when(F.col("event_id") % 3 == 1, "").otherwise(".5"), F.lit(', "a":[1.0,true] }'))
    e = table(spark, sf_dir, "events").select("event_id", jsons.canonical(mine).alias("mine"), jsons.canonical(other).alias("other"))
    return e.select("event_id", "mine", (F.col("mine") == F.col("other")).alias("equal"))


TEMPLATE = "// {api}\nTask: {task}\n{starter}"


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://api.example.com/"), F.col("role"))
    template = F.when(F.col("turn") % 2 == 1, F.concat(url, F.lit("/${id}")))
    start = prompts.starter(F.when(F.col("turn") == 0, F.lit("const a = {};\n")), F.lit("axios.get"), url, template)
    out = prompts.instantiate(TEMPLATE, {"api": F.col("role"), "task": F.col("text"), "starter": start})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("prompt"))


def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.regexp_replace("text", r"\n([A-Z])", "\n* $1")
    before, after = prompts.split_prompt(F.col("_p"))
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("_p")).select("doc_id", before.alias("system"), after.alias("user"))


def var_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string"))))).alias("_m"))
    return nations.select("n_regionkey", prompts.variable_definitions(F.col("_m")).alias("code"))


def role_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.concat(F.lit("Sure!\n"), F.lit("assistant:\n```javascript\n"), F.lit("axios."), F.col("text"), F.lit("\n```"))
    cut = prompts.cleaned(output, F.when(F.col("turn") % 2 == 0, F.lit("axios.")).otherwise(F.lit("assistant:\n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut.alias("code"), fn.without_suffix(fn.without_prefix(F.col("role"), "assi"), "er").alias("role"))


def extract_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in code made of documents: behind a comment, without one, and cut off."""
    body = F.concat(F.lit("axios.get('"), F.regexp_replace("text", r"[()']", ""), F.lit("')"))
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("// call\n"), body, F.lit(".then(f)"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("let x = "), body)).otherwise(F.concat(F.lit("\n\n"), body))
    call, complete = prompts.extract_call(F.col("_c"))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("_c")).select("doc_id", call.alias("call"), complete.alias("complete"))


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.greedy_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 600)


def media_type_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("STANDARD", "LARGE", "ECONOMY", "SMALL")
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("_t"))
    content = F.map_from_arrays(F.array_sort("_t"), F.array_sort("_t"))
    return brands.select("p_brand", fn.preferred(content, order).alias("picked"))


def security_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct descriptions of each nation's suppliers in order, and whether there is just one."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("level "), F.floor(F.col("s_acctbal") / 2000).cast("string")).alias("d")).distinct()
    return s.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("d")), " | ").alias("description"), (F.count("d") == 1).alias("required"))


def requests_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus")
    return o.agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("requests"))


def literal_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_brand")
    value = F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 4 == 1, "true").when(F.col("p_size") % 4 == 2, F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.sanitised(name).alias("name"), fn.regex_escaped(name).alias("escaped"), fn.literal(value).alias("literal"),
        fn.output_format(F.when(F.col("p_size") % 2 == 0, " dict").otherwise("Raw_Yaml")).alias("format"), F.format_string("%.2f", "p_retailprice").alias("price"),
    )


def metric_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("recall_total", "Recall", False), ("jaccard_total", "Jaccard", False), ("pairs_total", "Pairs", True)], "metric string, label string, lower boolean")
    long = reporting.selected(evaluation.macro_metrics(spark, sf_dir), "location", labels)
    return long.withColumn("axis", F.max("value").over(Window.partitionBy("metric")))


def repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.col("n_regionkey"))).alias("repetition")).select("n_nationkey", F.concat_ws("_", "n_name", "repetition").alias("name"), "repetition")


def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = F.array(F.col("p_name"), F.when(F.col("p_size") > 25, F.concat_ws("  \n", "p_name", "p_type")), F.when(F.col("p_size") % 2 == 0, F.concat_ws(": ", "p_name", "p_brand")), F.nullif(F.when(F.col("p_size") == 7, F.lit("")), F.lit("")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array_compact(variants)).alias("variant", "content"))


def map_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of two objects merged, the second's first, without one name."""
    mine = jsons.entries(F.col("props"))
    other = F.create_map(F.lit("z"), F.col("event_type"), F.lit("drop"), F.lit("x"), F.when(F.col("event_id") % 2 == 0, F.lit("k")).otherwise(F.lit("y")), F.lit("other"))
    merged = F.map_concat(F.map_filter(mine, lambda k, v: ~F.map_contains_key(other, k)), F.map_filter(other, lambda k, v: k != "drop"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(merged).alias("key", "value"))


def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "batch")
    lines = table(spark, sf_dir, "conversations").select(F.concat_ws("_", F.lit("c"), "conv_id").alias("custom_id"), "turn", "text")
    files.write_lines(lines, path)
    return files.lookup_lines(spark, path, "custom_id string, turn long, text string", lines.select("custom_id").distinct(), "custom_id", "turn")


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "results")
    long = settings_pivot(spark, sf_dir).unpivot(["source"], LANGS, "lang", "value").filter("value IS NOT NULL")
    files.write_results(long, path, ["source", "lang"])
    return files.read_results(spark, path, "value double, source string, lang string")


def topk_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    return reporting.top_valid(e, "user_id", "event_id", "value", F.col("event_type") != "error", 3)


_QUALITY = "q AS (SELECT source, lang, avg(quality) AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)"
_PIVOT = _QUALITY + ", p AS (SELECT source, " + ", ".join(f"round(max(v) FILTER (lang = '{x}'), 6) AS {x}" for x in LANGS) + " FROM q GROUP BY 1)"
_LONG = _PIVOT + ", l AS (" + " UNION ALL ".join(f"SELECT source, '{x}' AS lang, {x} AS value FROM p" for x in LANGS) + ")"
_GAIN = _PIVOT + ", g AS (SELECT source, de, en, CASE WHEN de > 0 THEN round((en - de) / de, 6) END AS gain FROM p WHERE de IS NOT NULL AND en IS NOT NULL)"


def _summary(name: str, f: str) -> str:
    return f"SELECT '{name}', " + ", ".join(f"round({f}({c}), 6)" for c in ("de", "en", "gain")) + " FROM g"


SQL = {
    "extract_call": """WITH b AS (SELECT doc_id, 'axios.get(''' || regexp_replace(text, '[()'']', '', 'g') || ''')' AS body FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN body END AS call, coalesce(doc_id % 3 = 0 AND body IS NOT NULL, false) AS complete FROM b""",
    "experiment_grid": "SELECT r_name AS model, api, setup, setting FROM region CROSS JOIN (VALUES ('google_calendar_v3'), ('google_sheet_v4')) a(api) CROSS JOIN (VALUES ('invocation'), ('endpoint')) b(setup) CROSS JOIN (VALUES ('vanilla'), ('constrained'), ('spec')) c(setting)",
    "resume_todo": "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "settings_pivot": f"WITH {_PIVOT} SELECT * FROM p",
    "settings_gain": f"WITH {_GAIN} SELECT source, round(de, 6) AS de, round(en, 6) AS en, round(gain, 6) AS gain FROM g UNION ALL {_summary('Average', 'avg')} UNION ALL {_summary('Minimum', 'min')} UNION ALL {_summary('Maximum', 'max')}",
    "best_value_flags": f"""WITH {_LONG}, m AS (SELECT source, lang, lang IN ('es', 'fr') AS lower, CASE WHEN (source, lang) IN (('src1', 'en'), ('src2', 'fr')) THEN NULL ELSE value END AS value FROM l)
        SELECT source, lang, CASE WHEN lower THEN '1 - ' || lang ELSE lang END AS label, round(CASE WHEN lower THEN 1 - value ELSE value END, 6) AS value,
               coalesce(value = CASE WHEN lower THEN min(value) OVER (PARTITION BY lang) ELSE max(value) OVER (PARTITION BY lang) END, false) AS best FROM m""",
    "runtime_stats": """WITH r AS (SELECT user_id, count(value) AS runs, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max, max(event_id) AS tokens FROM events GROUP BY 1)
        SELECT user_id, runs, round(m, 6) AS mean, round(coalesce(sd, 0), 6) AS stdev, min, max, tokens, CASE WHEN m = 0 THEN 0 ELSE round(tokens / m, 6) END AS rate FROM r""",
    "set_validation": "SELECT DISTINCT event_type FROM events EXCEPT SELECT * FROM (VALUES ('click'), ('view'))",
    "required_missing": """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'OK' ELSE 'missing required argument' END AS message FROM orders
        UNION ALL SELECT DISTINCT l_orderkey, 'unknown argument' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) SELECT message, count(*) AS n, min(k) AS first, max(k) AS last FROM x GROUP BY 1""",
    "positional_join": "SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
    "api_display_name": "SELECT s_suppkey, CASE s_nationkey WHEN 1 THEN 'One' WHEN 2 THEN 'Two' WHEN 15 THEN 'Fifteen' WHEN 16 THEN 'Sixteenth' WHEN 20 THEN 'Twentieth' ELSE CAST(s_nationkey AS VARCHAR) END AS api_name FROM supplier",
    "config_explode": "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE json_extract_string(props, '$.' || k) IS NOT NULL",
    "canonical_equal": """SELECT event_id, '{"a":[1,true],"k":' || (props->>'$.k') || '}' AS mine, event_id % 3 <> 2 AS equal FROM events""",
    "prompt_build": r"""SELECT conv_id, turn, '// ' || role || chr(10) || 'Task: ' || text || chr(10) || CASE WHEN turn = 0 THEN 'const a = {};' || chr(10) ELSE '' END || 'axios.get(' ||
        CASE WHEN turn % 2 = 1 THEN '`https://api.example.com/' || role || '/${id}`' ELSE '''https://api.example.com/' || role || '''' END AS prompt FROM conversations""",
    "prompt_split": r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '\n([A-Z])', chr(10) || '* \1', 'g'), chr(10)) AS ls FROM documents),
        w AS (SELECT doc_id, ls, coalesce(list_max(list_filter(range(1, len(ls) + 1), lambda i: starts_with(ls[i], '* '))), 0) AS n FROM p)
        SELECT doc_id, array_to_string(ls[1:n], chr(10)) AS "system", array_to_string(ls[n + 1:], chr(10)) AS "user" FROM w""",
    "var_definitions": """SELECT n_regionkey, string_agg('const ' || n_name || ' = "' || n_nationkey || '";' || chr(10), '' ORDER BY n_name) AS code FROM nation GROUP BY 1""",
    "role_cleanup": """SELECT conv_id, turn, trim('axios.' || text) AS code, CASE role WHEN 'assistant' THEN 'stant' WHEN 'user' THEN 'us' ELSE role END AS role FROM conversations""",
    "greedy_chunks": """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations),
        r AS (SELECT conv_id, turn, s, i, 0 AS chunk, CASE WHEN s > 600 THEN 0 ELSE s END AS sum, CASE WHEN s > 600 THEN 1 ELSE 0 END AS next FROM t WHERE i = 1
          UNION ALL SELECT t.conv_id, t.turn, t.s, t.i, r.next, CASE WHEN r.sum + t.s > 600 THEN 0 ELSE r.sum + t.s END, CASE WHEN r.sum + t.s > 600 THEN r.next + 1 ELSE r.next END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
        SELECT conv_id, chunk, min(turn) AS first, max(turn) AS last, CAST(sum(s) AS BIGINT) AS total FROM r GROUP BY 1, 2""",
    "media_type_pick": """SELECT p_brand, coalesce(min_by(p_type, CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'SMALL' THEN 4 END) FILTER (p_type IN ('STANDARD', 'LARGE', 'ECONOMY', 'SMALL')), min(p_type)) AS picked FROM part GROUP BY 1""",
    "security_params": "WITH s AS (SELECT DISTINCT s_nationkey, 'level ' || CAST(floor(s_acctbal / 2000) AS BIGINT) AS d FROM supplier) SELECT s_nationkey, string_agg(d, ' | ' ORDER BY d) AS description, count(*) = 1 AS required FROM s GROUP BY 1",
    "requests_by_method": "SELECT o_custkey, o_orderstatus, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS requests FROM orders GROUP BY 1, 2",
    "literal_render": r"""WITH n AS (SELECT *, p_name || ' ' || p_brand AS name, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'true' WHEN 2 THEN p_name END AS v FROM part)
        SELECT p_partkey, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS name, regexp_replace(name, '([^A-Za-z0-9_])', '\\\1', 'g') AS escaped,
               CASE p_size % 4 WHEN 3 THEN 'null' WHEN 2 THEN '"' || v || '"' ELSE v END AS literal, CASE WHEN p_size % 2 = 0 THEN 'DICT' ELSE 'RAW_YAML' END AS format, printf('%.2f', p_retailprice) AS price FROM n""",
    "metric_select": evaluation.SQL["macro_metrics"].replace("WITH ", "WITH macro AS (WITH ", 1) + """), l AS (SELECT location, 'recall_total' AS metric, 'Recall' AS label, false AS lower, CAST(recall_total AS DOUBLE) AS value FROM macro
        UNION ALL SELECT location, 'jaccard_total', 'Jaccard', false, jaccard_total FROM macro UNION ALL SELECT location, 'pairs_total', 'Pairs', true, pairs_total FROM macro)
        SELECT location, metric, label, lower, coalesce(value, 0) AS value, max(value) OVER (PARTITION BY metric) AS axis FROM l""",
    "repetitions": "SELECT n_nationkey, n_name || '_' || i AS name, i AS repetition FROM (SELECT n_nationkey, n_name, unnest(range(0, n_regionkey + 1)) AS i FROM nation)",
    "text_variants": """WITH v AS (SELECT p_partkey, list_filter([p_name, CASE WHEN p_size > 25 THEN p_name || '  ' || chr(10) || p_type END, CASE WHEN p_size % 2 = 0 THEN p_name || ': ' || p_brand END], lambda x: x IS NOT NULL) AS c FROM part)
        SELECT p_partkey, unnest(range(len(c))) AS variant, unnest(c) AS content FROM v""",
    "map_ops": """SELECT event_id, 'z' AS key, event_type AS value FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'y' END, 'other' FROM events
        UNION ALL SELECT event_id, 'k', props->>'$.k' FROM events WHERE event_id % 2 <> 0""",
    "batch_lookup": "SELECT 'c_' || conv_id AS custom_id, min(turn) AS turn, min_by(text, turn) AS text FROM conversations GROUP BY 1",
    "results_roundtrip": f"WITH {_LONG} SELECT * FROM l WHERE value IS NOT NULL",
    "topk_valid": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events), v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM r WHERE event_type <> 'error')
        SELECT user_id, event_id, value, rank, rank = 1 AND place > 1 AS intervened FROM v WHERE rank <= 3""",
}

QUERIES = {
    f.__name__: f
    for f in (
        experiment_grid, resume_todo, settings_pivot, settings_gain, best_value_flags, runtime_stats, set_validation, required_missing, positional_join, api_display_name, config_explode, canonical_equal,
        prompt_build, prompt_split, var_definitions, role_cleanup, extract_call, greedy_chunks, media_type_pick, security_params, requests_by_method, literal_render, metric_select, repetitions,
        text_variants, map_ops, batch_lookup, results_roundtrip, topk_valid,
    )
}
