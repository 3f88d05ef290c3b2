"""Queries of the evaluation family over ``lineitem`` and ``orders``, and their SQL.

A sample is an order, a location its return flag, a key a line number. Expected and actual arguments and the
legal ones are picked by the remainders of part and supplier keys and by the tax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.operators import metrics, verdicts
from callgauge.plans.tables import table

KEYS = ["sample_id", "location", "key"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("location"), F.col("l_linenumber").alias("key"), "l_quantity", "l_partkey", "l_suppkey", "l_tax")
    return lines.groupBy(*KEYS).agg(F.min("l_quantity").alias("v"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_tax").alias("t"))


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    expected = b.filter("p % 11 <> 0").select(*KEYS, F.col("v").alias("value"))
    actual = b.filter("s % 5 <> 0").select(*KEYS, (F.col("v") + F.when(F.col("p") % 7 == 0, 1).otherwise(0)).alias("value"))
    return verdicts.compare_arguments(expected, actual, b.filter("t > 0.04").select(*KEYS), KEYS)


def arg_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arguments(spark, sf_dir)


def sample_arg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.sample_counts(verdicts.without_special(arguments(spark, sf_dir), "N", (7,)))


def sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.sample_metrics(sample_arg_counts(spark, sf_dir))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, error, url, method, endpoint."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rank = F.substring("o_orderpriority", 1, 1)
    url = F.when(rank.isin("1", "2", "3"), verdicts.CORRECT).when(rank == "4", verdicts.WRONG_ENDPOINT).otherwise(verdicts.NO_ENDPOINT)
    method = F.when(F.col("o_orderstatus").isin("F", "O"), verdicts.CORRECT).when(F.col("o_orderkey") % 3 == 0, verdicts.NO_METHOD).otherwise(verdicts.WRONG_METHOD)
    causes = F.array(*[F.lit(c) for c in verdicts.CAUSES])
    error = F.when(F.col("o_orderkey") % 13 == 0, F.get(causes, (F.col("o_orderkey") % 5).cast("int")))
    return orders.select(F.col("o_orderkey").alias("sample_id"), error.alias("error"), url.alias("url"), method.alias("method"), verdicts.endpoint_verdict(url, method).alias("endpoint"))


def sample_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sample_arg_counts(spark, sf_dir).filter("location = 'all'")
    verdict = verdicts.sample_verdict(F.col("error"), F.col("endpoint"), F.col("n_all"), F.col("n_correct_value"), F.col("n_illegal"))
    return endpoints(spark, sf_dir).join(counts, "sample_id", "left").select("sample_id", "error", "url", "method", "endpoint", verdict.alias("verdict"))


def sample_verdict_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.verdict_ratios(sample_verdicts(spark, sf_dir))


def settled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = verdicts.sample_counts_and_owed(arguments(spark, sf_dir), verdicts.is_special("N", (7,)))
    return metrics.settled(counts.join(endpoints(spark, sf_dir).select("sample_id", "error"), "sample_id"))


def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro_metrics(settled_counts(spark, sf_dir))


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_metrics(settled_counts(spark, sf_dir))


def metric_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.violations(sample_arg_counts(spark, sf_dir))


def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    causes = F.array(*[F.lit(c) for c in verdicts.CAUSES])
    return metrics.error_breakdown(events.select(F.when(F.col("event_type") == "error", F.get(causes, (F.col("event_id") % 5).cast("int"))).alias("error")))


def union_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample_id"), F.col("n_name").alias("name"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("sample_id"), F.col("r_name").alias("name"))
    return metrics.merged({"nation": nations, "region": regions}).withColumn("of_all", F.expr("count(*) OVER ()"))


ARGS = """
base AS (SELECT l_orderkey AS sample_id, l_returnflag AS location, l_linenumber AS "key", min(l_quantity) AS v, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_tax) AS t
         FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT sample_id, location, "key", v AS expected FROM base WHERE p % 11 <> 0),
a AS (SELECT sample_id, location, "key", v + CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END AS actual FROM base WHERE s % 5 <> 0),
l AS (SELECT sample_id, location, "key" FROM base WHERE t > 0.04),
j AS (SELECT coalesce(e.sample_id, a.sample_id) AS sample_id, coalesce(e.location, a.location) AS location, coalesce(e."key", a."key") AS "key", expected, actual
      FROM e FULL JOIN a ON e.sample_id = a.sample_id AND e.location = a.location AND e."key" = a."key"),
args AS (SELECT j.sample_id, j.location, j."key", expected, actual,
           CASE WHEN expected IS NOT NULL AND actual IS NOT NULL THEN CASE WHEN expected = actual THEN 'correct' ELSE 'incorrect_value' END
                WHEN expected IS NOT NULL THEN 'missing_key' WHEN l.sample_id IS NOT NULL THEN 'unnecessary_key' ELSE 'illegal_key' END AS verdict
         FROM j LEFT JOIN l ON j.sample_id = l.sample_id AND j.location = l.location AND j."key" = l."key")"""
COUNTS = ARGS + """,
counts AS (SELECT sample_id, coalesce(location, 'all') AS location, count(*) AS n_all,
             count(*) FILTER (verdict IN ('correct', 'incorrect_value', 'missing_key')) AS n_expected,
             count(*) FILTER (verdict IN ('unnecessary_key', 'illegal_key')) AS n_unexpected, count(*) FILTER (verdict = 'missing_key') AS n_missing,
             count(*) FILTER (verdict IN ('correct', 'incorrect_value')) AS n_correct_name, count(*) FILTER (verdict = 'correct') AS n_correct_value,
             count(*) FILTER (verdict = 'unnecessary_key') AS n_unnecessary, count(*) FILTER (verdict = 'illegal_key') AS n_illegal
           FROM args WHERE NOT (location = 'N' AND "key" = 7) GROUP BY GROUPING SETS ((sample_id, location), (sample_id)))"""
ENDPOINTS = """,
ends AS (SELECT o_orderkey AS sample_id,
    CASE WHEN o_orderkey % 13 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unsatisfiable' WHEN 2 THEN 'no_request' WHEN 3 THEN 'incomplete_request' ELSE 'runtime_error' END END AS error,
    CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN 'correct' WHEN o_orderpriority[1] = '4' THEN 'wrong_endpoint' ELSE 'nonexistent_endpoint' END AS url,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN 'correct' WHEN o_orderkey % 3 = 0 THEN 'nonexistent_method' ELSE 'wrong_method' END AS method FROM orders),
endpoints AS (SELECT *, CASE WHEN url = 'correct' AND method = 'correct' THEN 'correct' WHEN url = 'nonexistent_endpoint' OR method = 'nonexistent_method' THEN 'illegal' ELSE 'wrong' END AS endpoint FROM ends)"""
VERDICTS = COUNTS + ENDPOINTS + """,
verdicts AS (SELECT e.sample_id, error, url, method, endpoint,
    CASE WHEN error IS NOT NULL THEN 'nonexecutable' WHEN endpoint = 'correct' AND coalesce(n_correct_value, 0) = coalesce(n_all, 0) THEN 'correct'
         WHEN endpoint = 'illegal' OR coalesce(n_illegal, 0) > 0 THEN 'illegal' ELSE 'wrong' END AS verdict
  FROM endpoints e LEFT JOIN (SELECT * FROM counts WHERE location = 'all') c ON e.sample_id = c.sample_id)"""
#: Of samples with an error only the expected arguments count, also where only special ones are expected.
SETTLED = ARGS + ENDPOINTS + """,
facts AS (SELECT sample_id, location, verdict, (location = 'N' AND "key" = 7) AS special, error FROM args JOIN endpoints USING (sample_id)),
counted AS (SELECT sample_id, location, error,
    CASE WHEN error IS NULL THEN verdict WHEN verdict IN ('unnecessary_key', 'illegal_key') THEN NULL ELSE 'missing_key' END AS verdict, special FROM facts),
settled AS (SELECT sample_id, coalesce(location, 'all') AS location, any_value(error) AS error, count(verdict) FILTER (NOT special) AS n_all,
    count(*) FILTER (NOT special AND verdict IN ('correct', 'incorrect_value', 'missing_key')) AS n_expected,
    count(*) FILTER (NOT special AND verdict IN ('unnecessary_key', 'illegal_key')) AS n_unexpected, count(*) FILTER (NOT special AND verdict = 'missing_key') AS n_missing,
    count(*) FILTER (NOT special AND verdict IN ('correct', 'incorrect_value')) AS n_correct_name, count(*) FILTER (NOT special AND verdict = 'correct') AS n_correct_value,
    count(*) FILTER (NOT special AND verdict = 'unnecessary_key') AS n_unnecessary, count(*) FILTER (NOT special AND verdict = 'illegal_key') AS n_illegal
  FROM counted GROUP BY GROUPING SETS ((sample_id, location), (sample_id))
  HAVING CASE WHEN any_value(error) IS NULL THEN count(verdict) FILTER (NOT special) > 0 ELSE count(verdict) > 0 END)"""


def _ratio(n: str, d: str) -> str:
    return f"round(CAST({n} AS DOUBLE) / nullif({d}, 0), 6)"


def _counter(name: str) -> str:
    return "(n_correct_name + n_unexpected)" if name == "retrieved" else f"n_{name}"


_METRICS = {m: (_counter(n), _counter(d)) for m, (n, d) in verdicts.METRICS.items()}
_RATIOS = ", ".join(f"{_ratio(n, d)} AS {m}" for m, (n, d) in _METRICS.items())
_NAMES = [f"n_{c}" for c in verdicts.COUNTERS]
_OWED = ("n_all", "n_expected", "n_missing")


def _total(counter: str) -> str:
    return f"{counter}_total" if counter in _OWED else counter


_SHARES = [(f"n_{n}", f"n_{d}", f"{n}_wrt_{d}") for n, d in (("unexpected", "all"), ("unnecessary", "all"), ("illegal", "all"), ("correct_name", "expected"), ("correct_value", "expected"), ("missing", "expected"))]
MICRO = (
    f"WITH {SETTLED}, m AS (SELECT location, " + ", ".join(f"CAST(coalesce(sum({c}) FILTER (error IS NULL), 0) AS BIGINT) AS {c}" for c in _NAMES) + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_total" for c in _OWED)
    + f" FROM settled GROUP BY location) SELECT *, {_RATIOS}, " + ", ".join(f"{_ratio(_total(n), _total(d))} AS {m}_total" for m, (n, d) in _METRICS.items())
    + ", " + ", ".join(f"{_ratio(n, d)} AS {name}_executable, {_ratio(_total(n), _total(d))} AS {name}_total" for n, d, name in _SHARES) + " FROM m"
)
MACRO = (
    f"WITH {SETTLED}, m AS (SELECT location, count(*) AS pairs_total, count(*) FILTER (error IS NULL) AS pairs_executable, "
    + ", ".join(f"coalesce(sum(CAST({n} AS DOUBLE) / nullif({d}, 0)) FILTER (error IS NULL), 0) AS {m}, count(*) FILTER (error IS NULL AND {d} > 0) AS {m}_ran, count(*) FILTER (CASE WHEN error IS NULL THEN {d} > 0 ELSE {str(d in _OWED).lower()} END) AS {m}_of" for m, (n, d) in _METRICS.items())
    + " FROM settled GROUP BY location) SELECT location, pairs_total, pairs_executable, "
    + ", ".join(f"round({m} / nullif({m}_of, 0), 6) AS {m}_total, round({m} / nullif({m}_ran, 0), 6) AS {m}_executable" for m in _METRICS) + " FROM m"
)
_FAMILIES = {"urls": ("url", ("correct", "wrong_endpoint", "nonexistent_endpoint")), "methods": ("method", ("correct", "wrong_method", "nonexistent_method")), "endpoints": ("endpoint", metrics.SAMPLE_VERDICTS)}

SQL = {
    "arg_verdicts": f"WITH {ARGS} SELECT * FROM args",
    "sample_arg_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "sample_metrics": f"WITH {COUNTS} SELECT sample_id, location, {_RATIOS} FROM counts",
    "sample_verdicts": f"WITH {VERDICTS} SELECT * FROM verdicts",
    "sample_verdict_ratios": f"WITH {VERDICTS}, c AS (SELECT count(*) AS samples_total, count(*) FILTER (verdict <> 'nonexecutable') AS samples_executable, count(*) FILTER (verdict = 'nonexecutable') AS samples_nonexecutable, "
    + ", ".join([f"count(*) FILTER (verdict = '{v}') AS samples_{v}" for v in metrics.SAMPLE_VERDICTS])
    + ", " + ", ".join(f"count(*) FILTER (verdict <> 'nonexecutable' AND {column} = '{own}') AS {u}_{v}" for u, (column, names) in _FAMILIES.items() for v, own in zip(metrics.SAMPLE_VERDICTS, names, strict=True))
    + " FROM verdicts) SELECT *, round(samples_executable / nullif(samples_total, 0), 6) AS samples_executable_wrt_total, "
    + ", ".join([f"round({u}_{v} / nullif(samples_total, 0), 6) AS {u}_{v}_wrt_total, CASE WHEN samples_executable > 0 THEN round({u}_{v} / samples_executable, 6) ELSE 0.0 END AS {u}_{v}_wrt_executable" for u in ("samples", *_FAMILIES) for v in metrics.SAMPLE_VERDICTS])
    + " FROM c",
    "micro_metrics": MICRO,
    "macro_metrics": MACRO,
    "metric_invariants": f"WITH {COUNTS} " + " UNION ALL ".join(f"SELECT '{name}' AS law, count(*) AS checked, count(*) FILTER (NOT ({law})) AS broken FROM counts" for name, law in metrics.LAWS.items()),
    "error_breakdown": "WITH s AS (SELECT CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unsatisfiable' WHEN 2 THEN 'no_request' WHEN 3 THEN 'incomplete_request' ELSE 'runtime_error' END END AS error FROM events), "
    + "c AS (SELECT count(*) AS samples, count(error) AS errors_total, " + ", ".join(f"count(*) FILTER (error = '{c}') AS errors_{c}" for c in verdicts.CAUSES) + " FROM s) SELECT *, "
    + ", ".join(f"round(errors_{c} / nullif(samples, 0), 6) AS errors_{c}_wrt_samples" for c in ("total", *verdicts.CAUSES)) + ", "
    + ", ".join(f"CASE WHEN errors_total > 0 THEN round(errors_{c} / errors_total, 6) ELSE 0.0 END AS errors_{c}_wrt_errors" for c in verdicts.CAUSES) + " FROM c",
    "union_prefixed": "WITH u AS (SELECT 'nation_' || n_nationkey AS sample_id, n_name AS name FROM nation UNION ALL SELECT 'region_' || r_regionkey, r_name FROM region) SELECT *, count(*) OVER () AS of_all FROM u",
}

QUERIES = {f.__name__: f for f in (arg_verdicts, sample_arg_counts, sample_metrics, sample_verdicts, sample_verdict_ratios, micro_metrics, macro_metrics, metric_invariants, error_breakdown, union_prefixed)}
