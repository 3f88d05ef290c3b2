"""Verdicts aggregated over samples: counts, micro and macro metrics, and the laws that they obey."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.operators.verdicts import CAUSES, CORRECT, COUNTERS, ILLEGAL, METRICS, NO_ENDPOINT, NO_METHOD, NONEXECUTABLE, WRONG, WRONG_ENDPOINT, WRONG_METHOD, counter, ratios

SAMPLE_VERDICTS = (CORRECT, WRONG, ILLEGAL)

#: Families of verdicts beside those of samples: column, and what counts as correct, wrong and illegal.
FAMILIES = {"urls": ("url", (CORRECT, WRONG_ENDPOINT, NO_ENDPOINT)), "methods": ("method", (CORRECT, WRONG_METHOD, NO_METHOD)), "endpoints": ("endpoint", SAMPLE_VERDICTS)}

#: Ratios of summed counters beside METRICS: numerator over denominator.
SHARES = {"unexpected": "all", "unnecessary": "all", "illegal": "all", "correct_name": "expected", "correct_value": "expected", "missing": "expected"}

#: Counters that samples with an error have, too: what they were expected to carry.
OWED = ("all", "expected", "missing")


def zero_safe(n: Column, d: Column) -> Column:
    """0 over an empty denominator."""
    return F.when(d > 0, F.round(n / d, 6)).otherwise(F.lit(0.0))


def verdict_ratios(samples: DataFrame) -> DataFrame:
    """One row: verdicts of samples, URLs, methods and endpoints, counted and over all or the executable samples.

    ``samples``: verdict, endpoint and, where there, url and method. Without any sample the ratios over all are NULL.
    """
    executable = F.col("verdict") != NONEXECUTABLE
    families = {u: held for u, held in FAMILIES.items() if held[0] in samples.columns}
    counts = samples.agg(
        F.count("verdict").alias("samples_total"),
        F.count_if(executable).alias("samples_executable"),
        F.count_if(~executable).alias("samples_nonexecutable"),
        *[F.count_if(F.col("verdict") == v).alias(f"samples_{v}") for v in SAMPLE_VERDICTS],
        *[F.count_if(executable & (F.col(column) == own)).alias(f"{u}_{v}") for u, (column, names) in families.items() for v, own in zip(SAMPLE_VERDICTS, names, strict=True)],
    )
    total, ran = F.col("samples_total"), F.col("samples_executable")
    wrt = [F.round(F.try_divide(F.col(f"{u}_{v}"), total), 6).alias(f"{u}_{v}_wrt_total") for u in ("samples", *families) for v in SAMPLE_VERDICTS]
    wrt += [zero_safe(F.col(f"{u}_{v}"), ran).alias(f"{u}_{v}_wrt_executable") for u in ("samples", *families) for v in SAMPLE_VERDICTS]
    return counts.select("*", F.round(F.try_divide(ran, total), 6).alias("samples_executable_wrt_total"), *wrt)


def error_breakdown(samples: DataFrame) -> DataFrame:
    """One row: causes of errors, counted, over all samples and over errors (0 without an error). ``samples``: error."""
    counts = samples.agg(F.count(F.lit(1)).alias("samples"), F.count("error").alias("errors_total"), *[F.count_if(F.col("error") == c).alias(f"errors_{c}") for c in CAUSES])
    names = ("total", *CAUSES)
    return counts.select(
        "*", *[F.round(F.try_divide(F.col(f"errors_{c}"), F.col("samples")), 6).alias(f"errors_{c}_wrt_samples") for c in names],
        *[zero_safe(F.col(f"errors_{c}"), F.col("errors_total")).alias(f"errors_{c}_wrt_errors") for c in CAUSES],
    )


def settled(counts: DataFrame) -> DataFrame:
    """``counts`` (with ``error`` and n_owed) of which samples with an error keep what was expected of them alone.

    n_owed counts expected arguments with those that don't count otherwise: a sample with an error keeps a row of zeros
    where it was expected to carry only such. Other samples have no rows of zeros.
    """
    ran = F.col("error").isNull()
    of = lambda c: F.when(ran, F.col(f"n_{c}")).otherwise(F.col("n_expected") if c in OWED else F.lit(0).cast("long")).alias(f"n_{c}")
    return counts.filter((ran & (F.col("n_all") > 0)) | (~ran & (F.col("n_owed") > 0))).select("sample_id", "location", "error", *[of(c) for c in COUNTERS])


def _ratio(n: Column, d: Column) -> Column:
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), 6)


def micro_metrics(counts: DataFrame) -> DataFrame:
    """Sums of counters by location, and metrics and shares of the sums; NULL over a denominator of 0. ``counts``: as settled() gives them.

    n_x sums executable samples, n_x_total all samples; shares and metrics are over the sums of the executable ones or,
    those that end in _total, over all. Only executable samples have anything in their numerators but for what is missing.
    """
    ran = F.col("error").isNull()
    held = counts.groupBy("location").agg(
        *[F.coalesce(F.sum(F.when(ran, F.col(f"n_{c}"))), F.lit(0)).alias(f"n_{c}") for c in COUNTERS], *[F.sum(f"n_{c}").alias(f"n_{c}_total") for c in OWED]
    )
    total = lambda c: F.col(f"n_{c}_total") if c in OWED else counter(c)
    return held.select(
        "location", *[f"n_{c}" for c in COUNTERS], *[f"n_{c}_total" for c in OWED], *ratios(), *[_ratio(total(n), total(d)).alias(f"{m}_total") for m, (n, d) in METRICS.items()],
        *[_ratio(counter(n), counter(d)).alias(f"{n}_wrt_{d}_executable") for n, d in SHARES.items()], *[_ratio(total(n), total(d)).alias(f"{n}_wrt_{d}_total") for n, d in SHARES.items()],
    )


def macro_metrics(counts: DataFrame) -> DataFrame:
    """Means of samples' metrics by location over all samples and over the executable ones. ``counts``: as settled() gives them.

    A metric's mean is over the samples that have its denominator at the location; over all samples those with an
    error add 0 where something was expected of them. NULL where there is no such sample.
    """
    ran = F.col("error").isNull()
    has = lambda d: F.count_if(ran & (counter(d) > 0))
    names = sorted({d for _, d in METRICS.values()})
    held = counts.groupBy("location").agg(
        F.count(F.lit(1)).alias("pairs_total"), F.count_if(ran).alias("pairs_executable"), *[has(d).alias(f"_ran_{d}") for d in names],
        *[(has(d) + (F.count_if(~ran) if d in OWED else F.lit(0))).alias(f"_of_{d}") for d in names],
        *[F.coalesce(F.sum(F.when(ran, F.try_divide(counter(n).cast("double"), counter(d).cast("double")))), F.lit(0.0)).alias(m) for m, (n, d) in METRICS.items()],
    )
    return held.select(
        "location", "pairs_total", "pairs_executable", *[_ratio(F.col(m), F.col(f"_of_{d}")).alias(f"{m}_total") for m, (_, d) in METRICS.items()],
        *[_ratio(F.col(m), F.col(f"_ran_{d}")).alias(f"{m}_executable") for m, (_, d) in METRICS.items()],
    )


#: Laws of a row of counters.
LAWS = {
    "all_is_expected_and_unexpected": "n_all = n_expected + n_unexpected",
    "expected_is_named_and_missing": "n_expected = n_correct_name + n_missing",
    "unexpected_is_unnecessary_and_illegal": "n_unexpected = n_unnecessary + n_illegal",
    "right_values_have_right_names": "n_correct_value <= n_correct_name",
}


def violations(counts: DataFrame) -> DataFrame:
    """law, checked, broken: for each law the rows that it was held against and those that break it."""
    held = counts.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(~F.expr(law)).alias(name) for name, law in LAWS.items()])
    return held.unpivot(["checked"], list(LAWS), "law", "broken").select("law", "checked", "broken")


def merged(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several APIs in one, the sample's name prefixed with its API's."""
    parts = [df.withColumn("sample_id", F.concat_ws("_", F.lit(api), F.col("sample_id").cast("string"))) for api, df in sorted(results.items())]
    return reduce(DataFrame.unionByName, parts)
