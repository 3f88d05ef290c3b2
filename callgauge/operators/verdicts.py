"""Requests compared argument by argument: verdicts of arguments, URLs, methods, endpoints and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of verdicts and of the causes of an error.
CORRECT, INCORRECT_VALUE, MISSING, UNNECESSARY, ILLEGAL_KEY = "correct", "incorrect_value", "missing_key", "unnecessary_key", "illegal_key"
WRONG, ILLEGAL, NONEXECUTABLE = "wrong", "illegal", "nonexecutable"
WRONG_ENDPOINT, NO_ENDPOINT, WRONG_METHOD, NO_METHOD = "wrong_endpoint", "nonexistent_endpoint", "wrong_method", "nonexistent_method"
CAUSES = ("timeout", "unsatisfiable", "no_request", "incomplete_request", "runtime_error")
SPECIAL_HEADERS = ("Accept", "Content-Type")

#: Counters of a group of arguments.
COUNTERS = ("all", "expected", "unexpected", "missing", "correct_name", "correct_value", "unnecessary", "illegal")


def compare_arguments(expected: DataFrame, actual: DataFrame, legal: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of expected and actual arguments (``keys``, value) with the verdict of each.

    ``legal``: keys that the catalog allows; they tell an unnecessary argument from an illegal one. All three sides
    shuffle by the same keys, so sides that are aggregated by them are not moved again.
    """
    e = expected.select(*keys, F.col("value").alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(*keys, F.col("value").alias("actual"), F.lit(True).alias("_a"))
    allowed = legal.select(*keys, F.lit(True).alias("_l"))
    verdict = (
        F.when(F.col("_e") & F.col("_a"), F.when(F.col("expected").eqNullSafe(F.col("actual")), CORRECT).otherwise(INCORRECT_VALUE))
        .when(F.col("_e"), MISSING).when(F.col("_l"), UNNECESSARY).otherwise(ILLEGAL_KEY)
    )
    return e.join(a, keys, "full_outer").join(allowed, keys, "left").select(*keys, "expected", "actual", verdict.alias("verdict"))


def is_special(location: str = "headers", names: tuple = SPECIAL_HEADERS) -> Column:
    """Arguments that every request may carry, by their exact spelling."""
    return (F.col("location") == location) & F.col("key").isin(*names)


def without_special(args: DataFrame, location: str = "headers", names: tuple = SPECIAL_HEADERS) -> DataFrame:
    return args.filter(~is_special(location, names))


def counters(verdict: Column) -> dict[str, Column]:
    """An aggregate for each of COUNTERS."""
    n = lambda *names: F.count_if(verdict.isin(*names))
    return {
        "all": F.count(verdict), "expected": n(CORRECT, INCORRECT_VALUE, MISSING), "unexpected": n(UNNECESSARY, ILLEGAL_KEY), "missing": n(MISSING),
        "correct_name": n(CORRECT, INCORRECT_VALUE), "correct_value": n(CORRECT), "unnecessary": n(UNNECESSARY), "illegal": n(ILLEGAL_KEY),
    }


def sample_counts(args: DataFrame) -> DataFrame:
    """COUNTERS a sample and location, and a sample with location ``all``, in one pass of grouping sets."""
    grouped = args.groupingSets([["sample_id", "location"], ["sample_id"]], "sample_id", "location")
    return grouped.agg(*[c.alias(f"n_{name}") for name, c in counters(F.col("verdict")).items()]).withColumn("location", F.coalesce("location", F.lit("all")))


def sample_counts_and_owed(args: DataFrame, special: Column) -> DataFrame:
    """sample_counts() of the arguments that aren't ``special``, and n_owed: the expected ones, special ones among them."""
    held = args.withColumn("_s", special).groupingSets([["sample_id", "location"], ["sample_id"]], "sample_id", "location")
    counts = counters(F.when(~F.col("_s"), F.col("verdict")))
    return held.agg(*[c.alias(f"n_{name}") for name, c in counts.items()], counters(F.col("verdict"))["expected"].alias("n_owed")).withColumn("location", F.coalesce("location", F.lit("all")))


#: Metric: numerator and denominator among the counters ("retrieved" is correct_name and unexpected).
METRICS = {
    "precision": ("correct_name", "retrieved"), "recall": ("correct_name", "expected"), "jaccard": ("correct_name", "all"),
    "accuracy_all": ("correct_value", "all"), "accuracy_expected": ("correct_value", "expected"), "accuracy_correct": ("correct_value", "correct_name"),
}


def counter(name: str) -> Column:
    return F.col("n_correct_name") + F.col("n_unexpected") if name == "retrieved" else F.col(f"n_{name}")


def ratios(places: int = 6) -> list[Column]:
    """The metrics of a row of counters; NULL over a denominator of 0."""
    return [F.round(F.try_divide(counter(n).cast("double"), counter(d).cast("double")), places).alias(m) for m, (n, d) in METRICS.items()]


def sample_metrics(counts: DataFrame) -> DataFrame:
    return counts.select("sample_id", "location", *ratios())


def url_verdict(expected_path: Column, candidates: Column, alias: Column | None = None) -> Column:
    """``candidates``: the templates that the URL fits. ``alias``: whether the two are known to be the same endpoint."""
    same = F.array_contains(candidates, expected_path)
    found = F.coalesce(F.size(candidates), F.lit(0)) > 0
    return F.when(found & same, CORRECT).when(~found, NO_ENDPOINT).when(F.lit(False) if alias is None else alias, CORRECT).otherwise(WRONG_ENDPOINT)


def method_verdict(expected: Column, actual: Column, offered: Column) -> Column:
    """``offered``: the methods of all candidate templates."""
    return F.when(expected == actual, CORRECT).when(F.coalesce(F.array_contains(offered, actual), F.lit(False)), WRONG_METHOD).otherwise(NO_METHOD)


def endpoint_verdict(url: Column, method: Column) -> Column:
    return F.when((url == CORRECT) & (method == CORRECT), CORRECT).when((url == NO_ENDPOINT) | (method == NO_METHOD), ILLEGAL).otherwise(WRONG)


def sample_verdict(error: Column, endpoint: Column, n_all: Column, n_correct_value: Column, n_illegal: Column) -> Column:
    """A sample without any argument is as right as its endpoint."""
    n_all, n_right, n_illegal = (F.coalesce(c, F.lit(0)) for c in (n_all, n_correct_value, n_illegal))
    return (
        F.when(error.isNotNull(), NONEXECUTABLE).when((endpoint == CORRECT) & (n_right == n_all), CORRECT)
        .when((endpoint == ILLEGAL) | (n_illegal > 0), ILLEGAL).otherwise(WRONG)
    )


def execution_verdict(code: Column, call: Column, complete: Column, exit_code: Column) -> Column:
    """Cause of an error, NULL if the code ran: markers at its end, no call, an open call, a failing run."""
    body = F.regexp_replace(code, r"\s+$", "")
    return (
        F.when(body.endswith("//timeout"), "timeout").when(body.endswith("//unsatisfiable_constraints"), "unsatisfiable").when(call.isNull(), "no_request")
        .when(~complete, "incomplete_request").when(F.coalesce(exit_code, F.lit(0)) != 0, "runtime_error")
    )
