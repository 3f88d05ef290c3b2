"""Grids, pivots, gains, ranked flags and small statistics for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def experiment_grid(spark: SparkSession, axes: dict[str, list[str]], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Every combination of the axes' values; a value outside of ``allowed`` fails. A few values an axis, so rows are made on one side."""
    for name, values in axes.items():
        if unknown := sorted(set(values) - set((allowed or axes)[name])):
            raise ValueError(f"unknown {name}: {unknown}")
    rows = reduce(lambda done, axis: [(*r, v) for r in done for v in axis], axes.values(), [()])
    return spark.createDataFrame(rows, ", ".join(f"{a} string" for a in axes))


def not_in(have: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of ``have`` that ``allowed`` lacks, as often as they are too many."""
    return have.exceptAll(allowed)


def todo(tasks: DataFrame, done: DataFrame, keys: list[str], greedy: bool = True) -> DataFrame:
    """Tasks without an output; with sampling (not greedy) all of them."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti") if greedy else tasks


def pivoted(long: DataFrame, rows: list[str], column: str, values: list[str], value: Column) -> DataFrame:
    """One column a value, in the given order."""
    return long.groupBy(*rows).pivot(column, values).agg(value)


def gains(results: DataFrame, before: str, after: str) -> DataFrame:
    """``results`` with gain: the relative one, NULL where ``before`` isn't above 0. Rows that lack either are dropped."""
    both = results.filter(F.col(before).isNotNull() & F.col(after).isNotNull())
    return both.withColumn("gain", F.when(F.col(before) > 0, F.round((F.col(after) - F.col(before)) / F.col(before), 6)))


def summary_rows(table: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """``table`` and rows Average, Minimum and Maximum over it, missing values passed over."""
    def row(name: str, f) -> DataFrame:
        return table.agg(*[F.round(f(F.nanvl(F.col(c).cast("double"), F.lit(None))), 6).alias(c) for c in columns]).select(F.lit(name).alias(label), *columns)

    kept = table.select(F.col(label).cast("string").alias(label), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns])
    return reduce(DataFrame.unionByName, [row("Average", F.avg), row("Minimum", F.min), row("Maximum", F.max)], kept)


def mask(long: DataFrame, excluded: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """NULL where ``excluded`` lists the keys."""
    marks = excluded.select(*keys).distinct().withColumn("_na", F.lit(True))
    return long.join(F.broadcast(marks), keys, "left").withColumn(value, F.when(F.col("_na").isNull(), F.col(value))).drop("_na")


def best_flags(long: DataFrame, metric: str, value: str, lower_is_better: Column) -> DataFrame:
    """``long`` with best: the lowest or highest value of its metric, ties included, NULLs never."""
    of = Window.partitionBy(metric)
    target = F.when(lower_is_better, F.min(value).over(of)).otherwise(F.max(value).over(of))
    return long.withColumn("best", F.coalesce(F.col(value) == target, F.lit(False)))


def inverted(value: Column, name: Column, lower_is_better: Column) -> tuple[Column, Column]:
    """A value where lower is better as 1 - value, its name as such."""
    return F.when(lower_is_better, 1 - value).otherwise(value), F.when(lower_is_better, F.concat(F.lit("1 - "), name)).otherwise(name)


def runtime_statistics(runs: DataFrame, keys: list[str], value: str, token_count: Column | None = None) -> DataFrame:
    """mean, sample deviation (0 for one run), least, most, and the rate a second of the tokens (0 if the mean is 0)."""
    out = runs.groupBy(*keys).agg(
        F.count(value).alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("stdev"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("_mean"),
        *([F.max(token_count).alias("tokens")] if token_count is not None else []),
    )
    if token_count is None:
        return out.drop("_mean")
    return out.withColumn("rate", F.when(F.col("_mean") == 0, 0.0).otherwise(F.round(F.try_divide(F.col("tokens"), F.col("_mean")), 6))).drop("_mean")


def selected(wide: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """Metrics as rows (key, metric, label, lower, value), those that ``labels`` (metric, label, lower) names; an absent value is 0."""
    names = [c for c in wide.columns if c != key]
    long = wide.unpivot([key], [F.col(c).cast("double").alias(c) for c in names], "metric", "value")
    return long.join(F.broadcast(labels), "metric").select(key, "metric", "label", "lower", F.coalesce("value", F.lit(0.0)).alias("value"))


def greedy_chunks(rows: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """group, chunk, first, last, total: runs of a bounded group's rows, each ended by the row that lifts its sum above ``most``; the rest is the last."""
    seq = F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), size.cast("long").alias("s"))))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("chunk"), F.array().cast("array<struct<o:bigint,s:bigint,chunk:bigint>>").alias("out"))

    def step(acc, x):
        total = acc["sum"] + x["s"]
        full = total > most
        return F.struct(
            F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"), F.when(full, acc["chunk"] + 1).otherwise(acc["chunk"]).alias("chunk"),
            F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), x["s"].alias("s"), acc["chunk"].alias("chunk")))).alias("out"),
        )

    each = rows.groupBy(group).agg(seq.alias("_q")).select(group, F.explode(F.aggregate("_q", start, step, lambda acc: acc["out"])).alias("_x"))
    return each.groupBy(group, F.col("_x.chunk").alias("chunk")).agg(F.min("_x.o").alias("first"), F.max("_x.o").alias("last"), F.sum("_x.s").alias("total"))


def top_valid(scored: DataFrame, key: str, token: str, score: str, valid: Column, k: int) -> DataFrame:
    """The ``k`` valid tokens of highest score of each key, and whether the first of them isn't the highest of all."""
    of = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(token))
    ranked = scored.withColumn("_place", F.row_number().over(of)).filter(valid)
    left = Window.partitionBy(key).orderBy("_place")
    return ranked.withColumn("rank", F.row_number().over(left)).filter(F.col("rank") <= k).select(key, token, score, "rank", ((F.col("rank") == 1) & (F.col("_place") > 1)).alias("intervened"))


def latex(table: DataFrame, label: str, columns: list[str], rows: int = 500) -> str:
    """A report's table, its best values bold; a report has few rows, more than ``rows`` fail."""
    got = table.select(label, *columns).limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError("too many rows for a report")
    lines = []
    for r in got:
        held = [r[c] for c in columns]
        best = max((v for v in held if v is not None), default=None)
        cells = ["--" if v is None else rf"\textbf{{{v:.2f}}}" if v == best else f"{v:.2f}" for v in held]
        lines.append(" & ".join([str(r[label]).replace("_", r"\_"), *cells]) + r" \\")
    head = " & ".join(["", *(c.replace("_", r"\_") for c in columns)]) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{l{'r' * len(columns)}}}", r"\toprule", head, r"\midrule", *lines, r"\bottomrule", r"\end{tabular}"])


#: How names are shortened in tables.
SHORT_NAMES = (("argument Jaccard", "arg. Jaccard"), ("argument value conditional accuracy", "arg. val. cond. acc."))
SHORT_HEADS = (("Invocation", "inv."), ("Endpoint", "endp."), ("vanilla", "UD"), ("constrained", "CD"))


def shortened(name: Column, names: tuple = SHORT_NAMES) -> Column:
    for long, short in names:
        name = F.replace(name, F.lit(long), F.lit(short))
    return name


def rotated(head: Column, width: int = 20, angle: int = 45) -> Column:
    """A column's head for LaTeX, shortened and turned."""
    return F.concat(F.lit(rf"\makebox[{width}pt][l]{{\rotatebox{{{angle}}}{{"), shortened(head, SHORT_HEADS), F.lit("}}"))


def broken_label(label: Column, threshold: int) -> Column:
    """A label longer than ``threshold`` with a line break for its first space from a third of its length on."""
    third = F.floor(F.length(label) / 3).cast("int")
    ahead = F.instr(F.substring(label, third + 1, F.length(label)), F.lit(" "))
    broken = F.concat(F.substring(label, F.lit(1), third + ahead - 1), F.lit("\n"), F.substring(label, third + ahead + 1, F.length(label)))
    return F.when((F.length(label) > threshold) & (ahead > 0), broken).otherwise(label)


def summary_lines(rates: DataFrame, group: str) -> DataFrame:
    """line: a rollup of hit rates (group, n, percent) as lines of a report, all rows last."""
    line = F.format_string("%s: %d samples, %.2f %%", F.coalesce(F.col(group).cast("string"), F.lit("all")), "n", "percent")
    return rates.orderBy(F.col(group).isNull(), group).select(line.alias("line"))
