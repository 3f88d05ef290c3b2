"""Endpoints found for tasks: descriptions to documents, scores, one row an operation, and the text handed on."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions import text as fn
from callgauge.operators import retrieval
from callgauge.plans import specs as mini
from callgauge.sources import specs
from callgauge.sources.files import kept

BUDGET = 8000  #: characters handed on


def found_operations(tasks: DataFrame, descriptions: DataFrame, k: int = 5, boost: DataFrame | None = None) -> DataFrame:
    """``tasks`` (task_id, task) with up to ``k`` operations each: rank, path, method, score. All texts of an operation compete, its best one counts."""
    texts = specs.documents(descriptions).filter("error IS NULL").withColumn("doc_id", F.xxhash64("spec", "path", "method", "variant"))
    scored = retrieval.cfidf_scores(texts, tasks, "doc_id", "task_id", F.col("content"), F.col("task"), F.col("path"))
    if boost is not None:
        bonus = retrieval.keyword_boost(tasks, texts, boost, "task_id", "doc_id", F.col("task"), F.col("path"))
        scored = scored.join(bonus, ["task_id", "doc_id"], "left")
        scored = scored.select("task_id", "doc_id", retrieval.hybrid(scored, {"score": 1.0, "bonus": 1.0}).alias("score"))
    named = scored.join(texts.select("doc_id", "spec", "path", "method", "variant"), "doc_id")
    wide = retrieval.top(named, "task_id", 5 * k, F.col("score").desc(), F.col("path"), F.col("method"), F.col("variant"))
    one = wide.groupBy("task_id", "spec", "path", "method").agg(F.min("rank").alias("_r"), F.max("score").alias("score"))
    return retrieval.top(one, "task_id", k, F.col("_r"))


def found_by_vectors(tasks: DataFrame, descriptions: DataFrame, embed: Callable, k: int = 5, rerank: Callable | None = None) -> DataFrame:
    """Like found_operations(), by injected models: ``embed`` and ``rerank`` as retrieval.embedded() and reranked() take them.

    The nearest 5 ``k`` texts of a task's own vector by L2 become operations, each at the place of its first text; with
    ``rerank`` at least retrieval.CANDIDATES are scored again against the task, from high to low. score: a negative distance or the new score.
    """
    wide = max(5 * k, retrieval.CANDIDATES if rerank else 0)
    texts = kept(specs.documents(descriptions).filter("error IS NULL").withColumn("doc_id", F.xxhash64("spec", "path", "method", "variant")), "texts")
    own, asked = retrieval.embedded(texts, embed, "doc_id", "content"), retrieval.embedded(tasks, embed, "task_id", "task")
    near = retrieval.vector_topk(kept(asked.withColumnRenamed("task_id", "doc_id"), "asked"), kept(own, "vectors"), wide, "doc_id")
    named = near.join(texts.select("doc_id", "spec", "path", "method", "content"), "doc_id").withColumnRenamed("query_id", "task_id")
    one = named.groupBy("task_id", "spec", "path", "method").agg(F.min("rank").alias("_r"), F.min_by("content", "rank").alias("content"), (-F.min("distance")).alias("score"))
    if rerank is None:
        return retrieval.top(one, "task_id", k, F.col("_r")).drop("_r", "content")
    pairs = one.join(tasks.select("task_id", "task"), "task_id")
    again = retrieval.reranked(pairs, rerank, "task", "content")
    return retrieval.top(again, "task_id", k, F.col("score").desc(), F.col("_r")).drop("_r", "content", "task")


#: Fixed value: what marks a text that was cut.
CUT = "[TRUNCATED]"


def wrapped(found: DataFrame, descriptions: DataFrame, budget: int | None = None) -> DataFrame:
    """task_id, context: title and first server of the API and the endpoints found, in order, as YAML; cut to ``budget`` characters and marked."""
    heads = specs.each_spec(descriptions, lambda spec: [((spec.get("info") or {}).get("title"), (spec.get("servers") or [{}])[0].get("url"))], "title string, server string").filter("error IS NULL")
    ends = specs.endpoints(descriptions).filter("error IS NULL").select("spec", "path", "method", "endpoint")
    told = found.join(ends, ["spec", "path", "method"]).groupBy("task_id", "spec").agg(F.array_sort(F.collect_list(F.struct("rank", "endpoint"))).alias("_e")).join(heads, "spec")

    @F.pandas_udf("string")
    def shown(title: pd.Series, server: pd.Series, listed: pd.Series) -> pd.Series:
        import yaml

        one = lambda t, s, e: yaml.safe_dump({"title": t, "server_url": s, "paths": [json.loads(x) for x in e]}, indent=2, width=float("inf"), allow_unicode=True, sort_keys=False)
        return pd.Series([one(*x) for x in zip(title, server, listed, strict=True)], dtype=object)

    whole = shown("title", "server", F.transform("_e", lambda e: e["endpoint"]))
    if budget is not None:
        whole = F.when(F.length(whole) > budget, F.concat(F.substring(whole, 1, budget), F.lit(CUT))).otherwise(whole)
    return told.select("task_id", whole.alias("context"))


def context(found: DataFrame, descriptions: DataFrame, budget: int = BUDGET) -> DataFrame:
    """task_id, context: the declarations of the operations found, in order, cut at a line within the budget."""
    shown = specs.declarations(descriptions).filter("error IS NULL").select("spec", "path", "method", "declaration")
    told = found.join(shown, ["spec", "path", "method"]).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "declaration"))).alias("_d"))
    whole: Column = F.array_join(F.transform("_d", lambda d: d["declaration"]), "\n\n")
    return told.select("task_id", fn.truncate_lines(whole, budget).alias("context"))


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "Remove an item"), (1, "Which items are there? Fetch the first three"), (2, "Append, insert: request body with name, size, parts, free")], "task_id int, task string")


def spec_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_operations(tasks(spark), mini.mini(spark).filter("spec = 'mini'"), 2).select("task_id", "rank", "path", "method", "score")


def spec_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mini.mini(spark).filter("spec = 'mini'")
    return context(found_operations(tasks(spark), own, 2), own, 300)


def spec_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.endpoints(mini.mini(spark).filter("spec = 'mini'")).drop("error")


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (spec_retrieval, spec_context, spec_endpoints)}
