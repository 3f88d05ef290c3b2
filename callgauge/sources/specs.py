"""API descriptions in YAML or JSON read by Spark and flattened to a catalog of tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions import openapi

LEGAL = "spec string, path string, method string, location string, name string, required boolean, type string"


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """spec (file name), content: whole files by any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("spec"), F.col("value").alias("content"))


def each_spec(specs: DataFrame, rows: Callable[[dict], list[tuple]], schema: str, permissive: bool = True) -> DataFrame:
    """``rows`` of each description, its name first. A broken one gives a row with its error in the last column if ``permissive``, else fails."""
    names = [c.split()[0] for c in schema.split(",")]
    wide = f"spec string, {schema}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            out = []
            for name, content in zip(batch["spec"], batch["content"], strict=True):
                try:
                    out += [(name, *r, None) for r in rows(yaml.safe_load(content))]
                except (ValueError, TypeError, AttributeError, KeyError, yaml.YAMLError, RecursionError) as e:
                    if not permissive:
                        raise
                    out.append((name, *[None] * len(names), f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["spec", *names, "error"], dtype=object)

    return specs.select("spec", "content").mapInPandas(run, wide)


def operations(specs: DataFrame) -> DataFrame:
    """spec, path, method, operation_id, summary, description, n_params, has_body, item (the prepared operation as JSON), ordinal (as declared), error."""
    def rows(spec: dict) -> list[tuple]:
        return [
            (p, m, o.get("operationId"), o.get("summary"), o.get("description"), len(o.get("parameters") or []), "requestBody" in o, json.dumps(o, default=str), i)
            for i, (p, m, o) in enumerate(openapi.operations(openapi.prepared(spec)))
        ]

    return each_spec(specs, rows, "path string, method string, operation_id string, summary string, description string, n_params int, has_body boolean, item string, ordinal int")


def servers(specs: DataFrame) -> DataFrame:
    return each_spec(specs, lambda spec: [(i, s.get("url")) for i, s in enumerate(spec.get("servers") or [])], "ordinal int, server string")


def legal_arguments(specs: DataFrame) -> DataFrame:
    """Every argument that an operation may carry: parameters, body properties, any credential of the document, Accept, and Content-Type with a body."""
    def rows(spec: dict) -> list[tuple]:
        schemes = list((spec.get("components", {}).get("securitySchemes") or {}))
        anyone = openapi.security_parameters(spec, {"security": [{n: []} for n in schemes]})
        out = []
        for path, method, o in openapi.operations(openapi.prepared(spec)):
            held = {("headers", "Accept"): (False, "string")}
            if method in ("put", "post", "patch"):
                held["headers", "Content-Type"] = (False, "string")
            place = {"query": "params", "path": "path_params", "header": "headers"}
            for p in [*anyone, *(o.get("parameters") or [])]:
                if p.get("in") in place:
                    held[place[p["in"]], p["name"]] = (bool(p.get("required", False)), str((p.get("schema") or {}).get("type", "")))
            body = openapi.body_schema(o) or {}
            for name, sub in (body.get("properties") or {}).items():
                held["data", name] = (name in (body.get("required") or []), str((sub or {}).get("type", "")))
            out += [(path, method, where, name, required, kind) for (where, name), (required, kind) in sorted(held.items())]
        return out

    return each_spec(specs, rows, "path string, method string, location string, name string, required boolean, type string")


def declarations(specs: DataFrame) -> DataFrame:
    return each_spec(specs, lambda spec: [(p, m, openapi.type_declaration(p, m, o)) for p, m, o in openapi.operations(openapi.prepared(spec))], "path string, method string, declaration string")


def documents(specs: DataFrame) -> DataFrame:
    """The retrieval corpus: each operation's texts."""
    return each_spec(specs, lambda spec: [(p, m, i, t) for p, m, o in openapi.operations(openapi.prepared(spec)) for i, t in enumerate(openapi.embedding_texts(p, m, o))], "path string, method string, variant int, content string")


def endpoints(specs: DataFrame) -> DataFrame:
    """Each operation as a record (JSON) and as the text that it is found by, references in place to any depth."""
    def rows(spec: dict) -> list[tuple]:
        out = []
        for i, (path, method, o) in enumerate(openapi.operations(openapi.prepared({**spec, "paths": openapi.resolved(spec.get("paths") or {}, spec)}))):
            e = openapi.endpoint(path, method, o)
            out.append((i, path, method, json.dumps(e, default=str), openapi.endpoint_text(e)))
        return out

    return each_spec(specs, rows, "ordinal int, path string, method string, endpoint string, content string")
