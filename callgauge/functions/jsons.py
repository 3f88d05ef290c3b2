"""JSON values that compare as the values they mean."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(value, strict: bool):
    if isinstance(value, bool):
        return int(value) if strict else value
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(v, strict) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v, strict) for k, v in value.items()}
    return value


def canonical(text: Column, booleans_are_numbers: bool = False) -> Column:
    """Canonical JSON: sorted keys, no space, whole numbers without a point; NULL for malformed text."""

    @F.pandas_udf("string")
    def run(held: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(_plain(json.loads(t), booleans_are_numbers), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return held.map(one)

    return run(text)


def unwrapped(canonical_: Column) -> Column:
    """A list of one element as that element (outside of bodies both sides are compared so)."""
    one = F.try_variant_get(F.try_parse_json(canonical_), "$[0]", "variant")
    two = F.try_variant_get(F.try_parse_json(canonical_), "$[1]", "variant")
    return F.when(canonical_.startswith("[") & one.isNotNull() & two.isNull(), F.to_json(one)).otherwise(canonical_)


def entries(text: Column) -> Column:
    """The members of an object as a map of name to the value's text; NULL if it isn't one."""
    return F.from_json(text, "map<string,string>")
