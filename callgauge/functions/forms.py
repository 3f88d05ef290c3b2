"""Form bodies decoded to nested values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Places of a list that a body may leave out at once: one line must not fill a worker's memory.
GAP = 10_000


def decoded(text: str) -> dict:
    """``a[]`` appends, ``a[b][0]`` nests; a numeric next key makes a list. ValueError for an index far behind its list's end."""
    from urllib.parse import unquote

    root: dict = {}
    for pair in filter(None, text.split("&")):
        name, _, value = pair.partition("=")
        name, value = unquote(name), unquote(value)
        keys = [re.match(r"[^\[]*", name)[0], *re.findall(r"\[([^\]]*)\]", name)]
        at: dict | list = root
        for i, key in enumerate(keys):
            last = i == len(keys) - 1
            fresh = value if last else ([] if keys[i + 1] == "" or keys[i + 1].isdigit() else {})
            if isinstance(at, list):
                k = len(at) if key == "" or not key.isdigit() else int(key)
                if k > len(at) + GAP:
                    raise ValueError(f"index {k} of a list of {len(at)}")
                while len(at) <= k:
                    at.append(None)
            else:
                k = key
            held = at[k] if isinstance(at, list) else at.get(k)
            if last or not isinstance(held, dict | list):
                at[k] = held = fresh
            at = held
    return root


def body_json(body: Column) -> Column:
    """A request's body as JSON: none or ``null`` is an empty object, an object is itself, other text is a form; NULL if that can't be decoded."""

    @F.pandas_udf("string")
    def run(held: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or t.strip() in ("", "null"):
                return "{}"
            try:
                value = json.loads(t)
            except ValueError:
                value = None
            try:
                return json.dumps(value if isinstance(value, dict) else decoded(t), sort_keys=True, ensure_ascii=False)
            except ValueError:
                return None

        return held.map(one)

    return run(body)


def multipart_json(body: Column) -> Column:
    """A multipart body as a flat object of its fields' names."""

    @F.pandas_udf("string")
    def run(held: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            parts = re.findall(r'Content-Disposition: form-data; name="([^"]*)"[^\r\n]*(?:\r?\n[^\r\n]+)*\r?\n\r?\n(.*?)\r?\n--', t or "", re.S)
            return json.dumps(dict(parts), sort_keys=True, ensure_ascii=False)

        return held.map(one)

    return run(body)
