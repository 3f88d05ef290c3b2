"""Calls in generated code read as the requests that they would send, without running them.

A call's arguments are literals, names, templates and concatenations; a name whose value is given stands for it, any
other stays as ``${name}``.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from callgauge.functions.forms import decoded

BODY_METHODS = ("post", "put", "patch")
REQUEST = "url string, method string, headers map<string,string>, params map<string,string>, data map<string,string>, error string"
_TOKEN = re.compile(r"""\s*(?:(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*|\[\d+\])*)|(?P<op>\.\.\.|[{}\[\](),:+]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


class Reader:
    """A reader of the values in the arguments of a call."""

    def __init__(self, text: str, variables: dict):
        self.variables, self.tokens, at = variables, [], 0
        end = len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise ValueError(f"expected {op}")
        self.at += 1

    def text(self, raw: str) -> str:
        body = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
        if raw[0] != "`":
            return body
        return re.sub(r"\$\{([^}]*)\}", lambda m: self.shown(Reader(m[1], self.variables).value()), body)

    @staticmethod
    def shown(value) -> str:
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def named(self, name: str):
        if name in ("true", "false", "null", "undefined"):
            return {"true": True, "false": False}.get(name)
        at = self.variables
        for part in re.findall(r"[A-Za-z_$][\w$]*|\d+", name):
            try:
                at = at[int(part)] if isinstance(at, list) else at[part]
            except (KeyError, IndexError, TypeError, ValueError):
                return "${" + name + "}"
        return at

    def one(self):
        if self.at >= len(self.tokens):
            raise ValueError("the call ends early")
        kind, raw = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return float(raw) if re.search("[.eE]", raw) else int(raw)
        if kind == "str":
            return self.text(raw)
        if kind == "name":
            return self.named(raw)
        if raw == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
                if self.peek() != "]":
                    self.take(",")
            self.take("]")
            return out
        if raw == "{":
            out = {}
            while self.peek() != "}":
                if self.peek() == "...":
                    self.at += 1
                    more = self.value()
                    out |= more if isinstance(more, dict) else {}
                else:
                    kind, key = self.tokens[self.at]
                    if kind == "op":
                        raise ValueError(f"unexpected {key}")
                    self.at += 1
                    name = self.text(key) if kind == "str" else key
                    if self.peek() == ":":
                        self.at += 1
                        out[name] = self.value()
                    else:
                        out[name] = self.named(key)
                if self.peek() != "}":
                    self.take(",")
            self.take("}")
            return out
        if raw == "(":
            value = self.value()
            self.take(")")
            return value
        raise ValueError(f"unexpected {raw}")

    def value(self):
        out = self.one()
        while self.peek() == "+":
            self.at += 1
            more = self.one()
            numbers = all(isinstance(x, int | float) and not isinstance(x, bool) for x in (out, more))
            out = out + more if numbers else self.shown(out) + self.shown(more)
        return out

    def arguments(self) -> list:
        out = []
        while self.at < len(self.tokens):
            out.append(self.value())
            if self.at < len(self.tokens):
                self.take(",")
        return out


def request_of(call: str, variables: dict | None = None) -> dict:
    """url, method, headers, params and data of ``axios.<method>(…)`` or ``axios({…})``, as they would be captured.

    A query in the URL joins the parameters and wins; an empty value is true. An object as data stays one, text is
    read as JSON or a form.
    """
    m = re.match(r"\s*(?:await\s+)?axios(?:\.(\w+))?\s*\((.*)\)\s*;?\s*$", call, re.S)
    if not m:
        raise ValueError("no call")
    given = Reader(m[2], variables or {}).arguments()
    if m[1] in (None, "request"):
        config = given[0] if given and isinstance(given[0], dict) else {}
        url, method, data = config.get("url", ""), str(config.get("method", "get")).lower(), config.get("data")
    else:
        url, method, rest = (given[0] if given else ""), m[1].lower(), given[1:]
        data = rest.pop(0) if method in BODY_METHODS and rest else None
        config = rest[0] if rest and isinstance(rest[0], dict) else {}
        data = config.get("data") if data is None else data
    if isinstance(data, str):
        try:
            read = json.loads(data)
        except ValueError:
            read = None
        data = read if isinstance(read, dict) else decoded(data)
    params = config.get("params") if isinstance(config.get("params"), dict) else {}
    url, _, query = str(url).partition("?")
    from urllib.parse import unquote

    for pair in filter(None, query.partition("#")[0].split("&")):
        name, _, value = pair.partition("=")
        params = params | {unquote(name): unquote(value) or True}
    return {"url": unquote(url), "method": method, "headers": config.get("headers") or {}, "params": params, "data": data if isinstance(data, dict) else {}}


def captured(call: Column, variables: Column | None = None) -> Column:
    """request_of() of a column, its values as JSON; ``error`` says why there is no request. ``variables``: JSON objects."""
    text = lambda d: {str(k): json.dumps(v, sort_keys=True, ensure_ascii=False) for k, v in d.items()}

    @F.pandas_udf(REQUEST)
    def run(calls: pd.Series, names: pd.Series) -> pd.DataFrame:
        out = []
        for c, v in zip(calls, names, strict=True):
            try:
                r = request_of(c or "", json.loads(v) if v else {})
                out.append((r["url"], r["method"], text(r["headers"]), text(r["params"]), text(r["data"]), None))
            except (ValueError, TypeError, AttributeError, RecursionError) as e:
                out.append((None, None, {}, {}, {}, str(e)[:200]))
        return pd.DataFrame(out, columns=["url", "method", "headers", "params", "data", "error"])

    return run(call, F.lit(None).cast("string") if variables is None else variables)
