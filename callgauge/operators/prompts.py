"""Prompts built and split, and calls taken out of generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgauge.functions.text import json_string


def setting_flags(setting: Column) -> dict[str, Column]:
    """What a setting asks for, by what its name contains."""
    return {flag: setting.contains(flag) for flag in ("spec", "rag", "constrained")}


def display_name(api: Column, *tables: dict[str, str]) -> Column:
    """The first table's name for an API that has one, else the API."""
    found = [F.try_element_at(F.create_map(*[F.lit(x) for pair in t.items() for x in pair]), api) for t in tables if t]
    return F.coalesce(*found, api)


#: What chat models are told besides, and how their names are known.
CHAT_EXTRA = " without any explanations"
CHAT_MARK, CHAT_PREFIXES = "-instruct", ("openai/", "google/")


def is_chat(model: Column) -> Column:
    out = F.contains(F.lower(model), F.lit(CHAT_MARK))
    for prefix in CHAT_PREFIXES:
        out = out | model.startswith(prefix)
    return out


def extra_instruction(model: Column) -> Column:
    """What the prompt adds for a chat model, else nothing."""
    return F.when(is_chat(model), CHAT_EXTRA).otherwise("")


def starter(code: Column, method: Column, url: Column, template_url: Column) -> Column:
    """Given code, else the call up to its URL; a template URL stands in back-ticks."""
    call = F.concat(method, F.when(template_url.isNotNull(), F.concat(F.lit("(`"), template_url, F.lit("`"))).otherwise(F.concat(F.lit("('"), url, F.lit("'"))))
    return F.concat(F.coalesce(code, F.lit("")), call)


def instantiate(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value, in the order of ``values``; a value's own braces stay as they are."""
    out, mark = F.lit(template), "\u0001{}\u0002"
    for i, name in enumerate(values):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(mark.format(i)))
    for i, value in enumerate(values.values()):
        out = F.replace(out, F.lit(mark.format(i)), value)
    return out


def split_prompt(prompt: Column, bullet: str = "* ") -> tuple[Column, Column]:
    """What stands up to the last line that starts with a bullet, and what follows it. Without a bullet: nothing, and all."""
    lines = F.split(prompt, "\n")
    last = F.coalesce(F.array_max(F.transform(lines, lambda line, i: F.when(line.startswith(bullet), i + 1).otherwise(0))), F.lit(0))
    return F.array_join(F.slice(lines, F.lit(1), last), "\n"), F.array_join(F.slice(lines, last + 1, F.size(lines)), "\n")


def variable_definitions(values: Column) -> Column:
    """A line ``const k = v;`` for each entry of a map of names to texts."""
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(F.lit("const "), e["key"], F.lit(" = "), json_string(e["value"]), F.lit(";\n"))), "")


def cleaned(output: Column, start: Column, role: str = "assistant") -> Column:
    """A chat model's output from the starter code on, without a role marker in front and without fences."""
    cut = F.when(output.contains(start), F.substring(output, F.position(start, output), F.length(output))).otherwise(output)
    bare = F.regexp_replace(cut, rf"^\s*{role}\s*:?\s*\n", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"```[a-zA-Z]*\n", ""), r"\n?```", ""))


def extract_call(code: Column, callee: str = "axios") -> tuple[Column, Column]:
    """The first call behind an empty or comment line, up to its balanced closing parenthesis, and whether it is complete.

    Parentheses inside strings count. A call that ends with the last character counts as open.
    """
    begin = F.regexp_extract(code, rf"(?s)(?:^|\n)(?:[ \t]*\n|// [^\n]*\n)[ \t]*((?:await\s+)?{callee}\..*)$", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc, c):
        depth = acc["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        closes = (acc["end"] == 0) & (c == ")") & (depth == 0)
        return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), F.when(closes, acc["at"] + 1).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(F.split(begin, ""), start, step, lambda acc: acc["end"])
    complete = (end > 0) & (end < F.length(begin))
    return F.when(begin != "", F.when(complete, F.substring(begin, F.lit(1), end)).otherwise(begin)), F.coalesce(complete, F.lit(False))
