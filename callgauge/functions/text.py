"""Scalar functions over text, as expressions of built-in functions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the light stemmer.
SUFFIXES = ("ing", "ed")
# Media types by preference, and the keys of a response that count as a success.
MEDIA_TYPES = ("application/json", "application/x-www-form-urlencoded", "multipart/form-data", "text/x-markdown", "text/plain", "*/*")
RESPONSES = ("200", "default")


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters and digits."""
    bare = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")
    return F.filter(F.split(bare, " "), lambda t: t != "")


def stem(token: Column) -> Column:
    """Without ``ing`` or ``ed`` if more than two letters stay, else without a final ``s``; up to three letters stay as they are."""
    out = F.when(F.length(token) <= 3, token)
    for s in SUFFIXES:
        out = out.when(token.endswith(s) & (F.length(token) > len(s) + 2), F.substring(token, F.lit(1), F.length(token) - len(s)))
    return out.when(token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def expand(tokens_: Column, synonyms: dict[str, list[str]]) -> Column:
    """The tokens and behind them the synonyms of each, one of several words as one token."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    none = F.array().cast("array<string>")
    return F.concat(tokens_, F.flatten(F.transform(tokens_, lambda t: F.coalesce(F.try_element_at(table, t), none))))


def trigram_text(text: Column) -> Column:
    """What trigrams are taken of: lower case, everything but letters and digits one space."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9\x09-\x0D\x20]", ""), r"[\x09-\x0D\x20]+", " "))


def trigrams(plain: Column) -> Column:
    """The distinct trigrams of trigram_text(); none under three characters. One pass: the lookahead takes no character."""
    return F.array_distinct(F.regexp_extract_all(plain, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def first_sentence(text: Column, words: int = 20) -> Column:
    head = F.element_at(F.split(text, r"[.!?]"), 1)
    return F.array_join(F.slice(F.filter(F.split(head, r"\s+"), lambda w: w != ""), 1, words), " ")


def inline_comment(text: Column, target: int = 100) -> Column:
    """The first line; if longer than ``target`` up to its last full stop within 50 more characters, else its last space, else ``target`` characters."""
    line = F.trim(F.element_at(F.split(text, "\n"), 1))
    window = F.substring(line, 1, target + 50)
    stop = F.length(window) - F.locate(".", F.reverse(window)) + 1
    near = F.substring(line, 1, target)
    space = F.length(near) - F.locate(" ", F.reverse(near))
    return (
        F.when(F.length(line) <= target, line).when(window.contains("."), F.substring(line, F.lit(1), stop))
        .when(near.contains(" "), F.substring(near, F.lit(1), space)).otherwise(near)
    )


def truncate_lines(text: Column, most: int, mark: str = "[TRUNCATED]") -> Column:
    """Text up to the last line break within ``most`` characters, and a mark; a longer first line is cut at ``most``."""
    head = F.substring(text, 1, most)
    end = F.when(head.contains("\n"), F.length(head) - F.locate("\n", F.reverse(head)) + 1).otherwise(F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), end), F.lit(mark)))


def truncate_chars(text: Column, most: int, mark: str = "[TRUNCATED]") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(mark)))


def type_name(operation_id: Column, method: Column, path: Column, suffix: str = "Request") -> Column:
    """PascalCase of the operation id, else of method and path without parameters; only first letters change."""
    source = F.coalesce(operation_id, F.concat(method, F.regexp_replace(path, r"\{[^{}]*\}", "")))
    parts = F.filter(F.split(F.regexp_replace(source, "[^A-Za-z0-9]+", " "), " "), lambda p: p != "")
    return F.concat(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""), F.lit(suffix))


def json_string(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def property_name(name: Column) -> Column:
    """Bare if an identifier, else quoted."""
    return F.when(name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), name).otherwise(json_string(name))


def literal(text: Column) -> Column:
    """A literal of the target language: booleans, null and numbers bare, text quoted."""
    bare = text.rlike(r"^(true|false|null|-?\d+(\.\d+)?)$")
    return F.when(text.isNull(), F.lit("null")).when(bare, text).otherwise(json_string(text))


def sanitised(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def regex_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def output_format(name: Column, allowed: tuple[str, ...] = ("DICT", "RAW_YAML", "TYPESCRIPT")) -> Column:
    """The format that a name means in any case; another one fails."""
    wanted = F.upper(F.trim(name))
    return F.when(wanted.isin(*allowed), wanted).otherwise(F.raise_error(F.concat(F.lit("unknown output format: "), name)))


def preferred(content: Column, order: tuple[str, ...] = MEDIA_TYPES) -> Column:
    """Of a map's keys the first by preference, else its first."""
    return F.coalesce(*[F.when(F.map_contains_key(content, k), F.lit(k)) for k in order], F.get(F.map_keys(content), F.lit(0)))


def as_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)
