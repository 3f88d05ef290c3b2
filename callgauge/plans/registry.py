"""All queries of the library but the corpus operators'."""

from __future__ import annotations

from collections.abc import Callable

from callgauge.plans import crosscheck, evaluate, evaluation, reports, retrieve, specs, texts, urls

FAMILIES = (evaluation, urls, texts, reports, specs, evaluate, crosscheck, retrieve)


def queries() -> dict[str, Callable]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.SQL.items()}
