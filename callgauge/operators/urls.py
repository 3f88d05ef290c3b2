"""URLs against servers and path templates, and what they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a catalog table is broadcast; a larger one is joined by shuffle.
CATALOG_ROWS = 200_000


def _small(df: DataFrame, rows: int = CATALOG_ROWS) -> DataFrame:
    """A catalog side, broadcast if it is small by count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(at)).filter("_rank = 1").drop("_rank")


def strip_server(urls: DataFrame, servers: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``urls`` (keys, url) with server and rest: the first non-empty server, by ordinal, that the URL starts with.

    ``servers``: ordinal, server. URLs without one keep NULLs. The theta join is over origins: scheme and host are
    an equality, so only servers of the same host are tried. ``by``: columns of both sides that have to be equal, too.
    """
    host = lambda c: F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    listed = _small(servers.filter("server <> ''").select(*[F.col(c).alias(f"_{c}") for c in by], "ordinal", "server", host("server").alias("_h")))
    u = urls.select(*keys, *by, "url", host("url").alias("_host"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    hits = u.join(listed, [F.col("_host") == F.col("_h"), F.col("url").startswith(F.col("server")), *same])
    best = hits.groupBy(*keys).agg(F.min_by("server", "ordinal").alias("server"))
    return u.join(best, keys, "left").select(*keys, *by, "url", "server", F.when(F.col("server").isNotNull(), F.expr("substring(url, length(server) + 1)")).alias("rest"))


def path_part(url: Column) -> Column:
    """Of a URL or its rest: what stands before a query or fragment."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def path_of(url: Column) -> Column:
    """The path of a whole URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(path: Column) -> Column:
    return F.split(path, "/")


def is_parameter(segment: Column) -> Column:
    return segment.rlike(r"^\{[^{}]+\}$")


def match_templates(paths: DataFrame, templates: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """All templates that each path fits whole: keys, path, ordinal, template, n_params.

    ``templates``: ordinal, template; a parameter ``{x}`` stands for one or more characters but ``/ ? &``. Templates
    meet paths by their number of segments and their first segment, those that begin with a parameter by the number
    alone. Whole-segment parameters are compared segment by segment, others by a pattern. ``by``: columns of both sides
    that have to be equal, too.
    """
    t = templates.select(
        *[F.col(c).alias(f"_{c}") for c in by], "ordinal", "template", F.regexp_count("template", F.lit(r"\{[^{}]+\}")).alias("n_params"), segments(F.col("template")).alias("_ts"), F.size(segments(F.col("template"))).alias("_n"),
        F.concat(F.lit(r"^\Q"), F.regexp_replace("template", r"\{[^{}]+\}", r"\\E[^/?&]+\\Q"), F.lit(r"\E$")).alias("_pattern"),
    ).withColumn("_first", F.get("_ts", F.lit(1)))
    p = paths.select(*keys, *by, "path", segments(F.col("path")).alias("_ps"), F.size(segments(F.col("path"))).alias("_m"))
    whole = F.forall("_ts", lambda s: is_parameter(s) | ~s.contains("{"))
    alike = F.forall(F.zip_with("_ts", "_ps", lambda s, v: F.when(is_parameter(s), v.rlike("^[^/?&]+$")).otherwise(s == v)), lambda ok: ok)
    fits = F.when(whole, alike).otherwise(F.expr("path rlike _pattern"))
    same = [F.col("_m") == F.col("_n"), fits, *[F.col(c) == F.col(f"_{c}") for c in by]]
    open_ = F.coalesce(F.col("_first").contains("{"), F.lit(True))
    fixed = p.join(_small(t.filter(~open_)), [F.get("_ps", F.lit(1)) == F.col("_first"), *same])
    return fixed.unionByName(p.join(_small(t.filter(open_)), same)).select(*keys, *by, "path", "ordinal", "template", "n_params")


def best_template(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Of each path's templates the one with the fewest parameters, then the longest, then the first."""
    return _first(matches, keys, F.col("n_params"), F.length("template").desc(), F.col("ordinal"))


def path_parameters(matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, value of the parameters of ``matched`` (path, template), whole segments or parts of one."""
    pattern = F.concat(F.lit(r"^\Q"), F.regexp_replace("template", r"\{[^{}]+\}", r"\\E([^/?&]+)\\Q"), F.lit(r"\E$"))
    names = F.regexp_extract_all("template", F.lit(r"\{([^{}]+)\}"), F.lit(1))
    held = matched.select(*keys, "path", pattern.alias("_pattern"), F.posexplode(names).alias("_i", "name"))
    return held.select(*keys, "name", F.expr("regexp_extract(path, _pattern, _i + 1)").alias("value"))


def action_suffix(path: Column) -> Column:
    """The ``:action`` behind a path, or an empty string."""
    return F.regexp_extract(path, r"(:[A-Za-z]+)$", 1)


def normal_segments(path: Column) -> Column:
    """Segments without empty ones and without the action; ``{x}`` and ``<x>`` become a wildcard."""
    bare = F.regexp_replace(path, r":[A-Za-z]+$", "")
    return F.transform(F.filter(F.split(bare, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"^(\{.*\}|<.*>)$"), F.lit("*")).otherwise(s))


def match_segments(urls: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, template: the first template of the same method, number of segments and action whose segments agree; wildcards agree with all."""
    t = templates.select("ordinal", "template", F.col("method").alias("_method"), normal_segments(F.col("template")).alias("_ts"), action_suffix(F.col("template")).alias("_ta"), F.size(normal_segments(F.col("template"))).alias("_n"))
    u = urls.select(*keys, "method", normal_segments(F.col("path")).alias("_us"), action_suffix(F.col("path")).alias("_ua"), F.size(normal_segments(F.col("path"))).alias("_m"))
    agree = F.forall(F.zip_with("_ts", "_us", lambda a, b: (a == "*") | (b == "*") | (a == b)), lambda ok: ok)
    hits = u.join(_small(t), (F.col("_method") == F.col("method")) & (F.col("_n") == F.col("_m")) & (F.col("_ta") == F.col("_ua")) & agree)
    best = hits.groupBy(*keys).agg(F.min_by("template", "ordinal").alias("template"))
    return u.select(*keys, "method").join(best, keys, "left")


def url_decoded(text: Column) -> Column:
    """Percent escapes decoded, a plus sign kept, malformed text unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def query_parameters(urls: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """keys, name, value: the last value of each name in the query; an empty or absent value is ``true``."""
    query = F.regexp_extract(F.regexp_extract(F.col(url), r"^([^#]*)", 1), r"\?(.*)$", 1)
    each = urls.select(*keys, F.posexplode(F.filter(F.split(query, "&"), lambda x: x != "")).alias("_i", "_x"))
    name, value = url_decoded(F.regexp_extract("_x", "^([^=]*)", 1)), url_decoded(F.regexp_extract("_x", "=(.*)$", 1))
    pairs = each.select(*keys, "_i", name.alias("name"), F.when(value == "", F.lit("true")).otherwise(value).alias("value"))
    return pairs.groupBy(*keys, "name").agg(F.max_by("value", "_i").alias("value"))


def api_specific(url: Column) -> Column:
    """Addresses of two APIs whose endpoint isn't in the path alone: module and action are kept of one's query, the other's token becomes a parameter."""
    # fixed values: hosts and shapes of the two APIs
    module, action = F.regexp_extract(url, r"[?&]module=([^&#]*)", 1), F.regexp_extract(url, r"[?&]action=([^&#]*)", 1)
    scan = F.concat(path_part(url), F.lit("?module="), module, F.lit("&action="), action)
    return F.when(url.contains("etherscan.io") & (module != "") & (action != ""), scan).when(url.contains("api.telegram.org"), F.regexp_replace(url, r"/bot[^/]*/", "/bot{token}/")).otherwise(url)
