"""URL allow and block lists by hashed host-suffix and path-prefix expressions.

A URL is expanded into every expression (suffix of its host's labels) + (prefix of its path) whose
shape some rule has. Expressions meet rules by an equi-join on a short hash prefix; a match holds
once the full digests agree. The longest rule wins, and between equal lengths the smaller string.

Defined cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased, the path what follows it up to ``?``, ``#`` or the end; for a null URL, or
one without ``://``, both are empty. No rule fits an empty host. Repeated rows are all returned; an
empty rule table leaves every URL to the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8  # hexadecimal digits of the digest that the join uses


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, as strings that are never null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(after, "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the path starts
    with the rule's path.
    """
    pages = pages.select("page_id", "url")
    host, path = url_parts(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))

    listed = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")
    ).where("rule is not null")
    shapes = [tuple(r) for r in listed.select("labels", "chars").distinct().collect()]  # at most a host's labels times a path's characters
    listed = listed.withColumn("digest", _digest(F.col("rule"))).select("rule", "verdict", "digest", F.left("digest", F.lit(PREFIX_HEX)).alias("short"))

    labels, parts = F.col("labels"), []
    for count, chars in shapes:
        suffix = F.array_join(F.slice(labels, -count, count), ".")
        parts.append(F.when((F.size(labels) >= count) & (F.length("path") >= chars) & (F.col("host") != ""), F.concat(suffix, F.left("path", F.lit(chars)))))
    expressions = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    expanded = urls.withColumn("labels", F.split("host", r"\.")).select("url", F.explode(expressions).alias("expression"))
    expanded = expanded.select("url", _digest(F.col("expression")).alias("own"))
    expanded = expanded.withColumn("short", F.left("own", F.lit(PREFIX_HEX)))
    met = expanded.join(listed, "short").where("own = digest")
    best = met.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    judged = urls.join(best, "url", "left").select(F.col("url").alias("own_url"), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return pages.join(judged, F.col("url").eqNullSafe(F.col("own_url"))).select("page_id", "host", "path", "rule", "verdict")
