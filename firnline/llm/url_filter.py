"""URL filter by a path-template tree for each host.

Urls become (host, path) pairs with counts before anything else. Level by level, a host's branches are
generalised: digits and long hexadecimal runs become classes; branches of a node with more than
``MANY`` children that hold less than ``SMALL`` of the node's urls become the wildcard; and a labelled
branch whose share of bad urls does not differ from its labelled siblings' (a two-sided test of
one proportion at ``Z``) is merged with them. What is left is a template. Its purity, the share of bad
among its labelled urls, is smoothed by ``STRENGTH`` urls that are as bad as the rest of its parent, whose
share is smoothed likewise by the rest of its own parent, up to the host, smoothed by urls that are half
bad. Every labelled url counts once, and a template without labelled urls takes its parent's purity. A
template is rejected from ``REJECT`` on. Rows with a rule have the rule's verdict; they are the labelled
rows.

Everything is grouping and joining of (host, prefix, segment) rows; the tree never stands in one task.
Paths deeper than ``DEPTH`` segments end in one segment that stands for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import checkpointed, table

DEPTH = 8
MANY = 20
SMALL = 0.05
Z = 1.96
STRENGTH = 5.0
REJECT = 0.75

#: The rules of the query, (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as ``host + path``, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments with digits and long hexadecimal runs generalised, the part beyond
    ``DEPTH`` as one segment."""
    general = F.regexp_replace(
        F.regexp_replace(path, r"(?i)\b(?=[0-9a-f-]*[0-9])[0-9a-f][0-9a-f-]{15,}\b", "{hex}"), r"[0-9]+", "{n}"
    )
    parts = F.split(F.regexp_replace(general, "^/", ""), "/")
    deep = F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("{rest}")))
    return F.when(F.size(parts) > DEPTH, deep).otherwise(parts)


def grown(paths: DataFrame, level: int) -> DataFrame:
    """One level of the tree: ``prefix`` takes the segment of this level, generalised."""
    has = F.size("parts") > level
    rows = paths.withColumn("part", F.when(has, F.element_at("parts", F.lit(level + 1))))
    nodes = rows.where(has).groupBy("host", "prefix", "part").agg(
        F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad")
    )
    parents = nodes.groupBy("host", "prefix").agg(
        F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bad"))
    )
    rest_known = F.col("all_known") - F.col("known")
    rate = (F.col("all_bad") - F.col("bad") + 1) / (rest_known + 2)
    spread = F.sqrt(rate * (1 - rate) * F.greatest("known", F.lit(1)))
    tested = (F.col("known") > 0) & (rest_known > 0)
    alike = tested & (F.abs(F.col("bad") - F.col("known") * rate) < Z * spread)
    token = (
        F.when((F.col("children") > MANY) & (F.col("n") < SMALL * F.col("all_n")), "*")
        .when(alike, "~")
        .otherwise(F.col("part"))
    )
    tokens = nodes.join(parents, ["host", "prefix"]).select(
        F.col("host").alias("t_host"), F.col("prefix").alias("t_prefix"), F.col("part").alias("t_part"), token.alias("token")
    )
    same = [
        F.col("host") == F.col("t_host"),
        F.col("prefix") == F.col("t_prefix"),
        F.col("part") == F.col("t_part"),
    ]
    return rows.join(tokens, same, "left").select(
        "host",
        "path",
        "parts",
        F.when(F.col("token").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "token")).alias("prefix"),
        "n",
        "known",
        "bad",
    )


def templates(rows: DataFrame) -> DataFrame:
    """``(host, path, template, purity)`` for each pair of ``rows(host, path, label)``; label is
    "allow", "block" or null."""
    bad, known = (F.col("label") == "block").cast("long"), F.col("label").isNotNull().cast("long")
    paths = (
        rows.groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.sum(known).alias("known"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
        .withColumn("parts", segments(F.col("path")))
        .withColumn("prefix", F.lit(""))
    )
    paths = checkpointed(paths)
    depth = paths.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(depth):
        paths = checkpointed(grown(paths, level))
    judged = purities(paths.groupBy("host", "prefix").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")))
    return paths.join(judged, (F.col("host") == F.col("j_host")) & (F.col("prefix") == F.col("template"))).select(
        "host", "path", "template", "purity"
    )


def purities(by_template: DataFrame) -> DataFrame:
    """``(j_host, template, purity)`` of ``by_template(host, prefix, known, bad)``; from the host down,
    each node's labelled urls outside the next node on the way, then the template's own."""
    parts = F.split("prefix", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    on_the_way = by_template.select("host", "prefix", "known", "bad", F.posexplode(above).alias("level", "node"))
    nodes = on_the_way.groupBy("host", "level", "node").agg(
        F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad")
    )
    ways = (
        on_the_way.select("host", "prefix", "level", "node")
        .join(nodes, ["host", "level", "node"])
        .groupBy("host", "prefix")
        .agg(F.sort_array(F.collect_list(F.struct("level", "all_known", "all_bad"))).alias("way"))
    )

    def outside(node: Column, i: Column) -> Column:
        below = F.get("way", i + 1)
        return F.struct(
            (node["all_known"] - F.coalesce(below["all_known"], F.lit(0))).alias("known"),
            (node["all_bad"] - F.coalesce(below["all_bad"], F.lit(0))).alias("bad"),
        )

    purity = F.aggregate(
        F.transform("way", outside),
        F.lit(0.5),
        lambda p, x: (x["bad"] + STRENGTH * p) / (x["known"] + STRENGTH),
    )
    return ways.select(F.col("host").alias("j_host"), F.col("prefix").alias("template"), purity.alias("purity"))


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``(row, host, path, rule, verdict, template, purity)``, one row for each row of ``pages``,
    which is kept as a struct. Null urls and urls without ``://`` have an empty host and path and
    are judged like any other; without labelled rows every template has purity 0.5 and is allowed."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*pages.columns).alias("row"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "label": verdict})
    found = templates(rows.select("host", "path", "label")).select(
        F.col("host").alias("f_host"), F.col("path").alias("f_path"), "template", "purity"
    )
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return rows.join(found, (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path"))).select(
        "row", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "purity"
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per page, with the template and its purity."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("row.page_id", "host", "path", "rule", "verdict", "template", "purity")
