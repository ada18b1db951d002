"""URL filters: a tree of path templates for every host.

The paths of a host form a tree of segments. From the root down, a branch point with many different segments for its
pages is variable: its segments become one wildcard. Where the branches stay few, those whose labelled pages do not
differ significantly from all pages of the branch point are merged into the wildcard too. A page's template is what its
path becomes; templates whose smoothed share of good labelled pages is low are rejected. Explicit rules come first.

The tree is grown on branches alone: distinct (host, path) with the counts of their pages and labels. A level's tokens
are decided from counts of branches and join the distinct paths; pages are read twice, to count and to be judged. Every
join is with a table of counts, so hot hosts, templates and paths are known and joined apart (see `join_counted`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.shared import join_counted, kept

#: Host, path and verdict of the rules.
RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A branch point is variable from VARIABLE_AT different segments on, if they are at least VARIABLE_SHARE of its pages.
VARIABLE_AT, VARIABLE_SHARE = 8, 0.25
#: Branches within so many standard errors of their branch point are merged; so many labelled pages of prior; the least purity.
SIMILAR_Z, PRIOR_PAGES, LEAST_PURITY = 1.96, 10.0, 0.6
WILDCARD, NO_MORE = "*", ""


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and where there is no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty for null and where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path written as one), and its verdict; null where none fits. Of rules of
    equal length the first counts. A rule fits its host and all subdomains if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, outcome in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def path_segments(path: Column) -> Column:
    """All segments of a path; empty ones, as between two slashes, are none."""
    return F.filter(F.split(path, "/"), lambda s: s != "").alias("segments")


def grow_templates(paths: DataFrame, depth: int) -> DataFrame:
    """`paths` (host, segments, pages, labelled, good, and more) with `template`, level by level."""
    placed = paths.withColumn("template", F.lit("").cast("string"))
    for level in range(depth):
        placed = placed.withColumn("segment", F.coalesce(F.try_element_at("segments", F.lit(level + 1)), F.lit(NO_MORE)))
        branches = kept(placed.groupBy("host", "template", "segment").agg(
            F.count(F.lit(1)).alias("paths"), *[F.sum(c).alias(c) for c in ("pages", "labelled", "good")]
        ), "url-branches")
        points = kept(branches.groupBy("host", "template").agg(
            F.count_if(F.col("segment") != NO_MORE).alias("kinds"), F.count(F.lit(1)).alias("branches"),
            F.sum("pages").alias("all_pages"), F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"),
        ), "url-points")
        share = F.try_divide(F.col("all_good"), F.col("all_labelled"))
        error = F.sqrt(share * (1 - share) / F.greatest(F.col("labelled"), F.lit(1)))
        variable = (F.col("kinds") >= VARIABLE_AT) & (F.col("kinds") >= VARIABLE_SHARE * F.col("all_pages"))
        alike = F.abs(F.try_divide(F.col("good"), F.col("labelled")) - share) <= SIMILAR_Z * error + 1e-12
        judged = kept(join_counted(branches, points, ["host", "template"], "branches").select(
            "host", "template", "segment", "paths",
            F.when(F.col("segment") == NO_MORE, F.col("segment"))
            .when(variable | (F.col("kinds") > 1) & F.coalesce(alike, F.lit(True)), F.lit(WILDCARD))
            .otherwise(F.col("segment")).alias("token"),
        ), "url-tokens")
        grown = F.when(F.col("token") == NO_MORE, F.col("template")).otherwise(F.concat("template", F.lit("/"), "token"))
        placed = join_counted(placed, judged, ["host", "template", "segment"], "paths")
        placed = kept(placed.withColumn("template", grown).drop("segment", "token"), "url-placed")
    return placed


def judge(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", good: str = "good",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of `pages`.

    `labels` has (page_id, good): 1, 0 or null; of several labels of a page the smallest counts. Pages without a host
    share the template of the empty host. Paths are told apart to their full depth; empty segments are skipped. purity
    is (good + PRIOR_PAGES * overall) / (labelled + PRIOR_PAGES), overall being the share of good pages in all labelled
    ones, 1 if none is labelled; a template below LEAST_PURITY is blocked. Rows with equal ids are judged each by its
    url; a null id has no label. An empty table gives an empty result. Other columns are not read.
    """
    known = labels.select(F.col(page_id).alias("page_id"), F.col(good).cast("int").alias("good")).groupBy("page_id").agg(
        F.min("good").alias("good")
    )
    address = F.col(url).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(address).alias("host"), url_path(address).alias("path"))
    rows = kept(rows.join(known, "page_id", "left").select("page_id", "host", "path", "good"), "url-pages")
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    paths = kept(paths.select("host", "path", path_segments(F.col("path")), "pages", "labelled", "good"), "url-paths")
    bounds = paths.agg(F.max(F.size("segments")).alias("depth"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).first()
    overall = bounds["good"] / bounds["labelled"] if bounds["labelled"] else 1.0
    placed = grow_templates(paths, bounds["depth"] or 0)
    purity = kept(placed.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("paths"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled")
    ).select(
        "host", "template", "paths", ((F.col("good") + PRIOR_PAGES * overall) / (F.col("labelled") + PRIOR_PAGES)).alias("purity"),
    ), "url-purity")
    of_path = join_counted(placed.select("host", "path", "pages", "template"), purity, ["host", "template"], "paths")
    of_path = kept(of_path, "url-verdicts")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return join_counted(rows, of_path, ["host", "path"], "pages").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "template",
        F.round("purity", 6).alias("purity"),
    )
