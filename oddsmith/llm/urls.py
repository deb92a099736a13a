"""URL filter: rules by host and path, and for the rest a tree of path templates judged by smoothed labelled purity.

Per host, level by level down to each path's full depth: a segment that looks variable (numbers, long hashes), or that fewer than
``MIN_URLS`` of the host's URLs have at that place, becomes a wildcard; below a node with fewer URLs than that nothing can
stay literal, and the rest of the path is one wildcard ``**``.  Then, deepest level first, branches whose labels do not
differ significantly from their siblings' are merged.  A template is rejected when the share of good among its labelled URLs
is below a half, smoothed towards that of the same template on all hosts, that towards its host's, and that towards all URLs'.

Edge cases: a null URL, or one without ``://``, has an empty host and path and is judged like any other; repeated
rows are judged alike and all kept; with no labels at all nothing is rejected; an empty table gives an empty
result.  Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, store

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: A segment stays literal if so many URLs of the host have it at its place.
MIN_URLS = 20
#: Segments that are numbers or hold a long one, hashes, and very long ones are variable.
VARIABLE = r"^[0-9]+(\.[A-Za-z]{1,5})?$|[0-9]{4,}|^[0-9a-fA-F-]{12,}$|.{41,}"
#: Chi-square of one degree of freedom at 5 %.
SIGNIFICANT = 3.84
SMOOTH = 5.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1)).otherwise(None)
    rest = F.coalesce(F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4)), F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return ascii_lower(raw), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.  For a list of rules short enough to be written out."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _templates(paths: DataFrame) -> DataFrame:
    """Add ``template``, by as many levels as have nodes with enough URLs."""
    rows = paths.withColumn("_segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    done, level = None, 0
    while True:
        depth = F.size("_segs")
        nodes = rows.where(depth > level).groupBy("host", "template").agg(F.sum("n").alias("_n")).where(F.col("_n") >= MIN_URLS).select("host", "template", F.lit(True).alias("_open"))
        rows = rows.join(nodes, ["host", "template"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)) & (depth > level))
        rows = store(rows, "url-level")
        ended = rows.where("not _open").withColumn("template", F.concat("template", F.when(depth > level, "/**").otherwise(""))).drop("_segs", "_open")
        done = ended if done is None else done.unionByName(ended)
        if not rows.where("_open").limit(1).count():
            return done
        rows = rows.where("_open").withColumn("_seg", F.get("_segs", F.lit(level))).drop("_open")
        plain = rows.where(~F.rlike(F.col("_seg"), F.lit(VARIABLE)))
        kept = plain.groupBy("host", "template", "_seg").agg(F.sum("n").alias("_n")).where(F.col("_n") >= MIN_URLS).select("host", "template", "_seg", F.lit(True).alias("_literal"))
        rows = rows.join(kept, ["host", "template", "_seg"], "left")
        rows = rows.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("_literal"), F.col("_seg")).otherwise(F.lit("*")))).drop("_literal", "_seg")
        level += 1


def _joined(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the sums of good and bad over all rows of the same keys."""
    sums = rows.groupBy(*keys).agg(F.sum("good").alias(f"{name}_good"), F.sum("bad").alias(f"{name}_bad"))
    return rows.join(sums, keys)


def _merged(stats: DataFrame) -> DataFrame:
    """From (host, template, good, bad), add ``branch``: the template after merging, deepest level first."""
    rows = stats.withColumn("_parts", F.split("template", "/"))
    deepest = rows.agg(F.coalesce(F.max(F.size("_parts")), F.lit(1))).first()[0] - 1
    for level in range(deepest, 0, -1):
        # a path that ends above the level has no segment there and stays as it is
        star = F.transform("_parts", lambda s, i: F.when((i == level) & (s != "**"), F.lit("*")).otherwise(s))
        rows = _joined(_joined(rows.withColumn("_star", star), ["host", "_parts"], "_own"), ["host", "_star"], "_pool")
        g, b = F.col("_own_good"), F.col("_own_bad")
        rest_g, rest_b = F.col("_pool_good") - g, F.col("_pool_bad") - b
        n = F.col("_pool_good") + F.col("_pool_bad")
        cross = g * rest_b - b * rest_g
        chi2 = F.try_divide(n * cross * cross, (g + b) * (rest_g + rest_b) * F.col("_pool_good") * F.col("_pool_bad"))
        # without labels of its own a branch says nothing against its siblings, but is no part of them either
        alike = F.coalesce(chi2 < SIGNIFICANT, (g + b > 0) | (n == 0))
        rows = rows.withColumn("_parts", F.when(alike, F.col("_star")).otherwise(F.col("_parts"))).select(*stats.columns, "_parts")
        rows = store(rows, "url-merged")
    return rows.withColumn("branch", F.array_join("_parts", "/")).drop("_parts")


def template_tree(labelled: DataFrame, smooth: float = SMOOTH) -> tuple[DataFrame, DataFrame]:
    """From (host, path, label 1/0/null): the paths with their templates, and each template's branch, purity and labels.

    ``level`` says whose labels decide: the branch's, the same branch's on other hosts, the host's, or all.
    """
    good, bad = F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), good.cast("double").alias("good"), bad.cast("double").alias("bad"))
    paths = store(_templates(paths), "url-templates")
    stats = store(paths.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")]), "url-stats")
    total = stats.agg(F.sum("good"), F.sum("bad")).first()
    everywhere = total[0] / (total[0] + total[1]) if total[0] or total[1] else 1.0
    rows = _joined(_joined(_joined(_merged(stats), ["host"], "_host"), ["branch"], "_shared"), ["host", "branch"], "_own")
    prior = F.lit(everywhere)
    for name in ("_host", "_shared", "_own"):
        g, b = F.col(f"{name}_good"), F.col(f"{name}_bad")
        prior = (g + smooth * prior) / (g + b + smooth)
    has = lambda name: F.col(f"{name}_good") + F.col(f"{name}_bad") > 0
    level = F.when(has("_own"), "template").when(has("_shared"), "template on other hosts").when(has("_host"), "host").otherwise("all")
    return paths, rows.select("host", "template", "branch", prior.alias("purity"), level.alias("level"))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and whose labels decide (level) of every page.

    ``labels`` (host, path, label) trains the templates; without it the URLs that a rule decides are the labelled ones.
    """
    assert 0 <= threshold <= 1 and not math.isnan(threshold)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("_ruled", ruled)
    if labels is None:
        known = parsed.select("host", "path", F.when(F.col("_ruled") == "allow", 1).when(F.col("_ruled") == "block", 0).alias("label"))
    else:
        known = parsed.select("host", "path", F.lit(None).cast("int").alias("label")).unionByName(labels.select("host", "path", "label"))
    paths, tree = template_tree(known)
    judged = paths.select("host", "path", "template").join(tree, ["host", "template"])
    decided = F.when(F.col("purity") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return parsed.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("_ruled", decided).alias("verdict"), F.col("branch").alias("template"), "purity", "level"
    )
