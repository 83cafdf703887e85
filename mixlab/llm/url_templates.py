"""URL verdicts by path templates learned per host (operator 7).

The paths of a host form a tree of segments. Segments that look variable (numbers, hexadecimal ids, very long
ones) become wildcards first; then, level by level, the branches below a node whose labelled shares of bad pages
do not differ from that of their siblings are merged into one wildcard branch (``*``); of those that do differ, the ones
above (``*+``) or below (``*-``) the mean that agree with each other are merged, and the others stay literal. Branches without
a labelled page say nothing about their siblings, nor these about them: they have a wildcard of their own (``*?``). A template is rejected if its smoothed share of bad pages passes one half. Everything runs on
counts per distinct path, so a host with a third of all pages is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.llm.common import saved

#: Levels of the tree; what lies deeper is one tail segment.
LEVELS = 4
#: Pseudo-counts of the smoothing: one bad page in five.
PRIOR_BAD, PRIOR_ALL = 1.0, 5.0
#: Branches whose shares differ by more than so many standard errors stay apart.
Z_LIMIT = 1.96

#: (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """Behind the host, up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (text, verdict); nulls if none does. Ties go to the smaller text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), tuple(-ord(c) for c in r[0] + r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column, levels: int = LEVELS) -> Column:
    """Path segments with variable ones as wildcards: <n>, <h> and <s>; an ending such as .html stays."""
    raw = F.split(F.regexp_replace(path, "^/", ""), "/")
    tail = F.when(F.size(raw) > levels, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    cut = F.concat(F.slice(raw, 1, levels), tail)

    def variable(s: Column) -> Column:
        s = F.regexp_replace(s, "^[0-9]+(?=$|\\.)", "<n>")
        s = F.regexp_replace(s, "^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=$|\\.)", "<h>")
        return F.when(F.length(s) > 40, F.lit("<s>")).otherwise(s)

    return F.transform(cut, variable)


def _smoothed(bad: Column, n: Column) -> Column:
    return (bad + F.lit(PRIOR_BAD)) / (n + F.lit(PRIOR_ALL))


def _differs(bad: Column, n: Column, all_bad: Column, all_n: Column, z_limit: float) -> Column:
    """Whether a branch's smoothed share is more than ``z_limit`` standard errors from that of its siblings."""
    rest_bad, rest = all_bad - bad, all_n - n
    pooled = (all_bad + 2 * PRIOR_BAD) / (all_n + 2 * PRIOR_ALL)
    error = F.sqrt(pooled * (1 - pooled) * (1 / (n + PRIOR_ALL) + 1 / (rest + PRIOR_ALL)))
    return F.abs(_smoothed(bad, n) - _smoothed(rest_bad, rest)) > z_limit * error


def templates(pages: DataFrame, levels: int = LEVELS, z_limit: float = Z_LIMIT) -> DataFrame:
    """(host, segments) -> template, share, verdict, from pages (host, segments, bad); bad is 1, 0 or null (unlabelled)."""
    leaves = pages.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = saved(leaves.withColumn("done", F.array().cast("array<string>")), "leaves")
    for level in range(levels + 1):
        child = F.get("segments", F.lit(level))
        nodes = tree.groupBy("host", "done", child.alias("child")).agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
        nodes = nodes.where("child is not null")
        labelled = F.count(F.when(F.col("known") > 0, 1)).alias("labelled")
        parents = nodes.groupBy("host", "done").agg(F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"), F.count("*").alias("children"), labelled)
        both = nodes.join(parents, ["host", "done"])
        apart = _differs(F.col("bad"), F.col("known"), F.col("all_bad"), F.col("all_known"), z_limit)
        both = both.withColumn("side", F.when(_smoothed(F.col("bad"), F.col("known")) > _smoothed(F.col("all_bad"), F.col("all_known")), 1).otherwise(0))
        both = both.withColumn("apart", apart & (F.col("known") > 0))
        # among the branches that differ, those on one side of the mean are compared once more with each other
        sides = both.where("apart").groupBy("host", "done", "side").agg(F.sum("known").alias("side_known"), F.sum("bad").alias("side_bad"), F.count("*").alias("like"))
        both = both.join(sides, ["host", "done", "side"], "left")
        again = _differs(F.col("bad"), F.col("known"), F.col("side_bad"), F.col("side_known"), z_limit)
        merged = F.when(F.col("side") == 1, "*+").otherwise("*-")
        alone = (F.col("children") == 1) | ((F.col("labelled") == 1) & (F.col("known") > 0))
        name = F.when(alone, F.col("child")).when(F.col("known") == 0, "*?").when(~F.col("apart"), "*").when((F.col("like") == 1) | again, F.col("child")).otherwise(merged)
        named = both.select("host", "done", "child", name.alias("name"))
        joined = tree.withColumn("child", child).join(named, ["host", "done", "child"], "left")
        tree = joined.withColumn("done", F.when(F.col("name").isNull(), F.col("done")).otherwise(F.concat("done", F.array("name"))))
        tree = saved(tree.select("host", "segments", "n", "known", "bad", "done"), "tree")
    sums = tree.groupBy("host", "done").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"))
    share = _smoothed(F.col("b"), F.col("k"))
    sums = sums.select("host", "done", share.alias("share"), F.when(share > 0.5, "block").otherwise("allow").alias("verdict"))
    out = tree.join(sums, ["host", "done"])
    return out.select("host", "segments", F.concat(F.lit("/"), F.array_join("done", "/")).alias("template"), "share", "verdict")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share.

    A rule's verdict stands; the rest is judged by its template. Bad and good pages to learn from are those of
    ``labels`` (page_id, bad), if given, and those that a rule decides. Null urls have an empty host
    and path and form a template of their own; repeated rows get a row each. Without labelled pages all is allowed.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": verdict, "segments": segments(F.col("path"))})
    by_rule = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    if labels is None:
        known = parsed.withColumn("bad", by_rule)
    else:
        given = labels.groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("_bad"))
        known = parsed.join(given, parsed.page_id == given["_id"], "left").withColumn("bad", F.coalesce(by_rule, "_bad")).drop("_id", "_bad")
    found = templates(known.select("host", "segments", "bad"))
    out = parsed.join(found, ["host", "segments"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "verdict").alias("verdict"), "template", F.col("share").alias("bad_share"))
