"""URL filters: fixed rules first, then a path-template tree learnt per host, in DataFrame functions only.

A rule names a host and a path; it fits its host and all subdomains where the path of the url starts with its own, and the longest
fitting rule decides. The urls that rules decide are the labels from which the tree learns about the others. Segments of paths lose their numbers and hexadecimal
names. From the root of each host on, a node's paths are taken to where they part, and its children are named: those with min_labels labels or more whose
share of blocked ones does not differ significantly from that of all siblings are merged into one branch, `{~}`, those that differ keep their segment however many there are;
the others, whose labels tell nothing, are variable if they are more than max_children, and merged into `{*}`. The next level is found
from the merged branches, so their counts are pooled all the way down. A template (a path of the resulting tree) is rejected if it has min_labels labels and its share of
blocked ones, smoothed by prior_weight labels at the share of the node above (which is smoothed so itself, up to the share of all), reaches purity. What has
no labels is allowed: that its siblings are blocked says nothing about it.

A round goes down to the next parting of every node at once, so there are as many rounds as a path has partings above its end; nothing is cut at a depth.
Counts are taken per distinct host and path first, so a host with a third of all pages is no hot key: groups are summed before
they are shuffled, and what was learnt returns to the paths in joins with salted keys.

Defined cases: a url that is null or has no `://` (an empty one too) has an empty host and path and no rule, and is judged as that template; a very long url is taken whole;
of rules of equal length that fit the first by text wins; repeated rows are judged alike, and a null id stays null; an empty table gives no rows; columns other
than the id and the url are not read, so their names may be any.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SALTS = 16  # over which the paths of one node or template are spread in joins
MAX_CHILDREN, MIN_LABELS, PRIOR_WEIGHT, PURITY = 12, 5, 4.0, 0.9
CHI2 = 6.63  # at one per cent


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """id_col, host, path."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.col(url_col).substr(at + 3, F.length(url_col)))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select(F.col(id_col), F.coalesce(rest, F.lit("")).alias("_rest")).select(id_col, host.alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The deciding rule as text and its verdict, null where none fits. rules: verdict, host, path; they are part of the plan, so a few hundred at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def spread(groups: DataFrame) -> DataFrame:
    """Each group once for each salt: a row for each group, so few."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def smoothed(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + F.lit(PRIOR_WEIGHT) * above) / (labelled + F.lit(PRIOR_WEIGHT))


def templates(paths: DataFrame) -> DataFrame:
    """paths: host, path, labelled, blocked. With template, salt, and above, the smoothed share of the node over the template's end."""
    share = paths.agg((F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0))).alias("p")).first()["p"] or 0.0
    segment = lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{h}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
    rest = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), segment)
    rows = paths.select("host", "path", "labelled", "blocked", F.array().cast("array<string>").alias("node"), rest.alias("rest"), F.lit(float(share)).alias("above"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    settled, open_ = [], written(rows, "urls")
    lo, hi, skip = F.col("lo"), F.col("hi"), F.col("skip")
    equal = F.aggregate(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), F.lit(0), lambda n, i: F.when((n == i - 1) & F.element_at(lo, i).eqNullSafe(F.element_at(hi, i)), n + 1).otherwise(n))
    while not open_.isEmpty():
        nodes = open_.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), smoothed(F.sum("blocked"), F.sum("labelled"), F.max("above")).alias("own"))
        nodes = nodes.select("host", "node", "own", (lo == hi).alias("one"), F.slice(lo, F.lit(1), equal).alias("common")).withColumn("skip", F.size("common"))
        # to where paths part; those that end there, or never part from others of their node, are settled
        seen = open_.join(spread(nodes), ["host", "node", "salt"])
        ends = F.col("one") | (F.size("rest") == skip)
        step = written(seen.select("host", "path", "labelled", "blocked", "salt", F.concat("node", F.when(F.col("one"), F.col("rest")).otherwise(F.col("common"))).alias("node"), F.when(~ends, F.element_at("rest", skip + 1)).alias("child"),
            F.when(~ends, F.slice("rest", skip + 2, F.size("rest"))).alias("rest"), F.when(F.col("one"), F.col("above")).otherwise(F.col("own")).alias("above")), "urls")
        settled.append(step.where("child is null"))
        going = step.where("child is not null")
        children = going.groupBy("host", "node", "child").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        known = F.col("l") >= MIN_LABELS
        family = children.groupBy("host", "node").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count(F.when(known, 1)).alias("known"), F.count(F.when(~known, 1)).alias("unknown"))
        d = lambda c: F.col(c).cast("double")
        off = d("b") * d("all_l") - d("all_b") * d("l")
        similar = off * off <= F.lit(CHI2) * d("all_b") * (d("all_l") - d("all_b")) * d("l")
        label = F.when(~known & (F.col("unknown") > MAX_CHILDREN), "{*}").when(known & (F.col("known") > 1) & similar, "{~}").otherwise(F.col("child"))
        named = children.join(family, ["host", "node"]).select("host", "node", "child", label.alias("label"))
        moved = going.join(spread(named), ["host", "node", "child", "salt"])
        after = written(moved.select("host", "path", "labelled", "blocked", "salt", F.concat("node", F.array("label")).alias("node"), "rest", "above"), "urls")
        settled.append(after.where("size(rest) = 0"))
        open_ = after.where("size(rest) > 0")
    out = [x.select("host", "path", "labelled", "blocked", F.array_join("node", "/").alias("template"), "above", "salt") for x in settled]
    return reduce(DataFrame.unionByName, out) if out else rows.select("host", "path", "labelled", "blocked", F.lit("").alias("template"), "above", "salt")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, template, verdict for each row of pages."""
    rule, verdict = ruled(rules)
    seen = parsed(pages, id_col, url_col).withColumns({"rule": rule, "ruling": verdict})
    paths = written(seen.groupBy("host", "path").agg(F.count("ruling").alias("labelled"), F.count(F.when(F.col("ruling") == "block", 1)).alias("blocked")), "paths")
    placed = templates(paths)
    found = placed.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max("above").alias("above"))
    bad = (F.col("l") >= MIN_LABELS) & (smoothed(F.col("b"), F.col("l"), F.col("above")) >= PURITY)
    verdicts = found.select("host", "template", F.when(bad, "block").otherwise("allow").alias("learnt"))
    by_path = placed.join(spread(verdicts), ["host", "template", "salt"]).select("host", "path", "template", "learnt")
    return seen.join(by_path, ["host", "path"]).select(id_col, "host", "path", "rule", "template", F.coalesce("ruling", "learnt").alias("verdict"))
