"""URL filters: stated rules by host and path, and a tree of path templates that extends them to URLs without a rule.

For each host, paths are read segment by segment. A segment stays as it is where it makes up a fair share of its node's
paths; all others are variable and become one wildcard. Then, from the leaves up, branches of a node are merged whose next
segments and labels don't differ by more than chance (Hoeffding bounds). A template's share of good labels, smoothed towards
its host's and that towards all hosts', decides: below `least_purity` its URLs are blocked.

URLs are counted by distinct host and path first, all counts are sums that Spark combines before it shuffles, and only what
is bounded is put into one list: a node has at most 1 / SHARE branches with a name of their own, a wildcard and an end. Joins
back to the paths have hot keys (a host may hold a third of all paths); they are sort-merge joins that adaptive execution
splits, as the side of nodes has one row for each key.

Defined cases: null URLs and those without `://` have an empty host and path; segments from the DEPTH-th on count as one
tail; empty segments don't count; without labels every template has the prior of a half, which is allowed; repeated rows are
judged alike; an empty table gives an empty result. Of the input's columns, only the id and the URL are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A segment keeps its name if it is in at least this share of its node's paths, and in at least LEAST paths.
SHARE, LEAST = 0.05, 3
DEPTH = 8
#: Error probability of each comparison of two branches, and pseudo-labels that pull a template's purity to its host's.
ALPHA, WEIGHT = 0.05, 5.0
WILD, TAIL, END = "*", "**", ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, and all paths that start with this one."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract (fixed values).
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z only) and the path, as they stand in the URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_index(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The number of the longest rule that fits, or null. Rules are stated by hand and few: they are one expression."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].name), len(rules[i].host))):  # the longest is asked first
        r = rules[i]
        out = F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.lit(i)).otherwise(out)
    return out


def differ(a: dict, b: dict, alpha: float = ALPHA) -> float | None:
    """The largest difference of two branches' shares, or None if one is more than chance explains.

    A branch has n paths, its next segments' counts, and good of labelled ones."""
    wide = math.sqrt(math.log(2 / alpha) / 2)
    gaps = []
    shares = [(a["n"], b["n"], a["next"].get(k, 0), b["next"].get(k, 0)) for k in a["next"].keys() | b["next"].keys()]
    if a["labelled"] and b["labelled"]:
        shares.append((a["labelled"], b["labelled"], a["good"], b["good"]))
    for n, m, x, y in shares:
        gaps.append(abs(x / n - y / m))
        if gaps[-1] > wide * (1 / math.sqrt(n) + 1 / math.sqrt(m)):
            return None
    return max(gaps, default=0.0)


def merged(branches: list[dict], alpha: float = ALPHA) -> dict[str, str]:
    """segment -> name of its class, for the branches of one node.

    In order of labels, paths and name, a branch joins the class that it differs least from (the earliest of equals), if chance
    explains all differences, else it founds one."""
    classes: list[dict] = []
    for b in sorted(branches, key=lambda b: (-b["labelled"], -b["n"], b["segment"])):
        gaps = [(gap, i) for i, c in enumerate(classes) if (gap := differ(c, b, alpha)) is not None]
        if gaps:
            c = classes[min(gaps)[1]]
        else:
            classes.append(c := {"n": 0, "labelled": 0, "good": 0, "next": {}, "members": []})
        for k in ("n", "labelled", "good"):
            c[k] += b[k]
        for k, v in b["next"].items():
            c["next"][k] = c["next"].get(k, 0) + v
        c["members"].append(b["segment"])
    return {s: "|".join(sorted(c["members"])) for c in classes for s in c["members"]}


def generalise(paths: DataFrame, scratch: common.Scratch, share: float = SHARE, least: int = LEAST, depth: int = DEPTH) -> DataFrame:
    """paths (host, path, ...) with their template: an array of named segments, wildcards and at most one tail."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = scratch.cut(paths.withColumn("segments", segments).withColumn("template", F.array().cast("array<string>")), "paths")
    deepest = rows.agg(F.max(F.size("segments")).alias("n")).collect()[0].n or 0
    keys = ["host", "template", "segment"]
    for d in range(min(deepest, depth)):
        rows = rows.withColumn("segment", F.get("segments", F.lit(d)))  # null where the path has ended
        kinds = rows.where("segment IS NOT NULL").groupBy(keys).agg(F.count("*").alias("n"))
        totals = kinds.groupBy("host", "template").agg(F.sum("n").alias("total"))
        named = kinds.where(F.col("n") >= least).join(totals, ["host", "template"]).where(F.col("n") >= share * F.col("total"))
        named = scratch.cut(named.select(*keys, F.lit(True).alias("named")), "named")
        # literal segments can't look like a wildcard or a class of merged branches
        literal = F.replace(F.replace("segment", F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C"))
        token = F.when(F.col("segment").isNotNull(), F.array(F.when(F.col("named"), literal).otherwise(WILD))).otherwise(F.array().cast("array<string>"))
        rows = rows.join(named, keys, "left").withColumn("template", F.concat("template", token)).drop("segment", "named")
        rows = scratch.cut(rows, "paths")
    tail = F.when(F.size("segments") > depth, F.array(F.lit(TAIL))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("template", F.concat("template", tail)).drop("segments")


def merge_branches(templates: DataFrame, scratch: common.Scratch, alpha: float = ALPHA) -> DataFrame:
    """(host, template, n, labelled, good) with `merged`: the template with classes of similar branches for segments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for host, above, branches in zip(frame["host"], frame["above"], frame["branches"], strict=True):
                by_segment: dict[str, dict] = {}
                for x in branches:
                    b = by_segment.setdefault(x["segment"], {"segment": x["segment"], "n": 0, "labelled": 0, "good": 0, "next": {}})
                    for k in ("n", "labelled", "good"):
                        b[k] += int(x[k])
                    b["next"][x["next"]] = b["next"].get(x["next"], 0) + int(x["n"])
                out += [(host, above, s, c) for s, c in merged(list(by_segment.values()), alpha).items() if s != c]
            yield pd.DataFrame(out, columns=["host", "above", "segment", "class"])

    rows = templates.withColumn("merged", F.col("template"))
    deepest = rows.agg(F.max(F.size("template")).alias("n")).collect()[0].n or 0
    for d in reversed(range(deepest)):
        at = rows.where(F.size("merged") > d).select("host", F.slice("merged", 1, d).alias("above"), F.get("merged", F.lit(d)).alias("segment"), F.coalesce(F.get("merged", F.lit(d + 1)), F.lit(END)).alias("next"), "n", "labelled", "good")
        at = at.groupBy("host", "above", "segment", "next").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "good")))
        # of one node, a bounded number of segments by a bounded number of next ones
        nodes = at.groupBy("host", "above").agg(F.collect_list(F.struct("segment", "next", "n", "labelled", "good")).alias("branches"), F.count_distinct("segment").alias("k")).where("k > 1")
        schema = "host string, above array<string>, segment string, class string"
        classes = scratch.cut(nodes.select("host", "above", "branches").mapInPandas(common.tidy(run), schema), "classes")
        rows = rows.withColumn("above", F.slice("merged", 1, d)).withColumn("segment", F.get("merged", F.lit(d))).join(classes, ["host", "above", "segment"], "left")
        after = F.slice("merged", d + 2, F.greatest(F.size("merged") - (d + 1), F.lit(0)))
        rows = rows.withColumn("merged", F.when(F.col("class").isNotNull(), F.concat(F.slice("merged", 1, d), F.array("class"), after)).otherwise(F.col("merged"))).drop("above", "segment", "class")
        rows = scratch.cut(rows, "merged")
    return rows


def purities(templates: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(host, template, merged, purity): the smoothed share of good labels of the merged template."""
    sums = [F.sum("labelled").alias("labelled"), F.sum("good").alias("good")]
    whole = templates.agg(*sums).select(((F.coalesce("good", F.lit(0)) + 1) / (F.coalesce("labelled", F.lit(0)) + 2)).alias("prior"))
    hosts = templates.groupBy("host").agg(*sums).crossJoin(F.broadcast(whole))  # one row
    hosts = hosts.select("host", ((F.col("good") + weight * F.col("prior")) / (F.col("labelled") + weight)).alias("host_purity"))
    classes = templates.groupBy("host", "merged").agg(*sums).join(hosts, "host")
    classes = classes.select("host", "merged", ((F.col("good") + weight * F.col("host_purity")) / (F.col("labelled") + weight)).alias("purity"))
    return templates.select("host", "template", "merged").join(classes, ["host", "merged"])


def judge_paths(paths: DataFrame, scratch: common.Scratch, least_purity: float = 0.5, share: float = SHARE, least: int = LEAST, depth: int = DEPTH, alpha: float = ALPHA, weight: float = WEIGHT) -> DataFrame:
    """(host, path, template, purity, verdict) of distinct hosts and paths, with `good` true, false or null (no label)."""
    rows = scratch.cut(generalise(paths, scratch, share, least, depth), "templates")
    labels = [F.count("good").alias("labelled"), F.count_if("good").alias("good")]
    templates = scratch.cut(rows.groupBy("host", "template").agg(F.count("*").alias("n"), *labels), "template-sums")
    judged = scratch.cut(purities(merge_branches(templates, scratch, alpha), weight), "purities")
    out = rows.join(judged, ["host", "template"])
    return out.select("host", "path", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity", F.when(F.col("purity") < least_purity, "block").otherwise("allow").alias("verdict"))


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """A row per URL: host, path, the rule that fits (if any), its template, and the verdict: the rule's, else the template's.
    The labels are the verdicts of the rules, over distinct paths."""
    scratch = common.Scratch()
    host, path = host_and_path(F.col("_url"))
    urls = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    names, verdicts = (F.array(*(F.lit(getattr(r, k)) for r in rules)) if rules else F.array().cast("array<string>") for k in ("name", "verdict"))
    index = rule_index(F.col("host"), F.col("path"), rules)
    paths = urls.select("host", "path").distinct().withColumn("good", F.get(verdicts, index) == "allow")
    judged = scratch.cut(judge_paths(paths, scratch, **options), "judged")
    out = urls.join(judged, ["host", "path"]).withColumn("_rule", index)
    out = out.select(F.col("_id").alias(id_col), "host", "path", F.get(names, F.col("_rule")).alias("rule"), F.coalesce(F.get(verdicts, F.col("_rule")), F.col("verdict")).alias("verdict"), "template", "purity")
    result = common.cut(out, "urls")
    scratch.clear()
    return result
