"""URL verdicts: listed rules first, then a tree of path templates for each host.

Paths that rules decide are the labelled ones. A host's paths grow a tree, level
by level over (host, template so far, segment) counts: segments that look variable
(numbers, hashes, dates, file names with numbers) become ``*``; so do rare ones
among many; and branches whose labelled share of blocks is statistically the same
as their siblings' merge into ``*`` too. A template's purity is its share of
blocked labels, smoothed towards its parent's, the host's towards the share over
all; templates of a purity of REJECT or more are blocked.

All steps are grouped sums over distinct (host, path) and joins on them: a host
with a third of all pages costs its distinct paths, not its pages.

Defined cases: null url, or none with ://: host and path are empty, and such urls
are allowed unless the empty host's template says otherwise. Null page_id: kept.
Repeated rows: each is returned. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Levels of the tree at most (it ends with the deepest path); what is below is one last segment, its variable parts each ``*``.
DEPTH = 32
MANY_CHILDREN = 30
RARE = 5
Z = 1.96
STRENGTH = 4.0
REJECT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(?:[0-9]+|[0-9]{1,4}[-_.][0-9].*|[0-9a-fA-F-]{8,}|[^/]*[0-9]{3,}[^/]*|[A-Za-z0-9_=-]{24,})$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The position of the longest rule that fits, from 0; null if none does."""
    out = None
    for i in sorted(range(len(rules)), key=lambda i: -len(rules[i].name)):
        r = rules[i]
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(None).cast("int") if out is None else out


def _pick(rules: tuple[Rule, ...], at: Column, what: str) -> Column:
    return F.get(F.array(*[F.lit(getattr(r, what)) for r in rules]), at) if rules else F.lit(None).cast("string")


def templates(paths: DataFrame) -> DataFrame:
    """paths: (host, path, n, labelled, blocked), one row for each host and path.
    Adds template and purity."""
    total = paths.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max(F.size(F.split("path", "/"))).alias("d")).first()
    prior = ((total["b"] or 0) + 1) / ((total["l"] or 0) + 2)
    depth = min(DEPTH, max(1, (total["d"] or 1) - 1))
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", DEPTH)
    below = F.array_join(F.transform(F.split(F.get(segments, F.lit(DEPTH - 1)), "/"), lambda x: F.when(x.rlike(VARIABLE), "*").otherwise(x)), "/")
    segments = F.when(F.size(segments) < DEPTH, segments).otherwise(F.concat(F.slice(segments, 1, DEPTH - 1), F.array(below)))
    rows = paths.withColumn("segments", segments).withColumn("template", F.lit("")).withColumn("purity", F.lit(None).cast("double"))
    for level in range(depth):
        level_rows, rows = rows, rows.withColumn("segment", F.get("segments", F.lit(level)))
        child = rows.where("segment is not null").groupBy("host", "template", "segment").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.first("purity").alias("above")
        )
        parent = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        rest_l, rest_b = F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b")
        pooled = F.try_divide("all_b", "all_l")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("l")) + F.try_divide(F.lit(1), rest_l)))
        # null, so no, where this branch or its siblings have no label
        same = F.abs(F.try_divide("b", "l") - F.try_divide(rest_b, rest_l)) <= Z * error + 1e-12
        general = F.col("segment").rlike(VARIABLE) | ((F.col("children") > MANY_CHILDREN) & (F.col("n") < RARE)) | F.coalesce(same, F.lit(False))
        named = common.join_apart(child, parent, ["host", "template"]).withColumn("name", F.when(general, F.lit("*")).otherwise(F.col("segment")))
        host = (F.col("all_b") + STRENGTH * prior) / (F.col("all_l") + STRENGTH)  # what stands above the first level
        named = named.withColumn("above", F.coalesce("above", host))
        named = common.materialise(named.select("host", "template", "segment", "name", "l", "b", "above"), "segments")
        merged = named.groupBy("host", "template", "name").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"), F.max("above").alias("above"))
        merged = merged.select("host", "template", "name", ((F.col("mb") + STRENGTH * F.col("above")) / (F.col("ml") + STRENGTH)).alias("next"))
        step = common.join_apart(named.select("host", "template", "segment", "name"), merged, ["host", "template", "name"])
        rows = rows.join(step, ["host", "template", "segment"], "left").select(
            "host", "path", "segments",
            F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"),
            F.coalesce("next", "purity").alias("purity"), "n", "labelled", "blocked",
        )
        before, rows = level_rows, common.materialise(rows, "templates")  # a level a plan: together they would outgrow the driver
        common.discard(before, named)
    return rows.select("host", "path", "template", "purity")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("at", rule_of(F.col("host"), F.col("path"), rules))
    block = (_pick(rules, F.col("at"), "verdict") == "block").cast("long")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("at").alias("labelled"), F.coalesce(F.sum(block), F.lit(0)).alias("blocked"))
    learned = templates(common.materialise(paths, "paths"))
    learned_verdict = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return common.join_apart(rows, learned, ["host", "path"], "left").select(
        "page_id", "host", "path", _pick(rules, F.col("at"), "name").alias("rule"),
        F.coalesce(_pick(rules, F.col("at"), "verdict"), learned_verdict).alias("verdict"), "template", "purity",
    )
