"""Quality rules learned as a decision list, run as Spark expressions.

Statistics of a text are built-in functions over arrays, inside one projection
chain: no UDF, no shuffle. The list is learned on the driver from the statistics
of MOST_LABELLED labelled documents at most (those with the least hashes of their
ids): sequential covering grows a conjunction of thresholds for bad documents by
information gain on two thirds of what is left, prunes it on the other third, and
keeps it while it is right more often than not. The ordered conjunctions become
one CASE expression.

Windows of words are compared by 64-bit hashes within one text.

Defined cases: null or empty text: no words, all counts 0, base_failed, not kept.
Null doc_id: kept as null; never learned from. Labels without id or quality are
left out; a doc_id labelled twice is good if any of its labels says so. No labels,
or one class only: an empty list, which keeps everything. Repeated rows: each is
judged. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST_LABELLED = 10_000
WINDOW = 8
MOST_RULES = 12
MOST_CONDITIONS = 4
THRESHOLDS = 24
_WHITE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words", "distinct_share")


def _barrier(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """Adds a column by a generator, so that its expression isn't copied into later lambdas."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _count_chars(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """docs: (id, text, *more). Adds base counts and what FEATURES need; drops text."""
    keep = ["id", *more]
    rows = _barrier(docs, "words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), *keep, "text")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _WHITE, "") != "")
    rows = rows.select(
        *keep, "words", F.size("words").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"),
        F.length(F.translate("text", _WHITE, "")).cast("long").alias("word_chars"), _count_chars("text", _SYMBOLS).cast("long").alias("n_symbols"),
        _count_chars("text", _UPPER).alias("n_upper"), _count_chars("text", "0123456789").alias("n_digits"), _count_chars("text", "!?|").alias("n_marks"),
        F.explode(F.array(F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("once")))[0])).alias("lines"),
    )
    kept = [*keep, "n_words", "n_chars", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks", "lines"]
    rows = _barrier(rows, "h", F.transform("words", lambda w: F.xxhash64(w)), *kept)
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(WINDOW)]),
    )
    rows = _barrier(rows.withColumn("n_distinct", F.size(F.array_distinct("h"))), "runs", F.when(F.size("h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")), *kept, "n_distinct")
    ordered = F.array_sort(F.transform("runs", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = F.size(F.array_distinct("runs")) < F.size("runs")
    rows = _barrier(rows, "ordered", F.when(again, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")), *kept, "n_distinct")
    twice = F.filter("ordered", lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"]))
    rows = _barrier(rows, "at", F.array_sort(F.transform(twice, lambda x: x["i"])), *kept, "n_distinct")
    covered = F.aggregate(
        F.transform("at", lambda x, k: F.coalesce(F.least(F.get("at", k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rows = rows.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.col("lines.all") - F.col("lines.once")).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), "n_chars", "n_upper", "n_digits", "n_marks", F.col("lines.all").alias("n_lines"), "n_distinct",
    )
    return rows.select(
        "*", share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_digits", "word_chars").alias("digit_share"),
        share("n_marks", "word_chars").alias("mark_share"), share("n_words", "n_lines").alias("line_words"), share("n_distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Conjunction:
    conditions: tuple[Condition, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _candidates(x: np.ndarray) -> list[Condition]:
    out = []
    for i, name in enumerate(FEATURES):
        cuts = np.unique(np.quantile(x[:, i], np.linspace(0, 1, THRESHOLDS + 1)[1:-1])) if len(x) else []
        out += [Condition(name, above, float(t)) for t in cuts for above in (True, False)]
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < MOST_CONDITIONS and bad[inside].any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        base, best, gain = np.log2(p / (p + n)), None, 1e-9
        # thresholds of what is covered and of its bad part: a small bad class has its own quantiles
        for c in {*_candidates(x[inside]), *_candidates(x[inside & bad])}:
            covered = inside & c.holds(x)
            q = (bad & covered).sum()
            if q:
                g = q * (np.log2(q / covered.sum()) - base)
                if g > gain + 1e-12 or (best and abs(g - gain) <= 1e-12 and str(c) < str(best)):
                    best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    def worth(r):
        covered = Conjunction(r).holds(x)
        p, n = (bad & covered).sum(), (~bad & covered).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1:
        shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def learn(x: np.ndarray, bad: np.ndarray) -> list[Conjunction]:
    """Ordered conjunctions that tell bad rows of FEATURES."""
    rules: list[Conjunction] = []
    left = np.ones(len(x), dtype=bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < MOST_RULES and bad[left].any() and not bad[left].all():
        grow, test = left & ~third, left & third
        if not bad[grow].any():
            break
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        if test.any():
            rule = _prune(rule, x[test], bad[test])
        found = Conjunction(rule)
        covered = found.holds(x) & left
        on_test = covered & third
        judge = on_test if on_test.any() else covered
        if bad[judge].mean() <= 0.5 or bad[covered].sum() < 2:
            break
        rules.append(found)
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> list[Conjunction]:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    # at most most_labelled rows of two numbers
    stats = statistics(common.keyed(docs).join(F.broadcast(some), "id"), "quality")
    rows = stats.select(F.xxhash64("id").alias("turn"), "id", "quality", *FEATURES).collect()
    rows = sorted(tuple(r) for r in rows)
    x = np.array([r[3:] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r[2] == 0 for r in rows], dtype=bool))


def verdict(rules: list[Conjunction]) -> Column:
    """True for documents that no conjunction rejects."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Conjunction]) -> DataFrame:
    """doc_id, base counts, base_failed, kept, which rule rejects (from 1; null if none)."""
    rows = statistics(common.keyed(docs))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    which = None
    for i, r in enumerate(rules, 1):
        which = F.when(r.column(), i) if which is None else which.when(r.column(), i)
    return rows.select(
        common.public_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), (F.lit(None).cast("int") if which is None else which).alias("rule"),
    )
