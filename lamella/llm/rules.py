"""Quality rules: a learned decision list.

Sequential covering: while labelled rows of low quality are left, a rule grows on two thirds of them, one threshold at a
time, by the gain of information about covered rows; it is pruned on the other third, and joins the list if it is precise
enough there. Covered rows then leave. The rules are conjunctions of at most MOST_TERMS thresholds on named statistics
and become one ordered Spark CASE expression, over statistics of every whole text.

Learning reads at most MOST label rows, whose statistics come to the driver: a fixed size. Without labels the list is
empty and keeps all.

Results: a document without words fails the base rule, as its n_words is below 10; so does one with a null or empty text.
Rules are tried in the order they were learned, and a tie between thresholds goes to the statistic named first, the lower
cut and the "at most" side. Labels without a doc_id, with a quality other than 0 and 1, or of no document are not learned;
of documents that share a labelled doc_id one is, that with the least statistics; a label row that repeats counts once.
Without labels, or without low ones, only the base rule judges. Rows that repeat are judged each by itself, columns with
clashing names are kept, and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.stats import RATIOS, labelled, with_statistics

MOST = 20_000
MOST_TERMS, MOST_RULES, CANDIDATES = 4, 24, 64
#: Precision that a rule needs on rows it has not grown on, and the share of low quality rows that it must cover.
PRECISE, LEAST = 0.95, 0.002


@dataclass(frozen=True)
class Term:
    stat: str
    above: bool
    threshold: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] > self.threshold if self.above else x[self.stat] <= self.threshold

    def column(self, stats: str) -> Column:
        c = F.col(stats)[self.stat]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Term, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.covers(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_TERMS and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best, best_gain = None, 1e-9
        for stat in RATIOS:
            v = x[stat][inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CANDIDATES)))
            cuts = np.unique(np.r_[cuts, (cuts[1:] + cuts[:-1]) / 2])
            at = np.searchsorted(cuts, v, "left")  # v <= cuts[at]
            n_low = np.cumsum(np.bincount(at, minlength=len(cuts)))[: len(cuts)]
            p_low = np.cumsum(np.bincount(at, bad[inside], len(cuts)))[: len(cuts)]
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((p > 0) & (n > 0), p * (np.log2(p / n) - np.log2(p0 / n0)), -1)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Term(stat, above, float(cuts[k])), gain[k]
        if best is None:
            break
        rule += (best,)
        inside &= best.covers(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that tells low quality best on rows it has not grown on."""

    def worth(r: Rule) -> float:
        c = covered(r, x, len(bad))
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prunes: np.ndarray) -> list[Rule]:
    """x: statistics; bad: rows of low quality; prunes: rows kept for pruning."""
    rules: list[Rule] = []
    left, all_bad = np.ones(len(bad), bool), max(1, bad.sum())
    while len(rules) < MOST_RULES and (bad & left).sum() > LEAST * all_bad:
        grow, prune = left & ~prunes, left & prunes
        rule = _prune(_grow({k: v[grow] for k, v in x.items()}, bad[grow]), {k: v[prune] for k, v in x.items()}, bad[prune])
        c = covered(rule, x, len(bad)) & left
        test = c & prunes if (c & prunes).any() else c
        if not rule or not c.any() or bad[test].mean() < PRECISE or bad[c].sum() < LEAST * all_bad:
            break
        rules.append(rule)
        left &= ~c
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, most: int = MOST) -> list[Rule]:
    sample = with_statistics(labelled(docs, labels, most), counts=False)
    each = sample.groupBy("doc_id", "quality").agg(F.min(sample.columns[-1]).alias("s"))
    rows = each.select("doc_id", "quality", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)).alias("part"), "s.*").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return learn({k: rows[k].to_numpy(float) for k in RATIOS}, rows.quality.to_numpy() == 0, rows.part.to_numpy() == 0)


def verdict(rules: list[Rule], stats: str) -> Column:
    """The list as an ordered conditional expression: false where a rule holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        condition = rule[0].column(stats)
        for t in rule[1:]:
            condition &= t.column(stats)
        out = F.when(condition, F.lit(False)).otherwise(out)
    return out


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def judged(docs: DataFrame, rules: list[Rule]) -> tuple[DataFrame, str, Column, Column]:
    """docs with statistics, the name of their column, and the expressions base_failed and kept."""
    rows = with_statistics(docs)
    stats = rows.columns[-1]
    failed = base_failed(stats)
    return rows, stats, failed, ~failed & verdict(rules, stats)
