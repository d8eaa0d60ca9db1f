"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over text statistics are fitted on a bounded sample of
labelled documents; every root-to-node path becomes a conjunctive rule, a
lasso logistic regression keeps few of them, and the kept rules are compiled
into one Spark column expression. Scoring is a map over whole texts in the
JVM: no Python, no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col_of, indexed, pick, restore
from .labelled import TRAIN_ROWS, held_out, training_rows

MODULUS, REMAINDER = 5, 0  # held-out part of the labels
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text (null counts as empty) as column expressions."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.size(words)
    per_word = F.greatest(n, F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    symbols = F.regexp_replace(t, r"[\p{L}\p{M}\p{Nd}\s.,]+", "")
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    return {
        "words": n.cast("double"),
        "word_chars": chars / per_word,
        "distinct_words": F.size(F.array_distinct(words)) / per_word,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "lines_per_word": F.size(lines) / per_word,
        "upper": left(r"[^\p{Lu}]+") / chars,
        "digits": left(r"[^\p{Nd}]+") / chars,
        "symbols": F.length(symbols) / chars,
        "symbol_kinds": F.size(F.array_distinct(F.split(symbols, ""))) / F.greatest(F.length(symbols), F.lit(1)),
        "full_stops": left(r"[^.]+") / per_word,
        "commas": left(r"[^,]+") / per_word,
    }


@dataclass
class Rules:
    """``score = sigmoid(intercept + sum of weight over the rules that hold)``;
    a rule is a list of (statistic, is_greater, threshold)."""

    intercept: float = 0.0
    rules: list[tuple[float, list[tuple[str, bool, float]]]] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        z = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            hold = F.lit(True)
            for name, greater, cut in rule:
                hold = hold & ((stats[name] > cut) if greater else (stats[name] <= cut))
            z = z + F.when(hold, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def tree_paths(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int,
               rows: np.ndarray, path: tuple, out: list) -> None:
    """Grow one regression tree on logistic gradients; collect the path of
    every node, and (rows, value) of the leaves in ``out``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for j, points in enumerate(cuts):
            bins = np.searchsorted(points, x[rows, j])
            gs = np.cumsum(np.bincount(bins, grad[rows], len(points) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins, hess[rows], len(points) + 1))[:-1]
            ns = np.cumsum(np.bincount(bins, minlength=len(points) + 1))[:-1]
            gain = gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g ** 2 / (h + 1)
            gain[(ns < 5) | (len(rows) - ns < 5)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, float(points[gain.argmax()]))
    if best[1] is None:
        out.append(("leaf", rows, g / (h + 1)))
        return
    _, j, cut = best
    low = x[rows, j] <= cut
    for greater, part in ((False, rows[low]), (True, rows[~low])):
        step = (*path, (j, greater, cut))
        out.append(("rule", step, None))
        tree_paths(x, grad, hess, cuts, depth - 1, part, step, out)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient
    (the intercept is free)."""
    n, m = a.shape
    full = np.hstack([np.ones((n, 1)), a])
    rate = 4.0 / max(np.linalg.norm(full, 2) ** 2 / n, 1e-9)
    w = v = np.zeros(m + 1)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -30, 30)))
        new = v - rate * (full.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        v = new + k / (k + 3) * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 25, depth: int = 3,
              penalty: float = 0.0005) -> Rules:
    """Trees, their paths as rules, lasso weights. One class, or too few rows
    for a split: a constant score, the share of label 1 (0.5 without rows)."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
    constant = Rules(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return constant
    cuts = []
    for j in range(x.shape[1]):
        points = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))
        cuts.append((points[:-1] + points[1:]) / 2)
    f, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        out: list = []
        tree_paths(x, y - p, p * (1 - p), cuts, depth, np.arange(len(y)), (), out)
        for kind, what, value in out:
            if kind == "rule":
                paths[what] = None
            else:
                f[what] += 0.5 * value
    rules = list(paths)
    if not rules:  # too few rows to split
        return constant
    a = np.stack([np.logical_and.reduce([(x[:, j] > c) == g for j, g, c in rule]) for rule in rules], 1).astype(float)
    keep = np.flatnonzero((a.mean(0) > 0) & (a.mean(0) < 1))
    b, w = lasso(a[:, keep], y.astype(float), penalty)
    return Rules(b, [(float(w[i]), [(names[j], g, c) for j, g, c in rules[k]]) for i, k in enumerate(keep) if abs(w[i]) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Rules:
    """Fit on at most ``max_rows`` labelled rows; only their statistics (one
    short numeric row each) come to the driver."""
    rows = training_rows(docs, labels, "quality", MODULUS, REMAINDER, max_rows)
    stats = statistics(F.col("text"))
    data = rows.select("y", *[c.alias(k) for k, c in stats.items()]).toPandas()
    order = data.sort_values(list(data.columns), kind="stable")  # row order must not matter
    return fit_rules(order[list(stats)].to_numpy(float), order["y"].to_numpy(int), list(stats))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``; null and empty texts score as
    the empty text, repeated rows repeat, an empty table gives no rows."""
    src = pick(docs, doc_id="doc_id", text="text")
    return src.select("doc_id", rules.column(statistics(F.col("text"))).alias("score"))


def keep_good(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, columns as given."""
    src = indexed(docs)
    return restore(src.where(rules.column(statistics(col_of(docs, "text"))) >= threshold), docs)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
