"""Quality by a sparse rule ensemble over text statistics.

Small boosted trees over statistics of labelled training texts give rules: every path from a root to a node is a conjunction of
bounds. An L1-penalised logistic fit keeps few of them. Kept rules become Spark column expressions over the statistics columns.

Scale: statistics are one pass over whole texts without a shuffle and are stored, as both the fit and the scores read them; scores are
JVM expressions. The fit sees at most MOST_FIT_ROWS labelled rows, those of the smallest id hashes, on the driver.

A null text counts as empty; an empty text has zero statistics and gets a score. Null labels and ids teach nothing, nor do ids with both labels. Repeated ids are each scored.
Without labels of both classes every score is the smoothed share of good labels. Other columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.logistic import fit_lasso, sigmoid
from nearfield.llm.spark import bounded_batches, stored, tidy
from nearfield.llm.toxicity import agreed, fold

#: Labelled training rows that the rules are fitted on at most.
MOST_FIT_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, PENALTY, LEAST_LEAF = 30, 3, 32, 0.3, 5e-4, 5

STATS = ("log_bytes", "word_bytes", "upper", "lower", "digits", "symbols", "exclaims", "bars", "stops", "spaces", "lines", "high_bytes", "distinct_words", "same_as_before", "distinct_lines", "entropy")
SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\/_=+", np.uint8)


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATS)
    n, count = len(data), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    m = max(1, len(words))
    share = count[count > 0] / n
    return [
        float(np.log(n)),
        sum(map(len, words)) / m,
        count[65:91].sum() / n,
        count[97:123].sum() / n,
        count[48:58].sum() / n,
        count[SYMBOLS].sum() / n,
        count[33] / n,
        count[124] / n,
        (count[46] + count[44]) / n,
        count[32] / n,
        count[10] / n,
        count[128:].sum() / n,
        len(set(words)) / m,
        sum(map(operator.eq, words, words[1:])) / m,
        len(set(lines)) / len(lines),
        float(-(share * np.log(share)).sum()),
    ]


def _columns(texts: pa.Array) -> list[pa.Array]:
    rows = np.array([statistics(t) for t in texts.to_pylist()], dtype=np.float64).reshape(-1, len(STATS))
    return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATS))]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(batch.column("text"))], names=["doc_id", *STATS])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) for each row of docs."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_stats), ", ".join(["doc_id long", *(f"{s} double" for s in STATS)]))


@dataclass(frozen=True)
class Rule:
    """Bounds that must all hold: (statistic, above, bound); above: greater than the bound, else at most it."""

    bounds: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for stat, above, bound in self.bounds:
            column = x[:, STATS.index(stat)]
            out &= column > bound if above else column <= bound
        return out

    def column(self, within: str = "") -> Column:
        """The rule over statistics that are columns, or fields of the struct column within."""
        out = F.lit(True)
        for stat, above, bound in self.bounds:
            value = F.col(f"{within}.{stat}" if within else stat)
            out = out & (value > bound if above else value <= bound)
        return out


def _grow(binned, edges, residual, weight, rows, path, depth, rules, values):
    """One regression tree on residuals by histogram splits; adds each path's rule and fills the leaves' values."""
    total, mass = residual[rows].sum(), weight[rows].sum()
    best = (1e-9, None, None)
    if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
            g = np.cumsum(np.bincount(b, residual[rows], BINS))[:-1]
            h = np.cumsum(np.bincount(b, weight[rows], BINS))[:-1]
            gain = g * g / (h + 1) + (total - g) ** 2 / (mass - h + 1) - total * total / (mass + 1)
            gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0] and at < len(edges[f]):
                best = (gain[at], f, at)
    if best[1] is None:
        values[rows] = total / (mass + 1)
        return
    _, f, at = best
    left = binned[rows, f] <= at
    for above, part in ((False, rows[left]), (True, rows[~left])):
        longer = (*path, (STATS[f], above, float(edges[f][at])))
        rules.append(Rule(longer))
        _grow(binned, edges, residual, weight, part, longer, depth + 1, rules, values)


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules with weights. The same rows in the same order give the same rules."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return prior, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rng, z, rules = np.random.default_rng(seed), np.full(len(y), prior), []
    for _ in range(TREES):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < 0.5) if len(y) > 200 else np.arange(len(y))
        values = np.zeros(len(y))
        first = len(rules)
        _grow(binned, edges, y - p, np.maximum(p * (1 - p), 1e-6), rows, (), 0, rules, values)
        if first == len(rules):
            break
        leaf = np.zeros(len(y))
        for rule in rules[first:]:  # a longer path overwrites the shorter one that it extends
            inside = rule.holds(x)
            members = inside[rows]
            if members.any():
                leaf[inside] = values[rows[members]].mean()
        z = z + SHRINK * leaf
    rules = list(dict.fromkeys(rules))
    matrix = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    keep = np.unique(matrix, axis=1, return_index=True)[1] if len(rules) else []
    rules, matrix = [rules[i] for i in sorted(keep)], matrix[:, sorted(keep)]
    intercept, weights = fit_lasso(matrix, y.astype(np.float64), PENALTY)
    return intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]


def rule_score(intercept: float, rules: list[tuple[Rule, float]], within: str = "") -> Column:
    z = F.lit(float(intercept))
    for rule, weight in rules:
        z = z + F.when(rule.column(within), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def train(stats: DataFrame, labels: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Rules from labelled rows outside fold 0."""
    known = stats.join(agreed(labels, "quality"), "doc_id").where(fold() != 0).withColumn("h", F.xxhash64("doc_id"))
    rows = known.orderBy("h", "doc_id", *STATS).limit(MOST_FIT_ROWS).toArrow()
    return fit_rules(np.stack([rows.column(s).to_numpy() for s in STATS], axis=1), rows.column("quality").to_numpy())


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    stats = stored(with_statistics(docs))
    intercept, rules = train(stats, labels)
    out = stats.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), rule_score(intercept, rules).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold. Each row is judged by its own text, whatever its id.

    Statistics are taken once for the fit, without the texts, and once beside the rows, so that no text is shuffled.
    """
    intercept, rules = train(stored(with_statistics(docs)), labels)

    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_columns(texts), names=list(STATS))

    own = F.arrow_udf(run, ", ".join(f"{s} double" for s in STATS)).asNondeterministic()  # so that it is not copied into every rule
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"_statistics{i}") not in {c.lower() for c in docs.columns})
    return docs.withColumn(name, own("text")).where(rule_score(intercept, rules, name) >= threshold).drop(name)
