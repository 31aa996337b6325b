"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; every
path from a root is a rule, a conjunction of bounds on statistics.  A logistic
model with an L1 penalty keeps few of them.  Statistics and rules are Spark
column expressions, so scoring a table is one projection: no Python, no
shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import apart

Bound = tuple[str, bool, float]  # statistic, above (else at most), value


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; null reads as empty, and shares of nothing are 0."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.array_remove(F.split(t, "[ \\t-\\r]+"), "")
    lines = F.split(t, "\n")

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of).otherwise(0.0)

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    def char(c: str) -> Column:
        return chars - F.length(F.replace(t, F.lit(c), F.lit("")))

    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": share(chars, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(F.size(words), F.size(lines)),
        "upper": share(left("[^\\p{Lu}]+"), chars),
        "digits": share(left("[^0-9]+"), chars),
        "symbols": share(left("[\\p{L}\\p{N}\\s.,]+"), chars),
        "stops": share(char("."), F.size(words)),
        "commas": share(char(","), F.size(words)),
        "bars": share(char("|"), F.size(words)),
    }


STATISTICS = ["log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "upper", "digits", "symbols", "stops", "commas", "bars"]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Bound, ...], float]]

    def logit(self, stat: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for bounds, weight in self.rules:
            hit = F.lit(True)
            for name, above, value in bounds:
                hit = hit & ((stat[name] > value) if above else (stat[name] <= value))
            total = total + F.when(hit, weight).otherwise(0.0)
        return total


def _tree(codes: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, depth: int, least: int) -> tuple[list[tuple[tuple[int, bool, int], ...]], np.ndarray]:
    """Paths of one regression tree (feature, above, bin) and its values for all rows."""
    paths: list[tuple[tuple[int, bool, int], ...]] = []
    values = np.zeros(len(residual))
    stack = [((), np.arange(len(residual)))]
    while stack:
        path, at = stack.pop()
        if path:
            paths.append(path)
        g, h = residual[at], weight[at]
        total_g, total_h = g.sum(), h.sum()
        values[at] = total_g / (total_h + 1.0)
        if len(path) == depth or len(at) < 2 * least:
            continue
        best = (1e-6, -1, -1)
        for f in range(codes.shape[1]):
            bins = len(edges[f]) + 1
            c = codes[at, f]
            n = np.cumsum(np.bincount(c, minlength=bins))[:-1]
            lg = np.cumsum(np.bincount(c, g, bins))[:-1]
            lh = np.cumsum(np.bincount(c, h, bins))[:-1]
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            gain[(n < least) | (len(at) - n < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] >= 0:
            _, f, b = best
            above = codes[at, f] > b
            stack += [((*path, (f, False, b)), at[~above]), ((*path, (f, True, b)), at[above])]
    return paths, values


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weights of an L1-penalised logistic model by accelerated proximal steps."""
    n = len(y)
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / sd
    step = 4.0 / max(np.linalg.norm(z.T @ z / n, 2), 1.0)
    w = v = np.zeros(x.shape[1])
    b = c = math.log((y.sum() + 1) / (n - y.sum() + 1))
    t = 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        grad = z.T @ miss / n
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * miss.mean()
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    w = w / sd
    return float(b - w @ mean), w


def learn(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 0.001, seed: int = 3) -> RuleModel:
    """Rules from boosted trees, weighed by the lasso.  With one class or no row: a constant."""
    n, positive = len(y), float(y.sum())
    if n < 20 or positive in (0.0, float(n)):
        return RuleModel(math.log((positive + 1) / (n - positive + 1)), [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(seed)
    score = np.full(n, math.log(positive / (n - positive)))
    found: dict[tuple[tuple[int, bool, int], ...], None] = {}
    least = max(5, n // 200)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = rng.permutation(n)[: max(20, n // 2)]
        residual, weight = np.zeros(n), np.zeros(n)
        residual[rows], weight[rows] = (y - p)[rows], (p * (1 - p))[rows]
        paths, values = _tree(codes[rows], edges, residual[rows], weight[rows], depth, least)
        found.update(dict.fromkeys(tuple(sorted(p)) for p in paths))
        full = np.zeros(n)
        full[rows] = values
        # rows outside the half take the value of the leaf they fall in
        done = np.zeros(n, bool)
        done[rows] = True
        for path in sorted(paths, key=len, reverse=True):
            hit = np.ones(n, bool)
            for f, above, b in path:
                hit &= (codes[:, f] > b) == above
            leaf = np.flatnonzero(hit[rows])
            if len(leaf):
                new = hit & ~done
                full[new] = values[leaf[0]]
                done |= new
        score = score + 0.3 * np.clip(full, -4, 4)
    rules = list(found)
    hits = np.ones((n, len(rules)), np.float32)
    for r, path in enumerate(rules):
        for f, above, b in path:
            hits[:, r] *= (codes[:, f] > b) == above
    intercept, weights = _lasso(hits, y.astype(np.float64), penalty)
    kept = [(tuple((names[f], above, float(edges[f][b])) for f, above, b in path), float(w)) for path, w in zip(rules, weights, strict=True) if abs(w) > 1e-4]
    return RuleModel(intercept, kept)


def fit(docs: DataFrame, doc_id: Column, text: Column, labels: DataFrame, label_id: Column, label: Column, sample: int = 20_000) -> RuleModel:
    """A model from at most ``sample`` labelled ids, those with the least hash of their id.

    Labels other than 0 and 1, null ids, ids without a document and ids with
    both labels are passed over; an id counts once however often its label is
    repeated.  If several documents have one id, that with the least statistics
    stands for it.  So the model depends on the rows alone, not on their order
    or partitions.  ``sample`` bounds what is broadcast and what reaches the driver.
    """
    rows = labels.select(label_id.cast("long").alias("__id"), label.cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)")
    each = rows.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__most")).where("__y = __most").select("__id", "__y")
    chosen = each.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    found = docs.select(doc_id.cast("long").alias("__id"), text.alias("__text")).join(F.broadcast(chosen), "__id")
    stats = F.struct(*[c.cast("double").alias(n) for n, c in statistics(F.col("__text")).items()])
    got = found.select("__id", "__y", stats.alias("s")).groupBy("__id").agg(F.first("__y").alias("__y"), F.min("s").alias("s")).select("__id", "__y", "s.*").toPandas()
    got = got.sort_values("__id")
    return learn(got[STATISTICS].to_numpy(np.float64), got["__y"].to_numpy(), STATISTICS)


def classify(docs: DataFrame, text: Column, keep: list[str], model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """Columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Null and empty texts are scored like any other, very long ones whole;
    ``keep`` may hold any columns, and rows may repeat.  To filter by the
    outcome, store the result first: a filter on it would be pushed below and
    take the statistics once for each rule.
    """
    keep = apart(keep, ["score", "predicted"])
    rows = docs.select(*[F.col(c) for c in keep], *[c.cast("double").alias(f"__{n}") for n, c in statistics(text).items()])
    score = 1 / (1 + F.exp(-model.logit({n: F.col(f"__{n}") for n in STATISTICS})))
    scored = rows.select(*[F.col(c) for c in keep], score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
