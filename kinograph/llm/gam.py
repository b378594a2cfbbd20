"""Text quality by a generalised additive model with pairwise interactions.

Each feature has one lookup table over quantile bins, each chosen pair one table over coarser bins.
All tables are learnt by cyclic boosting: features take turns, each turn adds a shallow tree over
its own bins to its table. A score is a handful of table lookups, added.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, rows

FEATURES = ("log_bytes", "word_length", "upper", "symbols", "pipes", "shouts", "digits", "distinct_words", "top_word", "echoed_words",
            "repeated_lines", "words_per_line", "stops", "non_ascii", "halves_alike")
MAX_TRAIN = 20_000
_CLASSES = np.zeros((256, 8))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#$%&*<>{}[]~^_=+\\/@", b"|", b"!?", b"0123456789", b".,;:")):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[128:, 7] = 1


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row per text; nulls and empty texts are zeros. Whole texts are read."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, data in enumerate(texts):
        if not data:
            continue
        upper, lower, symbols, pipes, shouts, digits, stops, high = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
        size, w = len(data), data.split()
        n = max(1, len(w))
        counts = Counter(w)
        lines = [x for x in data.split(b"\n") if x.strip()]
        half = len(w) // 2
        left, right = set(w[:half]), set(w[half:])
        out[i] = (math.log1p(size), sum(map(len, w)) / n, upper / max(1.0, upper + lower), symbols / size, pipes / size, shouts / size,
                  digits / size, len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, w, w[1:])) / n,
                  1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), stops / size, high / size,
                  len(left & right) / max(1, min(len(left), len(right))))
    return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders at quantiles of the distinct-enough values."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaves(g: np.ndarray, h: np.ndarray, cuts: int, l2: float) -> np.ndarray:
    """A tree over ordered bins with at most ``cuts`` splits: the step of every bin."""
    def best(a, b):
        if b - a < 2:
            return 0.0, None
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        gain = left_g ** 2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g ** 2 / (all_h + l2)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    parts = [(0, len(g))]
    for _ in range(cuts):
        (gain, cut), k = max(((best(*p), k) for k, p in enumerate(parts)), key=lambda x: x[0][0])
        if cut is None or gain <= 1e-12:
            break
        a, b = parts.pop(k)
        parts += [(a, cut), (cut, b)]
    step = np.empty(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return step


def _cross(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis of a pair's table: its gain and every cell's step."""
    def corner(m):
        return np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0)))

    cg, ch = corner(g), corner(h)
    gain = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    quads = [(cg, ch), (cg[-1:, :] - cg, ch[-1:, :] - ch), (cg[:, -1:] - cg, ch[:, -1:] - ch),
             (cg[-1, -1] - cg[-1:, :] - cg[:, -1:] + cg, ch[-1, -1] - ch[-1:, :] - ch[:, -1:] + ch)]
    for qg, qh in quads:
        gain += qg ** 2 / (qh + l2)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    step = np.empty_like(g)
    for a in (slice(0, i), slice(i, None)):
        for b in (slice(0, j), slice(j, None)):
            if step[a, b].size:
                step[a, b] = -g[a, b].sum() / (h[a, b].sum() + l2)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)), step


class AdditiveModel:
    """Tables and borders; ``score`` gives probabilities."""

    def __init__(self, base: float, edges=(), tables=(), pairs=()):
        self.base, self.edges, self.tables, self.pairs = base, list(edges), list(tables), list(pairs)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for j, k, ej, ek, table in self.pairs:
            total += table[np.searchsorted(ej, x[:, j], "right"), np.searchsorted(ek, x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60,
        rate: float = 0.1, cuts: int = 2, l2: float = 1.0) -> AdditiveModel:
    """Main effects first, then the pairs whose best crossed cut explains most of what is left.
    With one class or no rows the model is the class share (a half without rows)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(math.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return model
    n = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    place = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(n):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _leaves(np.bincount(place[j], g, size), np.bincount(place[j], h, size), cuts, l2)
            model.tables[j] += step
            total += step[place[j]]
    rough = [_edges(x[:, j], coarse) for j in range(n)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(rough)]
    g, h = slopes()

    def cells(j, k, g, h):
        shape = (len(rough[j]) + 1, len(rough[k]) + 1)
        cell = at[j] * shape[1] + at[k]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_cross(*cells(j, k, g, h), l2)[0], j, k) for j in range(n) for k in range(j)), reverse=True)[:pairs]
    model.pairs = [(j, k, rough[j], rough[k], np.zeros((len(rough[j]) + 1, len(rough[k]) + 1))) for _, j, k in ranked]
    for _ in range(pair_rounds):
        for j, k, _, _, table in model.pairs:
            step = rate * _cross(*cells(j, k, *slopes()), l2)[1]
            table += step
            total += step[at[j], at[k]]
    return model


def _measure(texts: pa.Array) -> pa.Array:
    x = features(rows.utf8(texts))
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> AdditiveModel:
    """Fit on at most ``max_train`` labelled rows; their features, not their texts, reach the driver."""
    drawn = labelled.training_texts(docs, labels, label, max_train, id, text)
    got = drawn.select("doc_id", "label", F.arrow_udf(_measure, "array<double>")("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist()) if len(got) else np.empty((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy(float))


def quality(model: AdditiveModel, docs: DataFrame, text: str = "text"):
    """The score as a column over ``text``: a null or empty text is scored like any other."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(given.value.score(features(rows.utf8(texts))))

    return F.arrow_udf(run, "double")(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= threshold). Only the text enters
    a score. Null ids are not held out; repeated rows are scored alike; other columns are not read."""
    model = train(docs, labels, id=id, text=text)
    return docs.select(F.col(id).alias("doc_id"), labelled.held_out(id).alias("held_out"), quality(model, docs, text).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op9_additive_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    return score_quality(rows.table(spark, sf_dir, "documents"), rows.table(spark, sf_dir, "labels"))
