"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned; the model is an intercept plus one lookup table
for each feature and for some pairs of features. The tables are learned by cyclic
boosting: round after round, feature after feature, a shallow tree over the bins is
fitted to what is left and added, shrunken, to the feature's table; then the same
for the pairs that would gain most. Scoring adds table entries, vectorised.

The model is fitted on at most ``labels.MAX_TRAIN_ROWS`` labelled rows, with their
features only, on the driver. Defined results: a null or empty text has features
like any other; without labels every score is 0.5, with labels of one kind alike
for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as folds

THRESHOLD = 0.3
FEATURES = [
    "log_bytes", "log_words", "word_length", "distinct_words", "repeated_next", "upper", "digits", "symbols", "marks", "bars", "stops", "other_letters",
    "log_lines", "distinct_lines", "line_length", "end_of_lines", "top_byte", "entropy", "longest_word", "short_words", "capital_words", "rare_symbols",
]
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_SYMBOLS = np.frombuffer(b"#$%&*@^~+=<>{}[]\\/_", np.uint8)
_RARE = np.frombuffer(b"^~<>{}[]\\_`", np.uint8)


def features(text: bytes | None) -> list[float]:
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    p = counts[counts > 0] / n
    lengths = [*map(len, words)]
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / k, len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:])) / k,
        counts[_UPPER].sum() / letters, counts[48:58].sum() / n, counts[_SYMBOLS].sum() / n, counts[33] / n, counts[124] / n, (counts[46] + counts[44]) / n, counts[128:].sum() / n,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / max(1, len(lines))), sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines)), counts[33:].max() / n, float(-(p * np.log2(p)).sum()),
        np.log1p(max(lengths, default=0)), sum(x < 3 for x in lengths) / k, sum(65 <= w[0] <= 90 for w in words) / k, counts[_RARE].sum() / n,
    ]


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


class AdditiveModel:
    """Intercept, bin edges and tables of features and of pairs."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 200, pairs: int = 10, rate: float = 0.1, least: float = 3.0):
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.rate, self.least = bins, pair_bins, rounds, pairs, rate, least

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        ones = float(y.sum())
        self.intercept = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
        share = np.arange(1, self.bins) / self.bins
        self.edges = [np.unique(np.quantile(c, share)) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [e[np.unique(np.linspace(0, len(e) - 1, self.pair_bins - 1).astype(int))] if len(e) else e for e in self.edges]
        self.tables = [np.zeros(self.bins) for _ in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not 0 < ones < len(y):
            return self
        fine, rough = self._binned(x, self.edges), self._binned(x, self.coarse)
        value = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                table += (step := self._tree(fine[:, j], *self._left(value, y)))
                value += step[fine[:, j]]
        gains = []
        for a in range(x.shape[1]):
            for b in range(a):
                cell = rough[:, a] * self.pair_bins + rough[:, b]
                gains.append((self._quadrants(cell, *self._left(value, y))[1], a, b))
        self.pairs = [(a, b) for g, a, b in sorted(gains, reverse=True)[: self.n_pairs] if g > 0]
        self.pair_tables = [np.zeros(self.pair_bins**2) for _ in self.pairs]
        for _ in range(self.rounds // 2):
            for (a, b), table in zip(self.pairs, self.pair_tables):
                cell = rough[:, a] * self.pair_bins + rough[:, b]
                table += (step := self._quadrants(cell, *self._left(value, y))[0])
                value += step[cell]
        return self

    @staticmethod
    def _left(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-value))
        return y - p, p * (1 - p)

    def _leaf(self, g, h):
        return self.rate * g / (h + 1.0)

    def _tree(self, bin_of: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of two levels over the bins: up to four stretches with one value each."""
        gs, hs = np.bincount(bin_of, g, self.bins), np.bincount(bin_of, h, self.bins)
        out = np.zeros(self.bins)

        def cut(begin: int, end: int) -> int | None:
            a, b = np.cumsum(gs[begin:end]), np.cumsum(hs[begin:end])
            gain = a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - a[-1] ** 2 / (b[-1] + 1)
            gain[(b[:-1] < self.least / 4) | (b[-1] - b[:-1] < self.least / 4)] = 0
            return begin + int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else None

        middle = cut(0, self.bins)
        for begin, end in [(0, self.bins)] if middle is None else [(0, middle), (middle, self.bins)]:
            at = cut(begin, end)
            for a, b in [(begin, end)] if at is None else [(begin, at), (at, end)]:
                out[a:b] = self._leaf(gs[a:b].sum(), hs[a:b].sum())
        return out

    def _quadrants(self, cell: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """The best tree that cuts both features once, and its gain."""
        k = self.pair_bins
        a, b = (np.bincount(cell, v, k * k).reshape(k, k).cumsum(0).cumsum(1) for v in (g, h))

        def four(c):
            low = c[:-1, :-1]
            return np.stack((low, c[:-1, -1:] - low, c[-1:, :-1] - low, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + low))

        gs, hs = four(a), four(b)
        gain = (gs**2 / (hs + 1)).sum(0) - a[-1, -1] ** 2 / (b[-1, -1] + 1)
        gain[(hs < self.least / 4).any(0)] = 0
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        out = np.zeros((k, k))
        if gain[i, j] > 0:
            leaf = self._leaf(gs[:, i, j], hs[:, i, j])
            out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
        return out.ravel(), float(gain[i, j])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        fine, rough = self._binned(x, self.edges), self._binned(x, self.coarse)
        value = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            value += table[fine[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            value += table[rough[:, a] * self.pair_bins + rough[:, b]]
        return 1 / (1 + np.exp(-value))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> AdditiveModel:
    """The model of the labelled rows outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "y"])

    rows = folds.sample(docs, labels, label).mapInArrow(run, "doc_id long, x array<double>, y int")
    got = sorted(rows.collect(), key=lambda r: (r[0], r[1]))
    return AdditiveModel().fit(np.array([r[1] for r in got], np.float64).reshape(-1, len(FEATURES)), np.array([r[2] for r in got], np.float64))


def score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """docs with the column ``name``, replaced if there is one."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    known = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.value.score(x), pa.float64())], names=[*batch.schema.names, name])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(name, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return scored.select("doc_id", folds.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), name).where(F.col(name) >= THRESHOLD).select(*docs.columns)
