"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals give scores and offsets.

*Labelled tokens.* Documents carry the labels, so tokens are labelled first: of the
words and word beginnings in the sample, those far likelier in toxic documents than
in clean ones are chosen greedily, as long as each explains further toxic documents; in
toxic documents the tokens that match a choice are labelled toxic, all others clean.

*Model.* States clean and toxic; a token's weight is a sum over its word, its
beginnings and its ending (hashed); transitions and a start weight tie neighbours.
Likelihood is maximised over windows of labelled tokens, which are the whole text of
each sampled document.

*Scores.* Forward-backward over all tokens of the whole text gives each token's
probability of being toxic. With two states it is a recursion of ratios, run over
many documents side by side. The three largest probabilities of a document, their
sum and how many reach 0.5 go into a logistic function fitted on the sample's labels;
tokens that reach 0.5 give the offending offsets.

The sample has at most ``MAX_SAMPLE`` labelled rows outside the held-out fold, of at
most ``MAX_SAMPLE_BYTES`` of text; nothing else of the corpus reaches the driver.
Defined results: a text without tokens scores as one with no toxic token; without
toxic labels all scores are 0 and no token is offending.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from . import labels as folds

MAX_SAMPLE = 6_000
#: Rows of the sample are taken in order of their hash; one whose whole text would go beyond this is passed over.
MAX_SAMPLE_BYTES = 64 << 20
#: What a worker holds at once: bytes of text; tokens of documents side by side, unless one alone has more.
MAX_PIECE, MAX_GRID = 4 << 20, 1 << 20
#: Toxic documents that a choice must explain, and how many times likelier than in a clean document it must be in a toxic one.
LEAST_DOCS, LEAST_RATIO = 3, 6
#: Twice the logarithm of the likelihood ratio between unlike and like shares of both that a choice needs, as a hundred thousand words are tried.
LEAST_EVIDENCE = 20
WINDOW = 48
#: Windows whose expectations are held at once.
CHUNK = 8192
_BITS = 18
_MAX_WORDS_KNOWN = 400_000
#: Letters of ASCII in lower case and all bytes beyond ASCII make words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def _beginnings(word: bytes) -> list[bytes]:
    """The word itself (with an end mark) and its beginnings of 4 to 8 bytes."""
    return [word + b" ", *(word[:k] for k in range(4, min(len(word), 9)))]


def _signature(words: list[bytes]) -> int:
    """Near copies mostly have the same: the smallest hash of three words in a row."""
    return min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def _tells(toxic: int, clean: int, all_toxic: int, all_clean: int) -> bool:
    """Whether a word of so many toxic and clean documents is far likelier in toxic ones, and not by chance."""
    if (toxic + 0.5) * (all_clean + 1) < LEAST_RATIO * (clean + 0.5) * (all_toxic + 1):
        return False
    of = ((toxic, all_toxic), (clean, all_clean))
    share = (toxic + clean) / (all_toxic + all_clean)
    evidence = sum(k * math.log(k / (n * share)) for k, n in of if k) + sum((n - k) * math.log((n - k) / (n * (1 - share))) for k, n in of if k < n)
    return 2 * evidence >= LEAST_EVIDENCE


def label_words(texts: list[bytes], y: np.ndarray) -> set[bytes]:
    """Words and beginnings that tell toxic documents: those chosen greedily, and others as telling and common.

    Near copies count as one document, or what else they share would seem telling.
    """
    toxic: dict[bytes, set[int]] = defaultdict(set)
    clean: dict[bytes, set[int]] = defaultdict(set)
    kinds: tuple[set[int], set[int]] = set(), set()
    for text, label in zip(texts, y):
        words = words_of(text)
        k = _signature(words)
        kinds[int(label)].add(k)
        table = toxic if label else clean
        for b in {b for w in set(words) for b in _beginnings(w)}:
            table[b].add(k)
    left = {b: s for b, s in toxic.items() if len(s) >= LEAST_DOCS and _tells(len(s), len(clean.get(b, ())), len(kinds[1]), len(kinds[0]))}
    common = max(LEAST_DOCS + 2, len(kinds[1]) // 50)
    chosen: set[bytes] = set()
    explained: set[int] = set()
    order = sorted(left, key=lambda b: (-len(left[b]), -len(b), b))
    while order:
        best, best_gain, kept = None, (0, 0), []
        for b in order:  # supports are sorted, so what comes after can't gain more
            if best is not None and len(left[b]) < best_gain[0]:
                kept.append(b)
                continue
            gain = (len(left[b] - explained), len(b))
            if gain[0] >= LEAST_DOCS:
                kept.append(b)
                if gain > best_gain:
                    best, best_gain = b, gain
        if best is None:
            break
        chosen.add(best)
        explained |= left[best]
        order = [b for b in kept if b != best]
    return chosen | {b for b, s in left.items() if len(s) >= common}


class ChainField:
    """Two states; weights say how much more likely the toxic state is."""

    def __init__(self):
        self.weights = np.zeros(1 << _BITS)
        self.change = np.zeros((2, 2))
        self.start = -4.0
        self.document = np.zeros(SUMMARY), np.ones(SUMMARY), np.array([-4.0, *np.zeros(SUMMARY)])  # means, deviations, weights
        self.trained = True

    @staticmethod
    def features(word: bytes) -> list[int]:
        parts = [b"w" + word, b"e" + word[-3:], b"b", *(b"p%d" % k + word[:k] for k in range(3, 9) if k < len(word))]
        return [zlib.crc32(p) & ((1 << _BITS) - 1) for p in parts]

    def emission(self, word: bytes) -> float:
        return float(min(30.0, max(-30.0, self.weights[self.features(word)].sum())))

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the toxic state; emissions: (documents, positions), of each document as many as its length (None: all)."""
        a = np.exp(self.change)
        e = np.exp(emissions.T)
        forward = np.empty_like(e)
        ratio = np.exp(self.start) * e[0]
        forward[0] = ratio
        for t in range(1, len(e)):
            ratio = e[t] * (a[0, 1] + a[1, 1] * ratio) / (a[0, 0] + a[1, 0] * ratio)
            forward[t] = ratio
        back = np.ones(e.shape[1])
        for t in range(len(e) - 2, -1, -1):
            x = e[t + 1] * back
            back = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
            if lengths is not None and lengths[0] <= t + 1:  # sorted, so the first is the shortest
                back[: np.searchsorted(lengths, t + 1, side="right")] = 1.0
            forward[t] *= back
        return (forward / (1 + forward)).T

    def fit(self, windows: np.ndarray, words: list[bytes], tags: np.ndarray, steps: int = 60, rate: float = 0.5, decay: float = 1e-4) -> ChainField:
        """windows: (windows, WINDOW) of places in words; tags: the same shape, of 0 and 1."""
        if not len(windows):
            return self
        per_word = [self.features(w) for w in words]
        of = np.repeat(np.arange(len(per_word)), [*map(len, per_word)])
        flat = np.concatenate([np.array(f) for f in per_word])
        n = tags.size
        squares = np.full(1 << _BITS, 1e-8)
        change_squares, start_square = np.full((2, 2), 1e-8), 1e-8
        pairs = np.array([[((tags[:, :-1] == i) & (tags[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
        for _ in range(steps):
            per = np.clip(np.bincount(of, self.weights[flat], len(per_word)), -30, 30)
            errors, expected, at_start = np.zeros(len(per_word)), np.zeros((2, 2)), 0.0
            for k in range(0, len(windows), CHUNK):
                number, own = windows[k : k + CHUNK], tags[k : k + CHUNK]
                p, pairs_of = self._expectations(per[number])
                errors += np.bincount(number.ravel(), (own - p).ravel(), len(per_word))
                expected += pairs_of
                at_start += float((own[:, 0] - p[:, 0]).sum())
            gradient = np.bincount(flat, errors[of], 1 << _BITS) / n * 100 - decay * self.weights
            squares += gradient**2
            self.weights += rate * gradient / np.sqrt(squares)
            change = (pairs - expected) / n * 100
            change[0, 0] = 0
            change_squares += change**2
            self.change += rate / 2 * change / np.sqrt(change_squares)
            start = at_start / len(windows)
            start_square += start**2
            self.start += rate / 2 * start / np.sqrt(start_square)
        return self

    def _expectations(self, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of states and expected counts of transitions."""
        a, e = np.exp(self.change), np.exp(emissions.T)
        forward = np.empty_like(e)
        forward[0] = ratio = np.exp(self.start) * e[0]
        for k in range(1, len(e)):
            forward[k] = ratio = e[k] * (a[0, 1] + a[1, 1] * ratio) / (a[0, 0] + a[1, 0] * ratio)
        back = np.ones(e.shape[1])
        expected = np.zeros((2, 2))
        for k in range(len(e) - 2, -1, -1):
            x, ratio = e[k + 1] * back, forward[k]
            forward[k + 1] *= back
            same, out = a[0, 0] + a[0, 1] * x, a[1, 0] + a[1, 1] * x
            total = same + ratio * out
            stay, leave = a[0, 0] / total, ratio / total
            expected += [[stay.sum(), (a[0, 1] * x / total).sum()], [a[1, 0] * leave.sum(), a[1, 1] * (x * leave).sum()]]
            back = out / same
        forward[0] *= back
        return (forward / (1 + forward)).T, expected

    def fit_documents(self, summaries: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> ChainField:
        """Logistic regression on the documents' summaries, by Newton's method with steps halved until they help."""
        means, deviations = summaries.mean(axis=0), np.maximum(summaries.std(axis=0), 0.5)
        x = np.column_stack((np.ones(len(y)), (summaries - means) / deviations))
        w, held = np.zeros(x.shape[1]), np.array([0.0, *np.full(x.shape[1] - 1, ridge)])

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((np.logaddexp(0, z) - y * z).sum() + (held * w * w).sum() / 2)

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held + 1e-9), x.T @ (y - p) - held * w)
            step = 1.0
            while step > 1e-6 and loss(w + step * move) > loss(w):
                step /= 2
            w = w + step * move
            if step * np.abs(move).max() < 1e-8:
                break
        self.document = means, deviations, w
        return self

    def score(self, summaries: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(summaries))
        means, deviations, w = self.document
        return 1 / (1 + np.exp(-np.clip(w[0] + (summaries - means) / deviations @ w[1:], -30, 30)))


#: Numbers that summarise a document, and the probability below which differences hardly count.
SUMMARY, FLOOR = 5, 0.01


def summary(p: np.ndarray) -> tuple[float, ...]:
    """Of tokens' probabilities: logarithms of the three largest, of their sum, of how many reach 0.5."""
    top = np.zeros(3)
    top[: min(3, len(p))] = np.sort(np.partition(p, -3)[-3:] if len(p) > 3 else p)[::-1]
    return (*np.log(top + FLOOR), np.log(p.sum() + FLOOR), np.log1p((p >= 0.5).sum()))


class Tagger:
    """A field and the emissions of the words that a worker has met."""

    def __init__(self, field: ChainField):
        self.field, self.known = field, {}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([*map(known.__getitem__, words)], np.float64)
        except KeyError:
            if len(known) > _MAX_WORDS_KNOWN:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.field.emission(w)
            return np.array([*map(known.__getitem__, words)], np.float64)

    def tag(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Summaries (documents, SUMMARY) and token probabilities; documents of similar length side by side."""
        rows = [self.emissions(words_of(t)) for t in texts]
        out: list[np.ndarray] = [np.zeros(0)] * len(rows)
        by_length = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
        begin = 0
        while begin < len(by_length):
            shortest, end = len(rows[by_length[begin]]), begin + 1
            while end < len(by_length) and end - begin < 512 and (longest := len(rows[by_length[end]])) <= shortest * 1.15 + 8 and (end + 1 - begin) * longest <= MAX_GRID:
                end += 1
            own = by_length[begin:end]
            longest = len(rows[own[-1]])
            grid = np.zeros((len(own), longest))
            for i, k in enumerate(own):
                grid[i, : len(rows[k])] = rows[k]
            p = self.field.marginals(grid, np.array([len(rows[k]) for k in own]))
            for i, k in enumerate(own):
                out[k] = p[i, : len(rows[k])]
            begin = end
        summaries = np.array([*map(summary, out)]).reshape(-1, SUMMARY)
        return summaries, out


def windows_of(texts: list[bytes], y: np.ndarray, chosen: set[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """All windows of the texts as places in a list of words, that list, and the tokens' labels."""
    known: dict[bytes, int] = {b"": 0}
    telling: list[bool] = [False]
    windows, toxic = [], []
    for text, label in zip(texts, y):
        words = words_of(text)
        if not words:
            continue
        for w in words:
            if w not in known:
                known[w] = len(known)
                telling.append(any(b in chosen for b in _beginnings(w)))
        own = np.zeros(-(-len(words) // WINDOW) * WINDOW, np.int32)
        own[: len(words)] = [known[w] for w in words]
        windows.append(own.reshape(-1, WINDOW))
        toxic.append(np.full((len(windows[-1]), 1), label == 1))
    if not windows:
        return np.zeros((0, WINDOW), np.int32), [*known], np.zeros((0, WINDOW), np.int8)
    places = np.concatenate(windows)
    return places, [*known], (np.array(telling)[places] & np.concatenate(toxic)).astype(np.int8)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ChainField:
    sample = folds.sample(docs, labels, label, MAX_SAMPLE, balanced=True)
    got = sorted((r[0], (r[1] or "").encode(), r[2]) for r in folds.bounded(sample, MAX_SAMPLE_BYTES).collect())
    texts, y = [r[1] for r in got], np.array([r[2] for r in got], np.float64)
    field = ChainField()
    if not y.sum():
        field.trained = False
        return field
    chosen = label_words(texts, y)
    windows, words, tags = windows_of(texts, y, chosen)
    field.fit(windows, words, tags)
    summaries, _ = Tagger(field).tag(texts)
    return field.fit_documents(summaries, y)


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def pieces(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows, and of MAX_PIECE bytes of text or one row."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_pylist()]
    begin = held = 0
    for k, size in enumerate(sizes):
        if k > begin and (held + size > MAX_PIECE or k - begin == rows):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def score(docs: DataFrame, field: ChainField) -> DataFrame:
    """docs with score and spans (start and end, in bytes of the UTF-8 text, of each offending token).

    Columns of docs with these names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(field)
    base = docs.drop("score", "spans")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(known.value)
        for whole in batches:
            for batch in pieces(whole):
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                summaries, p = tagger.tag(texts)
                spans = []
                for text, own in zip(texts, p):
                    bad = np.flatnonzero(own >= 0.5).tolist() if tagger.field.trained else []
                    places = [m.span() for m in _WORD.finditer(text)] if bad else []
                    spans.append([{"start": places[k][0], "end": places[k][1]} for k in bad])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tagger.field.score(summaries), pa.float64()), pa.array(spans, span_type)], names=[*batch.schema.names, "score", "spans"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("score", DoubleType()), StructField("spans", _SPANS)]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", folds.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
