"""Benchmark decontamination: a broadcast hash set of the benchmark's windows, scanned over all documents.

Words are runs of ASCII letters and digits and of any other character beyond
ASCII, after lower-casing A to Z. A window is 13 consecutive words of an item,
or the whole item if it has fewer. The benchmark's words are numbered; a document
becomes an array of these numbers (0: no benchmark word), so most positions are
dismissed by a running count. Windows that remain are hashed, looked up and
verified word by word.

The set is broadcast only up to ``MAX_BLOCK_BYTES`` of item text; a larger
benchmark is split into such blocks, each scanned on its own, and a document's
spans are merged. Defined results: a null text has no words; items without words
have no window; a null item_id's windows count as hits but are listed as no item;
repeated item rows count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .store import Scratch

WINDOW = 13
MAX_BLOCK_BYTES = 4 << 20
#: A-Z become a-z, what separates words becomes a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WindowSet:
    """The windows of some benchmark items, by length: sorted hashes, word numbers, items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int = WINDOW):
        self.ids = sorted({i for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(numbers) - size + 1) if numbers else 0):
                windows.setdefault(tuple(numbers[i : i + size]), set()).update([] if item is None else [place[item]])
        seed = 1
        while not self._build(windows, seed):  # until no two windows share a hash
            seed += 1

    def _build(self, windows: dict[tuple[int, ...], set[int]], seed: int) -> bool:
        self.by_length = {}
        for k in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == k]
            numbers = np.array(own, dtype=np.uint64)
            factors = np.random.default_rng(seed * 100 + k).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            hashes = (numbers * factors).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            if (np.diff(hashes[order]) == 0).any():
                return False
            self.by_length[k] = factors, hashes[order], numbers[order], [sorted(windows[own[i]]) for i in order]
        return True

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Spans of words that windows cover (start, end), and the items that have windows here."""
        numbers = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), dtype=np.uint64, count=len(words))
        known = np.concatenate(([0], np.cumsum(numbers > 0)))
        starts, lengths, items = [], [], set()
        for k, (factors, hashes, windows, owners) in self.by_length.items():
            if len(words) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            value = np.zeros(len(at), dtype=np.uint64)
            for j in range(k):
                value += numbers[at + j] * factors[j]
            found = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            hit = hashes[found] == value
            at, found = at[hit], found[hit]
            if len(at):
                same = (numbers[at[:, None] + np.arange(k)] == windows[found]).all(axis=1)
                starts += at[same].tolist()
                lengths += [k] * int(same.sum())
                for w in np.unique(found[same]):
                    items.update(owners[w])
        spans: list[tuple[int, int]] = []
        for a, k in sorted(zip(starts, lengths)):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], a + k))
            else:
                spans.append((a, a + k))
        return spans, sorted(self.ids[i] for i in items)


_SPANS = "array<struct<start:int,end:int>>"


def _blocks(benchmark: DataFrame) -> Iterator[tuple[int, list[tuple[str | None, bytes | None]]]]:
    """How many blocks of about MAX_BLOCK_BYTES the items make, and each block, one collected at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.encode(F.col("text"), "UTF-8").alias("text")).distinct()
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = -(-total // MAX_BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield n, [(r[0], None if r[1] is None else bytes(r[1])) for r in (items if n == 1 else items.where(part == b)).collect()]


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column bears it."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _marked(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, str]:
    """docs with one more column, of a name that docs has not: n_words, spans and item_ids."""
    spark, name = docs.sparkSession, _free("_found", docs.columns)
    row = _free("_row", [*docs.columns, name])
    scratch = keyed = parts = None
    for k, (n, block) in enumerate(_blocks(benchmark)):
        windows = spark.sparkContext.broadcast(WindowSet(block, size))
        if n == 1:
            return _scan(docs, windows, name), name
        if keyed is None:
            scratch = Scratch(spark, "decontaminate")
            keyed = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = scratch.save(_scan(keyed.select(row, "text"), windows, name).select(row, f"{name}.*"), f"block{k}")
        windows.unpersist()
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.groupBy(row).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() as " + _SPANS + "), (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).end,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),"
        " concat(acc, array(x))))"
    )
    found = merged.select(row, F.struct("n_words", joined.alias("spans"), "item_ids").alias(name))
    return keyed.join(found, row).drop(row), name


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (of words that benchmark windows cover) and item_ids added.

    A column of docs with one of these names is replaced.
    """
    marked, name = _marked(docs.drop(*_RESULT.fieldNames()), benchmark, size)
    return marked.select("*", f"{name}.*").drop(name)


_RESULT = StructType([
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    StructField("item_ids", ArrayType(StringType())),
])


def _scan(docs: DataFrame, windows, name: str) -> DataFrame:
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = windows.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
                words = words_of(text)
                s, i = found.scan(words) if words else ([], [])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(i)
            own = [batch.column(k) for k in range(batch.num_columns)]
            result = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], names=_RESULT.fieldNames())
            yield pa.RecordBatch.from_arrays([*own, result], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, _RESULT)]))


def n_hit(spans="spans"):
    """Words that windows cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def is_contaminated(spans="spans", n_words="n_words", percent: int = 5):
    return (n_hit(spans) > 0) & (n_hit(spans) * 100 >= F.col(n_words) * percent)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, what: str = "documents") -> DataFrame:
    """what="documents": without contaminated ones; "spans": with the covered words cut from every text.

    All columns of docs stay as they are, whatever their names (but text, where spans are cut).
    """
    marked, name = _marked(docs, benchmark, WINDOW)
    if what == "documents":
        return marked.where(~is_contaminated(f"{name}.spans", f"{name}.n_words")).select(*_own(docs))
    return marked.withColumn("text", F.pandas_udf(_cut, StringType())("text", f"{name}.spans")).select(*_own(docs))


def _cut(texts, spans):
    """The text without the words of the spans; what stands between kept words stays."""
    import pandas as pd

    out = []
    for text, cuts in zip(texts, spans):
        if text is None or not len(cuts):
            out.append(text)
            continue
        raw = text.encode()
        places = [m.span() for m in _WORD.finditer(raw)]
        kept, at = [], 0
        for cut in cuts:
            kept.append(raw[at : places[cut["start"]][0]])
            at = places[cut["end"] - 1][1]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out)
