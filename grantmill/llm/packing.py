"""Best-fit packing by bin completion, over the counts of lengths.

Documents longer than a sequence are cut into pieces of the full length (the
first piece may be shorter); all others stay whole. Only the lengths' counts,
as many as a sequence has tokens, reach the driver. There, bin completion takes
the largest length left, enumerates the undominated fillings of the space beside
it and follows them depth first, pruning what wastes more than the incumbent
allows; the incumbent to beat is a best-fit-decreasing packing. A filling is
applied as often as the counts allow, so the search does not grow with the number
of documents. Patterns then give each piece, by its rank among those of its
length, a sequence and an offset.

Defined results: a null text is empty and yields its end token; equal rows are
interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import tokens
from .places import positions
from .store import Scratch

SEQUENCE = 2048
#: Nodes, dominated fillings among them, that the search visits at most before the incumbent is taken.
MAX_NODES = 20_000
#: Nodes whose enumeration is held; those further up start again when the search comes back to them.
OPEN = 32

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing, many equal bins at a time."""
    bins: dict[int, list[list]] = defaultdict(list)  # by free space: [pattern, how many]
    free_spaces: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = bisect.bisect_left(free_spaces, length)
        moved: dict[int, list[list]] = defaultdict(list)
        while left and at < len(free_spaces):
            free = free_spaces[at]
            fits = free // length
            kept = []
            for pattern, n in bins[free]:
                full = min(n, left // fits)
                if full:
                    moved[free - fits * length].append([pattern + (length,) * fits, full])
                    left -= full * fits
                    n -= full
                if n and left:
                    moved[free - left * length].append([pattern + (length,) * left, 1])
                    left, n = 0, n - 1
                if n:
                    kept.append([pattern, n])
            bins[free] = kept
            at += 1
        if left:
            fits = size // length
            full, rest = divmod(left, fits)
            if full:
                moved[size - fits * length].append([(length,) * fits, full])
            if rest:
                moved[size - rest * length].append([(length,) * rest, 1])
        for free, new in moved.items():
            bins[free] += new
        free_spaces = sorted(f for f, b in bins.items() if b)
    return [(tuple(p), n) for own in bins.values() for p, n in own]


def fillings(lengths: list[int], counts: dict[int, int], free: int, waste: int) -> Iterator[Pattern | None]:
    """Undominated sets of lengths, of any number, that leave at most ``waste`` of the free space; fullest first.

    A set is dominated if another length fits in beside it, or if a longer one can
    take the place of one or two of its own; it comes as None, so that the search can
    count it. lengths is sorted ascending.
    """
    own = lengths[: bisect.bisect_right(lengths, free)]
    left = {x: counts[x] for x in own}
    mask = (1 << (free + 1)) - 1
    reach = [1]  # bit t of reach[k]: the first k lengths have a set of sum t
    for x in own:
        bits, copies, step = reach[-1], min(left[x], free // x), 1
        while copies:
            step = min(step, copies)
            bits |= bits << (step * x) & mask
            copies -= step
            step *= 2
        reach.append(bits)

    def exact(k: int, t: int) -> Iterator[Pattern]:
        """Sets of the first k lengths with sum t, the longest first."""
        if not t:
            yield ()
            return
        while k and reach[k] >> t & 1:
            k -= 1
            x = own[k]
            for n in range(min(left[x], t // x), 0, -1):
                if reach[k] >> (t - n * x) & 1:
                    for rest in exact(k, t - n * x):
                        yield (x,) * n + rest

    def dominated(pattern: Pattern, slack: int) -> bool:
        def spare(low: int, high: int) -> bool:
            at = bisect.bisect_left(own, low)
            while at < len(own) and own[at] <= high:
                if left[own[at]] > pattern.count(own[at]):
                    return True
                at += 1
            return False

        if spare(1, slack) or any(spare(x + 1, x + slack) for x in {*pattern}):
            return True
        return any(spare(x + y, x + y + slack) for x, y in set(itertools.combinations(pattern, 2)))

    for total in range(free, max(free - waste, 0) - 1, -1):
        if reach[-1] >> total & 1:
            for pattern in exact(len(own), total):
                yield None if dominated(pattern, free - total) else pattern


def bin_completion(counts: dict[int, int], size: int = SEQUENCE, max_nodes: int = MAX_NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; all counts are used up, with as few bins as found."""
    counts = {k: int(n) for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    incumbent = best_fit(counts, size)
    least = max(-(-total // size), sum(n for k, n in counts.items() if 2 * k > size))
    best = sum(n for _, n in incumbent)
    if best <= least:
        return incumbent
    nodes = 0
    lengths = sorted(counts)
    left = dict(counts)
    chosen: list[tuple[Pattern, int]] = []

    def take(pattern: Pattern, n: int) -> None:
        for x in pattern:
            left[x] -= n
            if not left[x]:
                lengths.remove(x)
            elif left[x] == n and n < 0:
                bisect.insort(lengths, x)

    def give(pattern: Pattern, n: int) -> None:
        for x in pattern:
            if not left[x]:
                bisect.insort(lengths, x)
            left[x] += n

    def options(waste: int, skip: int = 0) -> Iterator[tuple[Pattern, int] | None]:
        top = lengths[-1]
        rest = dict(left)
        rest[top] -= 1
        for filling in itertools.islice(fillings(lengths if rest[top] else lengths[:-1], rest, size - top, waste), skip, None):
            if filling is None:
                yield None
                continue
            pattern = (top, *filling)
            yield pattern, min(left[x] // k for x, k in Counter(pattern).items())

    def spare() -> int:
        """Waste of a packing that beats the incumbent."""
        return (best - 1) * size - total

    stack: list[list] = [[options(spare()), 0, 0, 0, spare()]]  # options, how many were taken, waste so far, bins so far, waste allowed at first
    while stack and nodes < max_nodes and best > least:
        entry = stack[-1]
        if entry[0] is None:  # resumed: what is taken back is as it was
            entry[0] = options(entry[4], entry[1])
        found = next(entry[0], ())
        if found == ():
            stack.pop()
            if chosen:
                give(*chosen.pop())
            continue
        entry[1] += 1
        nodes += 1
        if found is None:
            continue
        pattern, n = found
        wasted = entry[2] + n * (size - sum(pattern))
        if wasted > spare():  # no better than the incumbent
            continue
        take(pattern, n)
        chosen.append((pattern, n))
        if not lengths:
            best, incumbent = entry[3] + n, list(chosen)
            give(*chosen.pop())
            continue
        if len(stack) > OPEN:
            stack[-OPEN][0] = None
        stack.append([options(spare() - wasted), 0, wasted, entry[3] + n, spare() - wasted])
    return incumbent


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, spaced: bool = True, end_id: int = 0, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with_ids adds the ids as bytes (little-endian unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, spaced)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                yield cut(enc, whole.slice(at, 1024))

    def cut(enc: tokens.Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = enc.encode(text or "") + end
            n = len(ids) // 4
            begin, k = 0, 0
            while begin < n:
                length = (n - 1) % size + 1 if k == 0 else size
                own = ids[4 * begin : 4 * (begin + length)]
                for column, value in zip(rows, (doc, k, begin, length, zlib.crc32(own), own if with_ids else None)):
                    column.append(value)
                begin += length
                k += 1
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(rows, types)][: 6 if with_ids else 5]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def assign(ranked: DataFrame, patterns: list[tuple[Pattern, int]]) -> DataFrame:
    """ranked (length, rank, ...) with sequence_id and offset of each piece.

    The k-th use of a length by the patterns takes the k-th stretch of its ranks;
    there are at most a few stretches for each pattern, so the table is small.
    """
    stretches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: (first rank, first sequence, offset)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, n in patterns:
        offset = 0
        for x in pattern:
            stretches[x].append((used[x], first, offset))
            used[x] += n
            offset += x
        first += n
    tables = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*own)) for x, own in stretches.items()}
    known = ranked.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, ends) if len(order) else []:
                ranks, sequences, offsets = known.value[int(length[at[0]])]
                k = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = sequences[k] + rank[at] - ranks[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    fields = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    return ranked.mapInArrow(run, StructType([*ranked.schema.fields, *fields])).drop("rank")


def pack(docs: DataFrame, path: str | None = None, spaced: bool = True, end_id: int = 0, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset. path: the tokenizer's file."""
    scratch = Scratch(docs.sparkSession, "pack")
    path = path or tokens.vocabulary("byte_bpe_50k.json")
    rows = scratch.save(pieces(docs, path, spaced, end_id, size, with_ids), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    ranked = positions(rows, "length", ["doc_id", "piece", "ids_crc32"], name="rank")
    return assign(ranked, bin_completion(counts, size))


def sequences(packed: DataFrame) -> DataFrame:
    """From pack(with_ids=True): sequence_id and its ids, in order of offset; a sequence is bounded by its size."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(own, lambda x: x["ids"]).alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))
