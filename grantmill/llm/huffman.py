"""Token ids in canonical length-limited Huffman code.

Format. A folder holds ``codes`` (id, length of its code) and ``blocks`` (Parquet
files in ascending doc_id order; a row is one block). A block is one byte string
that decodes on its own with the code lengths:

    magic "GMH1", number of documents D (uint32)
    D doc_ids (int64), D flags (uint8, 1: the doc_id is null),
    D token counts (uint32), D byte counts (uint32)
    for each document, the bit offset of every CHECKPOINT-th token from the
    document's first byte (uint32, little-endian as all numbers)
    the documents' codes, each document on a byte boundary, first bit highest

Lengths come from the ids' counts over all documents (package-merge, at most
LIMIT bits, or as many as so many ids need); codes are canonical, in order of length
and id. Checkpoints let a reader decode all stretches of many documents side by side
with one table of an entry for each string of so many bits.

Only counts (one for each id of the vocabulary), bounds and sums of file parts
reach the driver. Defined results: a null text is empty; equal doc_ids stand next
to each other, ordered by their codes; null doc_ids stand first; an empty table
gives an empty folder and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch

LIMIT = 16
CHECKPOINT = 256
BLOCK_BYTES, BLOCK_DOCS = 1 << 18, 1024
#: Pieces that a worker of the encoding pass remembers (about 150 MB).
PIECES = 800_000
#: Tokens that a reader decodes side by side.
DECODE_TOKENS = 1 << 20
#: Tokens of a file part at most, where doc_ids allow it.
PART_TOKENS = 1 << 28
MAGIC = b"GMH1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths (0 for ids that don't occur) of at most ``limit`` bits, or as many as the ids need: package-merge."""
    ids = np.flatnonzero(counts)
    limit = max(limit, (len(ids) - 1).bit_length())
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    if limit > 25:
        raise ValueError(f"{len(ids)} ids: a reader takes codes from words of 32 bits, and 7 of them may be past")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[order].astype(np.int64)
    merged, levels = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, packages))
        place = np.argsort(both, kind="stable")
        merged = both[place]
        levels.append(place < len(weights))
    take = 2 * len(ids) - 2
    for original in reversed(levels):
        k = int(original[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, in its lowest bits."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - before
            before = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each next ``limit`` bits (or as many as the longest code has): id * 256 + length."""
    limit = max(limit, int(lengths.max(initial=0)))
    out = np.zeros(1 << limit, np.int64)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths):
        first = int(codes[i]) << (limit - int(lengths[i]))
        out[first : first + (1 << (limit - int(lengths[i])))] = (int(i) << 8) | int(lengths[i])
    return out


def encode(ids: np.ndarray, doc_lengths: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Codes of documents one after another (each from a byte boundary), their byte counts, their checkpoints."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    last = np.cumsum(doc_lengths)
    first = last - doc_lengths
    before = np.where(first > 0, ends[first - 1], 0)
    sizes = (ends[last - 1] - before + 7) // 8
    starts = np.cumsum(sizes) - sizes
    within = ends - bits - np.repeat(before, doc_lengths)
    at = within + np.repeat(starts * 8, doc_lengths)
    value = codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    word = at >> 5
    new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
    words[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    return words.astype(">u4").tobytes()[: int(sizes.sum())], sizes, [within[a:b:CHECKPOINT].astype("<u4") for a, b in zip(first, last)]


def pack_block(docs: list[tuple]) -> bytes:
    """docs: (doc_id or None, tokens, codes, checkpoints as bytes)."""
    n = len(docs)
    return b"".join((
        MAGIC, struct.pack("<I", n), np.array([d[0] or 0 for d in docs], "<i8").tobytes(), np.array([d[0] is None for d in docs], np.uint8).tobytes(),
        np.array([d[1] for d in docs], "<u4").tobytes(), np.array([len(d[2]) for d in docs], "<u4").tobytes(), *(d[3] for d in docs), *(d[2] for d in docs),
    ))


def decode_block(block: bytes, table: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document."""
    limit = (len(table) - 1).bit_length()
    if block[:4] != MAGIC:
        raise ValueError("no block of this format")
    (n,) = struct.unpack_from("<I", block, 4)
    at = 8
    doc_ids = np.frombuffer(block, "<i8", n, at)
    nulls = np.frombuffer(block, np.uint8, n, at := at + 8 * n)
    counts = np.frombuffer(block, "<u4", n, at := at + n).astype(np.int64)
    sizes = np.frombuffer(block, "<u4", n, at := at + 4 * n).astype(np.int64)
    lanes = -(-counts // CHECKPOINT)
    offsets = np.frombuffer(block, "<u4", int(lanes.sum()), at := at + 4 * n).astype(np.int64)
    raw = np.frombuffer(block, np.uint8, offset=at + 4 * len(offsets))
    wide = np.concatenate((raw, np.zeros(CHECKPOINT * limit // 8 + 8, np.uint8))).astype(np.uint32)
    wide = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    position = offsets + np.repeat((np.cumsum(sizes) - sizes) * 8, lanes)
    begin = 0
    while begin < n:  # so many documents that DECODE_TOKENS is not exceeded, but one at least
        end = begin + max(1, int(np.searchsorted(np.cumsum(counts[begin:]), DECODE_TOKENS, side="right")))
        own = slice(int(lanes[:begin].sum()), int(lanes[:end].sum()))
        at_bit = position[own].copy()
        out = np.empty((CHECKPOINT, len(at_bit)), np.uint32)
        mask = np.uint32((1 << limit) - 1)
        for k in range(min(CHECKPOINT, int(counts[begin:end].max()))):
            entry = table[(wide[at_bit >> 3] >> (32 - limit - (at_bit & 7)).astype(np.uint32)) & mask]
            out[k] = entry >> 8
            at_bit += entry & 255
        flat = np.ascontiguousarray(out.T).ravel()
        lane = 0
        for k in range(begin, end):
            yield (None if nulls[k] else int(doc_ids[k])), flat[lane * CHECKPOINT : lane * CHECKPOINT + counts[k]]
            lane += int(lanes[k])
        begin = end


def encode_texts(docs: DataFrame, path: str, spaced: bool, end_id: int) -> DataFrame:
    """kind 0: doc_id and ids (with the end id) of a document; kind 1: a task's counts of ids, as pairs.

    Ids are little-endian unsigned, of 16 bits if all of the document's fit, else of 32 (wide).
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["kind", "doc_id", "wide", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = tokens.encoder(path, spaced, PIECES), np.zeros(1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                raw = [enc.encode(t or "") + end for t in batch.column(1).to_pylist()]
                ids = np.frombuffer(b"".join(raw), "<u4")
                own = np.bincount(ids, minlength=len(total))
                own[: len(total)] += total
                total = own
                wide = len(total) > 1 << 16
                if not wide:
                    ends = (np.cumsum([*map(len, raw)]) // 2).tolist()
                    narrow = ids.astype("<u2").tobytes()
                    raw = [narrow[a:b] for a, b in zip([0, *ends], ends)]
                n = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0), pa.array([wide] * n), pa.array(raw, pa.binary())], names=names)
        used = np.flatnonzero(total)
        pairs = np.stack((used, total[used])).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([True]), pa.array([pairs], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind int, doc_id long, wide boolean, ids binary")


def count_ids(encoded: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents, from the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    return {r[0]: r[1] for r in encoded.where("kind = 1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect()}


_DOCS = "part int, doc_id long, n_tokens long, codes binary, checkpoints binary"
_BLOCKS = "part int, block int, start long, n_tokens long, n_docs int, data binary"


def write(docs: DataFrame, target: str, path: str, spaced: bool, end_id: int) -> None:
    """Encode all documents into the folder ``target``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "encoded")
    encoded = scratch.save(encode_texts(docs, path, spaced, end_id), "ids", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "1"})
    counts = count_ids(encoded)
    table = np.zeros(max(counts, default=0) + 1, np.int64)
    table[list(counts)] = list(counts.values())
    lengths = code_lengths(table)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id int, length int").coalesce(1).write.parquet(f"{target}/codes")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // PART_TOKENS))
    bounds = encoded.where("kind = 0").agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0] or []
    known = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), np.array(sorted(bounds), np.int64)))

    def encode_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, codes, edges = known.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            group: list[np.ndarray] = []
            first = 0
            size = 0
            for k, (wide, raw_ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                group.append(np.frombuffer(raw_ids, "<u4" if wide else "<u2"))
                size += len(raw_ids)
                if k + 1 < len(names) and size < 1 << 21:
                    continue
                sizes_in = np.array([*map(len, group)], np.int64)
                raw, sizes, marks = encode(np.concatenate(group), sizes_in, lens, codes)
                ends = np.cumsum(sizes).tolist()
                own = names[first : k + 1]
                part = [0 if d is None else int(np.searchsorted(edges, d)) for d in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(own, pa.int64()), pa.array(sizes_in), pa.array([raw[b - s : b] for s, b in zip(sizes.tolist(), ends)], pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())],
                    names=["part", "doc_id", "n_tokens", "codes", "checkpoints"],
                )
                group, first, size = [], k + 1, 0

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, block, start, size = None, 0, 0, 0

        def flush():
            nonlocal block, start, size
            n = sum(d[1] for d in held)
            columns = ([part], [block], [start], [n], [len(held)], [pack_block(held)])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "block", "start", "n_tokens", "n_docs", "data"])
            held.clear()
            block, start, size = block + 1, start + n, 0
            return out

        for batch in batches:
            for p, doc, n, codes, marks in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if held:
                        yield flush()
                    part, block, start, size = p, 0, 0, 0
                held.append((doc, n, codes, marks))
                size += len(codes)
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield flush()
        if held:
            yield flush()

    coded = encoded.where("kind = 0").drop("kind").mapInArrow(encode_docs, _DOCS)
    dealt = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "codes")
    dealt.mapInArrow(make_blocks, _BLOCKS).write.parquet(f"{target}/blocks")
    scratch.drop("ids")


def read(spark: SparkSession, source: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit) of a folder's documents."""
    rows = spark.read.parquet(f"{source}/codes").collect()
    lengths = np.zeros(max((r[0] for r in rows), default=0) + 1, np.uint8)
    for i, n in rows:
        lengths[i] = n
    blocks = spark.read.schema(_BLOCKS).parquet(f"{source}/blocks")
    sums = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, total = {}, 0
    for part, n in sums:
        bases[part] = total
        total += n
    known = spark.sparkContext.broadcast((decode_table(lengths), bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = known.value
        for batch in batches:
            for part, start, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("part", "start", "data"))):
                at = base[part.as_py()] + start.as_py()
                out: list[list] = [[], [], [], [], []]
                for doc, ids in decode_block(data.as_py(), table):
                    raw = ids.astype("<u4").tobytes()
                    for column, value in zip(out, (doc, at, len(ids), zlib.crc32(raw), raw if with_ids else None)):
                        column.append(value)
                    at += len(ids)
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))][: 5 if with_ids else 4]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return blocks.select("part", "start", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def report(docs: DataFrame, path: str | None = None, spaced: bool = False, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents and read them back."""
    scratch = Scratch(docs.sparkSession, "token-ids")
    write(docs, scratch.path("file"), path or tokens.vocabulary("word_bpe_49k.json"), spaced, end_id)
    return read(docs.sparkSession, scratch.path("file"))
