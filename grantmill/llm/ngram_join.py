"""N-gram Jaccard join by a token-group matrix, and the components of its links.

Texts become sets of hashed word shingles; documents with one and the same set
are one entity from then on. The join is exact, in these steps:

1. *Shared shingles.* Shingles meet by hash range. A task first combines its own:
   what two of its entities share goes straight on as shared, with one marker for
   other tasks, so a shingle of a third of all documents arrives once a task.
2. *Bound over everything.* A link at similarity s needs s of an entity's
   shingles in another's, so entities with fewer shared shingles have no link and
   leave; only shared shingles of the others go on.
3. *Groups.* Shared shingles are ordered by how many remaining entities have them
   (counted in a table of fixed size, so a shared passage comes late), then by hash.
   Two linked entities share a shingle among their first m - ceil(s n) + 1 (of m
   shared ones). Entities connected by such shingles form a cluster: no link leaves
   it. A cluster is one group, or several if it is large. A group keeps its members
   and their token union.
4. *Opening.* A member's overlap with a group's token union is its bound; only if it
   reaches ceil(s n) are members compared, through an inverted index of the group.
5. *Matrix of groups.* Of a cluster with several groups, all are first compared with
   one, the hub. Members of the largest component found need no comparison with each
   other any more; only the rest, the stragglers, go on, each to the groups that have
   one of its rarest shingles among theirs. So a cluster of k near copies costs about
   k comparisons with groups, not k squared, and a long chain no more than its
   rarest shingles say.

Results are the connected components. No pair of documents is ever a row. Words are
hashed to 64 bits by xxh3; texts that share a set's hash though they differ are
compared by the words themselves, and a clash changes the seed.

Defined results: a null or empty text has no shingles and links with nothing; a
text with fewer words than a shingle is one shingle; equal rows are equal sets;
a null doc_id takes part but names no component unless it is alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import memory
from .components import components
from .store import BROADCAST_ROWS, Scratch

WORDS, PERCENT = 5, 80
#: Shingles that a task combines at a time, and about as many in each hash range.
FLUSH_TOKENS = 1_500_000
#: Members, and shingles of members, that a group aims at.
GROUP_ROWS, GROUP_TOKENS = 2048, 2_000_000
#: Counters of the table that orders shingles; collisions only make the order less apt.
COUNTERS = 1 << 21
#: Seeds that are tried before clashes are an error; hashes of 64 bits hardly ever need the second.
SEEDS = 20
#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 20
#: Tokens of entities that are counted, or given out as heads, at a time.
_STEP = 1 << 17
#: Words whose hashes a worker remembers, and bytes of the longest of them.
_KNOWN_WORDS, _KNOWN_BYTES = 100_000, 64
_BLANK = re.compile(rb"[\t\n\v\f\r ]")


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


class _WordHashes(dict):
    """Words to their hashes, computed when first met."""

    def __init__(self, seed: int, word_hash: Callable[[bytes, int], int]):
        super().__init__()
        self.seed, self.word_hash = seed, word_hash

    def __missing__(self, word: bytes) -> int:
        h = self.word_hash(word, self.seed)
        if len(word) <= _KNOWN_BYTES:
            if len(self) >= _KNOWN_WORDS:
                self.clear()
            self[word] = h
        return h


class Shingles:
    """Sets of hashed shingles of many texts at a time.

    A word's hash is taken from its bytes (xxh3 unless told otherwise), a shingle's
    is a sum of its words' hashes, each times an odd factor of its place, mixed.
    """

    def __init__(self, words: int, seed: int, word_hash: Callable[[bytes, int], int] = xxhash.xxh3_64_intdigest):
        self.words = words
        self.factors = np.random.default_rng(seed).integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.hashes = _WordHashes(seed, word_hash)

    def sets(self, texts: list[bytes | None], digests: list[bytes] | None = None) -> Iterator[np.ndarray]:
        """The sorted set of each text; digests, if given, gets a digest of each text's words."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            parts, whole = [], xxhash.xxh3_128()
            for words in words_of(text):
                parts.append(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)))
                if digests is not None:
                    whole.update(b" ".join(words) + b" ")
            if digests is not None:
                digests.append(whole.digest())
            held.append(parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts]))
            size += len(held[-1])
            if size > _CHUNK // 8:
                yield from self._chunk(held)
                held, size = [], 0
        if held:
            yield from self._chunk(held)

    def _chunk(self, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
        k = self.words
        edges = np.cumsum([0, *map(len, texts)]).tolist()
        words = np.concatenate(texts)
        n = len(words) - k + 1
        h = np.zeros(max(0, n), np.uint64)
        for j in range(k):
            h += words[j : n + j] * self.factors[j] if n > 0 else h
        h = _mix(h)
        for a, b in itertools.pairwise(edges):
            if b - a >= k:
                own = h[a : b - k + 1]
                own.sort()
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                yield _mix((words[a:b] * self.factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Runs of bytes other than blanks, A to Z lower-cased, in lists that stand for about _CHUNK bytes each."""
    at, n = 0, len(text or b"")
    while at < n:
        blank = _BLANK.search(text, at + _CHUNK) if at + _CHUNK < n else None
        end = blank.start() if blank else n
        words = text[at:end].lower().split()
        if words:
            yield words
        at = end


def exact_set(text: bytes | None, words: int) -> bytes:
    """A digest of the set of shingles, taken from the words themselves."""
    own = [w for part in words_of(text) for w in part]
    found = {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()
    digest = hashlib.sha256()
    for shingle in sorted(found):
        digest.update(b"%d " % len(shingle) + shingle)
    return digest.digest()




def shingles_for(words: int, seed: int, word_hash: Callable[[bytes, int], int]) -> Shingles:
    """One for each Python worker."""
    if word_hash is not xxhash.xxh3_64_intdigest:
        return Shingles(words, seed, word_hash)
    known = memory.of("shingles")
    if (words, seed) not in known:
        known[words, seed] = Shingles(words, seed)
    return known[words, seed]


def _owner(tokens: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "little", signed=True)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def shingle_sets(docs: DataFrame, words: int, seed: int, word_hash: Callable[[bytes, int], int]) -> DataFrame:
    """doc_id, n_shingles, owner (hash of the set; null if empty), digest (of the words in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingles_for(words, seed, word_hash)
        for batch in batches:
            n, owners, digests = [], [], []
            for tokens in make.sets(_texts(batch), digests):
                n.append(len(tokens))
                owners.append(_owner(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(owners, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n_shingles", "owner", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, owner long, digest binary")


def _clashing(docs: DataFrame, sets: DataFrame, scratch: Scratch, words: int, seed: int, word_hash: Callable[[bytes, int], int]) -> bool:
    """Whether texts with one owner have different sets of words in a row.

    Only owners whose texts differ in their words are looked at; their texts are read
    again and their sets compared by the words themselves.
    """
    differ = sets.where("owner is not null").groupBy("owner").agg((F.min("digest") != F.max("digest")).alias("differ"))
    suspects = scratch.save(differ.where("differ").select("owner"), f"suspects{seed}")
    if sets.where("owner = 0").take(1):  # the mark of many owners
        return True
    n = suspects.count()
    if not n:
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingles_for(words, seed, word_hash)
        for batch in batches:
            texts = _texts(batch)
            owners = [_owner(tokens) if len(tokens) else None for tokens in make.sets(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), batch.column(0)], names=["owner", "text"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([exact_set(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["owner", "exact"])

    texts = docs.select("text").mapInArrow(run, "owner long, text string").join(F.broadcast(suspects) if n <= BROADCAST_ROWS else suspects, "owner", "left_semi")
    same = texts.select("owner", "text").mapInArrow(exact, "owner long, exact binary").groupBy("owner").agg((F.min("exact") != F.max("exact")).alias("clash"))
    return bool(same.where("clash").take(1))


# Rows of many postings: for owners k (int64) with n (uint32) shingles, either the
# places of tokens' owners ("which", uint16 or uint32; tokens in sorted order, bytes
# of one weight together, for compression), or tokens owner by owner with "counts".

_PACKED = "kind int, bucket int, owners binary, ns binary, which binary, tokens binary"


def _planes(tokens: np.ndarray) -> bytes:
    return tokens.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _pack_by_token(bucket: int, tokens: np.ndarray, places: np.ndarray, owners: np.ndarray, ns: np.ndarray) -> tuple:
    present = np.zeros(len(owners), bool)
    present[places] = True
    used, which = np.flatnonzero(present), (np.cumsum(present) - 1)[places]
    small = np.uint16 if len(used) < 1 << 16 else np.uint32
    return 0, bucket, owners[used].tobytes(), ns[used].tobytes(), which.astype(small).tobytes(), _planes(tokens)


def _pack_by_owner(bits: int, tokens: np.ndarray, places: np.ndarray, owners: np.ndarray, ns: np.ndarray) -> Iterator[tuple]:
    """Rows of kind 1, by the range of the owner's hash."""
    ranges = (owners.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)[places]
    order = np.lexsort((places, ranges))
    for part in np.split(order, np.flatnonzero(np.diff(ranges[order])) + 1) if len(order) else []:
        used, counts = np.unique(places[part], return_counts=True)
        yield 1, int(ranges[part[0]]), owners[used].tobytes(), ns[used].tobytes(), counts.astype(np.uint32).tobytes(), tokens[part].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "bucket", "owners", "ns", "which", "tokens"])


#: As the owner of a marker: a token that a task has found shared.
_MANY = np.int64(0)


def _split_shared(tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tokens sorted; masks of those with two places or more, and of the first of each of these."""
    if not len(tokens):
        return np.zeros(0, bool), np.zeros(0, bool)
    same = tokens[1:] == tokens[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return shared, shared & np.concatenate(([True], ~same))


def packed_postings(docs: DataFrame, words: int, seed: int, bits: int, word_hash: Callable[[bytes, int], int]) -> DataFrame:
    """Kind 0: postings to be met by token range; kind 1: postings found shared here."""

    def flush(sets: list[np.ndarray], owners: list[int]) -> Iterator[pa.RecordBatch]:
        own, ns = np.array([*owners, _MANY], np.int64), np.array([*map(len, sets), 0], np.uint32)
        tokens, places = np.concatenate(sets), np.repeat(np.arange(len(sets)), ns[:-1])
        order = np.argsort(tokens)
        tokens, places = tokens[order], places[order]
        shared, first = _split_shared(tokens, places)
        yield _batch([*_pack_by_owner(bits, tokens[shared], places[shared], own, ns)])
        places[first] = len(sets)
        keep = ~shared | first
        tokens, places = tokens[keep], places[keep]
        ends = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64), side="right")
        begin = 0
        for bucket, end in enumerate(ends):
            if end > begin:
                yield _batch([_pack_by_token(bucket, tokens[begin:end], places[begin:end], own, ns)])
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, sets, owners, size = shingles_for(words, seed, word_hash), set(), [], [], 0
        for batch in batches:
            for tokens in make.sets(_texts(batch)):
                if not len(tokens):
                    continue
                owner = _owner(tokens)
                if owner in seen:
                    continue
                seen.add(owner)
                sets.append(tokens)
                owners.append(owner)
                size += len(tokens)
                if size >= FLUSH_TOKENS:
                    yield from flush(sets, owners)
                    seen, sets, owners, size = set(), [], [], 0
        if sets:
            yield from flush(sets, owners)

    return docs.select("text").mapInArrow(run, _PACKED)


def _shared_postings(bits: int):
    """Of one token range, the postings of tokens that two owners have, by owner; kind 1 passes."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() == 1:
            yield from batches
            return
        tokens, owners, ns = [], [], []
        for batch in batches:
            for row in batch.select(["owners", "ns", "which", "tokens"]).to_pylist():
                own = np.frombuffer(row["owners"], np.int64)
                t = _from_planes(row["tokens"])
                which = np.frombuffer(row["which"], np.uint16 if len(row["which"]) == 2 * len(t) else np.uint32)
                tokens.append(t)
                owners.append(own[which])
                ns.append(np.frombuffer(row["ns"], np.uint32)[which])
        tokens, owners, ns = np.concatenate(tokens), np.concatenate(owners), np.concatenate(ns)
        order = np.argsort(tokens)
        tokens = tokens[order]
        group = np.cumsum(np.concatenate(([0], tokens[1:] != tokens[:-1])))
        owners, ns = owners[order], ns[order]
        first = owners[np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))]
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[owners != first[group]]] = True
        mixed[group[owners == _MANY]] = True
        live = mixed[group] & (owners != _MANY)
        used, where, places = np.unique(owners[live], return_index=True, return_inverse=True)
        yield _batch([*_pack_by_owner(bits, tokens[live], places, used, ns[live][where] if len(used) else np.zeros(0, np.uint32))])

    return run


def least_overlap(n, percent: int):
    """ceil(percent * n / 100)."""
    return (n * percent + 99) // 100


def _promising(percent: int):
    """Of one owner range, the owners whose shared tokens reach the bound, with these tokens."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, ns, tokens = [], [], []
        for batch in batches:
            for row in batch.select(["owners", "ns", "which", "tokens"]).to_pylist():
                counts = np.frombuffer(row["which"], np.uint32)
                owners.append(np.repeat(np.frombuffer(row["owners"], np.int64), counts))
                ns.append(np.repeat(np.frombuffer(row["ns"], np.uint32), counts))
                tokens.append(np.frombuffer(row["tokens"], np.uint64))
        owners, ns, tokens = np.concatenate(owners), np.concatenate(ns), np.concatenate(tokens)
        order = np.lexsort((tokens, owners))
        owners, ns, tokens = owners[order], ns[order], tokens[order]
        new = np.concatenate(([True], (owners[1:] != owners[:-1]) | (tokens[1:] != tokens[:-1]))) if len(owners) else np.zeros(0, bool)
        owners, ns, tokens = owners[new], ns[new], tokens[new]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1)) if len(owners) else np.zeros(0, int)
        ends = np.append(starts[1:], len(owners))
        keep = (ends - starts) >= least_overlap(ns[starts].astype(np.int64), percent)
        starts, ends = starts[keep], ends[keep]
        for i in range(0, len(starts), 1000):
            part = [tokens[a:b].tobytes() for a, b in zip(starts[i : i + 1000], ends[i : i + 1000])]
            s = starts[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(owners[s]), pa.array(ns[s].astype(np.int64)), pa.array(part, pa.binary())], names=["owner", "n", "tokens"])

    return run


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The tokens of each row, as views of the batch."""
    return (np.frombuffer(row.as_buffer(), np.uint64) for row in column)


def _counters(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).view(np.int64)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by counter, in stretches of 2 ** 15 counters; only those in use."""
    total = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for tokens in _lists(batch.column(0)):
            for a in range(0, len(tokens), _STEP):
                np.add.at(total, _counters(tokens[a : a + _STEP]), np.uint32(1))
    used = np.flatnonzero(total)
    for part in np.split(used, np.searchsorted(used, np.arange(1 << 15, COUNTERS, 1 << 15))):
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[0]) >> 15], pa.int32()), pa.array([(part & 0x7FFF).astype(np.uint16).tobytes()], pa.binary()), pa.array([total[part].tobytes()], pa.binary())], names=["stretch", "at", "n"])


def _sum_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 15, np.int64)
    for batch in batches:
        for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["stretch", "n"])


def token_counts(near: DataFrame) -> np.ndarray:
    """How many entities have a token, by counter, up to 65535; 4 MB whatever the input."""
    out = np.zeros(COUNTERS, np.uint16)
    parts = near.select("tokens").mapInArrow(_count_tokens, "stretch int, at binary, n binary").groupBy("stretch").applyInArrow(_sum_counts, "stretch int, n binary")
    for stretch, n in parts.collect():
        out[stretch << 15 : (stretch + 1) << 15] = np.frombuffer(n, np.uint16)
    return out


def _head_rows(tokens: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], names=["token", "owner"])


def _heads(counts, percent: int):
    """(token, owner) of the shingles that two linked entities can't both miss, the rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            out, owners, size = [], [], 0
            for owner, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2))):
                k = len(tokens) - least_overlap(n, percent) + 1
                order = np.lexsort((tokens, table[_counters(tokens)]))[:k]
                out.append(tokens[order].view(np.int64))
                owners.append(np.full(k, owner, np.int64))
                size += k
                if size >= _STEP:
                    yield _head_rows(out, owners)
                    out, owners, size = [], [], 0
            if out:
                yield _head_rows(out, owners)

    return run


class Group:
    """Members of a group: owners, sizes of their whole sets, shared tokens (each sorted)."""

    def __init__(self, owners: np.ndarray, ns: np.ndarray, sets: list[np.ndarray]):
        self.owners, self.ns, self.sets = owners, ns.astype(np.int64), sets
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens = tokens[order]
        self.places = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        first = np.concatenate(([True], self.tokens[1:] != self.tokens[:-1]))
        self.union = self.tokens[first]
        self.starts = np.append(np.flatnonzero(first), len(self.tokens))

    def linked(self, tokens: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Places of the members that a set of n shingles with these shared tokens is linked to."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < least_overlap(n, percent):  # the bound: the group stays closed
            return np.zeros(0, np.int64)
        low, counts = self.starts[at], self.starts[at + 1] - self.starts[at]
        reach = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
        common = np.bincount(self.places[reach], minlength=len(self.ns))
        return np.flatnonzero((100 + percent) * common >= percent * (n + self.ns))

    def by_share(self) -> list[int]:
        """Members in order, those first of whose shingles most are shared."""
        return np.argsort(-np.array([len(s) for s in self.sets]) / self.ns, kind="stable").tolist()


class Sets:
    """Disjoint sets over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up, self.left = list(range(n)), n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.left -= 1
        return x != y


def link_within(group: Group, percent: int) -> np.ndarray:
    """For each member the place of its component's first member."""
    sets = Sets(len(group.sets))
    for i in group.by_share():
        if sets.left == 1:
            break
        for j in group.linked(group.sets[i], int(group.ns[i]), percent).tolist():
            sets.join(i, j)
    return np.array([sets.root(i) for i in range(len(group.sets))])


def link_across(one: Group, labels_one: np.ndarray, two: Group, labels_two: np.ndarray, percent: int) -> set[tuple[int, int]]:
    """Pairs of labels that links between the groups connect; just enough of them."""
    number = {r: k for k, r in enumerate(dict.fromkeys([*labels_one.tolist(), *labels_two.tolist()]))}
    sets, edges = Sets(len(number)), set()
    for i in one.by_share():
        if sets.left == 1:
            break
        a = int(labels_one[i])
        for j in two.linked(one.sets[i], int(one.ns[i]), percent).tolist():
            b = int(labels_two[j])
            if sets.join(number[a], number[b]):
                edges.add((a, b))
    return edges


_GROUP = "cluster long, part int, owners binary, ns binary, roots binary, counts binary, tokens binary"
_PAYLOAD = ("owners", "ns", "roots", "counts", "tokens")


def _build_groups(percent: int, link: bool = True):
    """A group's row. link=False: members come with the column root, which stays."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("owner", "n", "tokens", "root")))
        rows.sort(key=lambda r: r[0])
        own, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        roots = own[link_within(Group(own, n, sets), percent)] if link else np.array([r[3] for r in rows], np.int64)
        payload = (own, n, roots, np.array([*map(len, sets)], np.int64), np.concatenate(sets))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in payload)], names=["cluster", "part", *_PAYLOAD])

    return run


def _unpack(row: dict, tail: str = "") -> tuple[Group, np.ndarray]:
    own, n, roots, counts = (np.frombuffer(row[c + tail], np.int64) for c in ("owners", "ns", "roots", "counts"))
    return Group(own, n, np.split(np.frombuffer(row["tokens" + tail], np.uint64), np.cumsum(counts)[:-1])), roots


def _open_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                edges = link_across(*_unpack(row), *_unpack(row, "2"), percent)
                a, b = zip(*edges) if edges else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, root) of every member of a group."""
    for batch in batches:
        for own, roots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own, np.int64)), pa.array(np.frombuffer(roots, np.int64))], names=["owner", "root"])


def _cross_links(one: DataFrame, two: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """(a, b) of roots, from all pairs of a group of one and a group of two with the same keys."""
    other = two.select(*keys, *(F.col(c).alias(c + "2") for c in _PAYLOAD))
    return one.select(*keys, *_PAYLOAD).join(other, keys).mapInArrow(_open_pairs(percent), "a long, b long")


def _relabel(members: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """members (owner, root) with the roots that edges connect made one."""
    if not edges.take(1):
        return members
    labels = components(edges, scratch, name).withColumnRenamed("node", "root")
    return members.join(labels, "root", "left").select("owner", F.coalesce("label", "root").alias("root"))


def _link_groups(near: DataFrame, clusters: DataFrame, heads: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(owner, root) of all entities of clusters; the root names the component."""
    found = near.join(clusters, "owner")
    sizes = found.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int").alias("parts"))
    dealt = found.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("owner"), F.col("parts")).cast("int"))
    dealt = scratch.save(dealt.select("cluster", "part", "parts", "owner", "n", "tokens", F.lit(None).cast("long").alias("root")), "dealt")
    groups = scratch.save(dealt.drop("parts").groupBy("cluster", "part").applyInArrow(_build_groups(percent), _GROUP), "groups")
    members = first = groups.select("owners", "roots").mapInArrow(_rooted, "owner long, root long")
    large = dealt.where("parts > 1").select("cluster").distinct()
    if not large.take(1):
        return members
    several = groups.join(large, "cluster", "left_semi")
    hubs, rest = several.where("part = 0"), several.where("part > 0")
    edges = scratch.save(_cross_links(hubs, rest, percent, ["cluster"]), "hub-links")
    members = scratch.save(_relabel(members, edges, scratch, "hub"), "hub-members")
    placed = scratch.save(dealt.where("parts > 1").drop("root", "part", "parts").join(members, "owner"), "placed")
    most = placed.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("most")).select("cluster", F.col("most.root").alias("main"))
    left = scratch.save(placed.join(most, "cluster").where("root <> main").drop("main"), "left")
    # a straggler meets only those groups that have one of its rarest shingles among theirs, as two linked entities must
    held = heads.join(dealt.where("parts > 1 AND part > 0").select("owner", "cluster", "part"), "owner").select("token", "cluster", "part").distinct()
    meets = scratch.save(heads.join(left.select("owner"), "owner", "left_semi").join(held, "token").select("owner", "cluster", "part").distinct(), "meets")
    shares = left.join(meets, ["owner", "cluster"])
    again = shares.groupBy("cluster", "part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int").alias("lots"))
    lots = shares.join(again, ["cluster", "part"]).withColumn("lot", F.pmod(F.xxhash64("owner"), F.col("lots")).cast("int"))
    stragglers = lots.groupBy("cluster", "part", "lot").applyInArrow(_build_groups(percent, link=False), _GROUP)
    later = scratch.save(_cross_links(stragglers, rest, percent, ["cluster", "part"]), "straggler-links")
    # groups still bear their first roots: connect these and the later ones alike
    return _relabel(first, edges.unionByName(later), scratch, "straggler")


def find_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, word_hash: Callable[[bytes, int], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """doc_id, n_shingles and component (of the links) of each document; null: no shingles."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    for seed in itertools.count(1):
        sets = scratch.save(shingle_sets(docs, words, seed, word_hash), f"sets{seed}")
        if not _clashing(docs, sets, scratch, words, seed, word_hash):
            break
        if seed == SEEDS:
            raise RuntimeError(f"hashes of different sets clash under {SEEDS} seeds")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(3, (int(total) // FLUSH_TOKENS).bit_length())
    packed = packed_postings(docs, words, seed, bits, word_hash)
    shared = packed.groupBy("kind", "bucket").applyInArrow(_shared_postings(bits), _PACKED)
    near = shared.groupBy("bucket").applyInArrow(_promising(percent), "owner long, n long, tokens binary")
    near = scratch.save(near, "near")
    counts = docs.sparkSession.sparkContext.broadcast(token_counts(near))
    heads = scratch.save(near.mapInArrow(_heads(counts, percent), "token long, owner long"), "heads")
    hubs = heads.groupBy("token").agg(F.min("owner").alias("hub"), F.max("owner").alias("last")).where("hub <> last").select("token", "hub")
    edges = heads.join(hubs, "token").where("owner <> hub").select(F.col("owner").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(edges, scratch, "clusters").select(F.col("node").alias("owner"), F.col("label").alias("cluster"))
    members = scratch.save(_link_groups(near, clusters, heads, scratch, percent), "members")
    scratch.drop("near", "heads", "dealt", "groups", "hub-links", "hub-members", "placed", "left", "meets", "straggler-links")
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS // 2 else members
    return sets.select("doc_id", "n_shingles", "owner").join(members, "owner", "left").select("doc_id", "n_shingles", F.coalesce("root", "owner").alias("component"))


def report(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component)."""
    found = find_links(docs, words, percent)
    found = Scratch(docs.sparkSession, "ngram-report").save(found, "found")
    sizes = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    names = Scratch(docs.sparkSession, "ngram-names").save(sizes.where("_n > 1").drop("_n"), "names")  # a document alone names itself
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS // 2 else names
    return found.join(names, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component the document with the smallest doc_id, with all its columns; all without shingles.

    Repeated rows of that doc_id stay, all of them.
    """
    found = Scratch(docs.sparkSession, "ngram-keep").save(report(docs, words, percent), "found")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti").select(*docs.columns)
