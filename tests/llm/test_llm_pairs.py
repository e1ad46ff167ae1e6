"""Exact dedup, the n-gram join and decontamination against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from grantmill.llm import decontaminate, exact_dedup, ngram_join
from grantmill.llm.components import components
from grantmill.llm.store import Scratch

LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


EDGE = [(1, None), (2, ""), (3, "Aa bb"), (4, "aA BB"), (5, "É"), (6, "é"), (7, LONG), (8, LONG.upper()), (9, "aa bb"), (10, "x"), (None, "x"), (11, " \n\t")]


# Exact dedup


def brute_dedup(rows, keep=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        best = keep((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)], ids=["sha", "one digit"])
def test_exact_groups(spark, digest):
    rows = EDGE + [(100 + i, f"text {i % 7}") for i in range(40)]
    got = exact_dedup.exact_groups(documents(spark, rows).repartition(5), digest=digest)
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(rows)


def test_levels_of_runs_and_probes(spark):
    rows = EDGE + [(100 + i, f"text {i % 7}") for i in range(40)]
    index = exact_dedup.MergeIndex(documents(spark, rows).repartition(9), fanout=2)
    assert index.levels == 4 and index.n_entries == len({lower(t) for _, t in rows})
    got = index.classes().select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(rows)
    batch = documents(spark, [(1, "TEXT 3"), (2, "unknown"), (3, None), (4, "text 3"), (None, "É")])
    held = {lower(t): max(i for i, x in rows if i is not None and lower(x) == lower(t)) for _, t in rows}
    assert sorted(map(tuple, index.probe(batch).collect()), key=str) == sorted([(1, held["text 3"]), (3, held[""]), (4, held["text 3"]), (None, held["É"])], key=str)


def test_smallest_stays(spark):
    got = exact_dedup.exact_groups(documents(spark, EDGE), keep="smallest")
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(EDGE, min)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None), (3, "")]
    docs = documents(spark, rows).repartition(3)
    kept = [r for r in exact_dedup.exact_groups(docs).collect() if r.kept]
    assert sorted((r.doc_id, r.group_size) for r in kept) == [(1, 1), (2, 4), (3, 2)]
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "b"), (2, "a"), (3, "")]


def test_drop_copies_and_clashing_columns(spark):
    docs = documents(spark, EDGE).withColumns({"digest": F.lit("d"), "keep_id": F.lit(1), "norm": F.lit("n")})
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    expected = {(i, t) for i, t in EDGE} - {(1, None), (3, "Aa bb"), (4, "aA BB"), (7, LONG), (None, "x")}
    assert {(r.doc_id, r.text) for r in left.collect()} == expected
    unique = documents(spark, [(1, "a"), (2, "b")])
    assert exact_dedup.drop_copies(unique).count() == 2


def test_nothing(spark):
    none = documents(spark, [])
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_copies(none).count() == 0
    assert ngram_join.report(none).count() == ngram_join.keep_one(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(documents(spark, EDGE), bench).where("contaminated").count() == 0


# N-gram join


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(seed, n=260):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 9)
    originals = [[word() for _ in range(rng.choice([3, 6, 30, 60, 200]))] for _ in range(12)]
    passage = [word() for _ in range(55)]
    rows = []
    for i in range(n):
        words = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage
        text = rng.choice([" ", "\n", " \t "]).join(words)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("rows_in_group", [2048, 5])
def test_components_are_those_of_all_pairs(spark, monkeypatch, rows_in_group):
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows_in_group)
    rows = near_copies(rows_in_group) + [(1000 + (i or 0), t) for i, t in EDGE if i is not None]
    got = ngram_join.report(documents(spark, rows).repartition(6))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(rows)


def test_words_that_fool_polynomials(spark):
    thue = ["a", "b"]
    for _ in range(12):  # the two collide under any polynomial modulo a power of two
        thue = [thue[0] + thue[1], thue[1] + thue[0]]
    rows = [(1, thue[0]), (2, thue[1]), (3, thue[0].upper())]
    got = {r.doc_id: r.component_id for r in ngram_join.report(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_a_clash_changes_the_seed(spark):
    rows = near_copies(7, 60) + [(500, "aa bb cc dd ee ff"), (501, "xx yy zz uu vv ww"), (502, "a " * 30), (503, "a " * 40)]
    clashing = lambda w, seed: __import__("xxhash").xxh3_64_intdigest(w, seed) if seed > 2 else len(w)
    docs = documents(spark, rows).repartition(3)
    plain = {r.doc_id: r.component for r in ngram_join.find_links(docs).collect()}
    got = {r.doc_id: r.component for r in ngram_join.find_links(docs, word_hash=clashing).collect()}
    same = lambda x: {frozenset(d for d in x if x[d] == c) for c in x.values() if c is not None}
    assert same(got) == same(plain) and got[500] != got[501] and got[502] == got[503]


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(ngram_join, "_CHUNK", 7)
    for text in (b"", b"  ", b"ab cd  efghijklmnop q\r\nrs tu vw xyzab cd " * 3, b"abcdefghijklmno"):
        assert [w for part in ngram_join.words_of(text) for w in part] == text.split()


def test_a_chain_of_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 4)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(100)]  # each is linked with the next only
    rows += [(200 + k, " ".join(words[3 * k : 3 * k + 25] + [f"x{k}_{j}" for j in range(40)])) for k in range(60)]
    got = ngram_join.report(documents(spark, rows).repartition(5))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(rows)


def test_join_edges(spark):
    rows = EDGE[:10] + [(20, "aa bb"), (None, "aa bb"), (None, "lone text of six words here")]
    got = ngram_join.report(documents(spark, rows)).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == by[4] == by[9] == by[20] == (1, 3) and by[7] == by[8] == (5, 7) and by[5] == (1, 5)
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(1, 3), (2, None)]
    docs = documents(spark, rows).withColumns({"component_id": F.lit(5), "owner": F.lit("o")})
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 5, 6, 7, 10]


def test_shingles_of_a_batch_are_those_of_each_text():
    make = ngram_join.Shingles(5, 1)
    texts = [None, b"", b"  \n", b"a", b"a b c d", b"a b c d e", b"A  b\tc\nd e f", LONG.encode(), b"a b c d e " * 3]
    alone = [next(make.sets([t])).tolist() for t in texts]
    assert [s.tolist() for s in make.sets(texts)] == alone
    assert [*map(len, alone)] == [0, 0, 0, 1, 1, 1, 2, 5, 5]
    assert set(alone[5]) <= set(alone[6]) and set(alone[5]) <= set(alone[8]) and not set(alone[4]) & set(alone[5])


def test_packing_of_postings():
    import numpy as np

    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64))
    assert (ngram_join._from_planes(ngram_join._planes(tokens)) == tokens).all()


@pytest.mark.parametrize("rows, each", [(4000, 1000), (20, 200_000)])
def test_counting_and_heads_hold_no_copy_of_a_batch(rows, each):
    import collections
    import tracemalloc
    import types

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 1 << 63, each, dtype=np.uint64)) for _ in range(rows)]
    sets[1] = sets[0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array([each] * rows, pa.int64()), pa.array([t.tobytes() for t in sets], pa.binary())], names=["owner", "n", "tokens"])
    table = np.minimum(sum(np.bincount((t % ngram_join.COUNTERS).astype(int), minlength=ngram_join.COUNTERS) for t in sets), 65535)

    def peak(run, batch):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    heads = ngram_join._heads(types.SimpleNamespace(value=table.astype(np.uint16)), 80)
    assert max(peak(ngram_join._count_tokens, batch.select(["tokens"])), peak(heads, batch)) < batch.nbytes
    # slices too, whose rows begin within the buffers
    counts, slices = np.zeros(ngram_join.COUNTERS, int), [batch.slice(0, 3), batch.slice(3)]
    for found in ngram_join._count_tokens(x.select(["tokens"]) for x in slices):
        for stretch, at, n in zip(*(c.to_pylist() for c in found.columns)):
            counts[(stretch << 15) + np.frombuffer(at, np.uint16).astype(int)] += np.frombuffer(n, np.uint32)
    assert (np.minimum(counts, 65535) == table).all()
    got = collections.defaultdict(list)
    for found in heads(iter(slices)):
        for token, owner in zip(*(c.to_pylist() for c in found.columns)):
            got[owner].append(token)
    k = each - ngram_join.least_overlap(each, 80) + 1
    for owner in (0, 1, 2, 3, rows - 1):
        assert got[owner] == sorted(sets[owner].tolist(), key=lambda t: (table[t % ngram_join.COUNTERS], t))[:k]
    assert {*map(len, got.values())} == {k} and len(got) == rows


def test_connected_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 50)] + [(200, 200 + k) for k in range(1, 60)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.label for r in components(edges, Scratch(spark, "t"), "cc").collect()}
    assert {got[k] for k in range(41)} == {0} and got[50] == 0 and {got[k] for k in (100, 101, 102)} == {100} and {got[200 + k] for k in range(60)} == {200}


# Decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_report(rows, items):
    out = {}
    for i, t in rows:
        words, hit, found = words_of(t), set(), set()
        for item, text in items:
            w = words_of(text)
            k = min(13, len(w))
            for s in range(max(1, len(w) - 12) if w else 0):
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == w[s : s + k]:
                        hit.update(range(p, p + k))
                        found |= {str(item)} if item is not None else set()
        ids = ",".join(sorted(found))
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def contaminated_rows():
    rng = random.Random(3)
    item = lambda n: " ".join(rng.choice("pqrs") * rng.randint(1, 4) for _ in range(n))
    items = [(1, item(20)), (2, item(13)), (10, item(30)), (4, "Short one"), (5, ""), (6, None), (None, item(15)), (1, "other text of the same id"), (9, "É t a i t"), (4, "Short one")]
    rows = []
    for i in range(60):
        words = [rng.choice("xyz") * rng.randint(1, 3) for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(rng.choice([0, 1, 2])):
            text = rng.choice([t for _, t in items if t])
            at = rng.randrange(len(words))
            words[at:at] = re.split(" ", text)[rng.randrange(3) :]
        rows.append((i, rng.choice([" ", "--", ".\n"]).join(words)))
    return rows + [(100 + (i or 0), t) for i, t in EDGE if i is not None], items


@pytest.mark.parametrize("block", [1 << 22, 200])
def test_report_is_that_of_a_plain_scan(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "MAX_BLOCK_BYTES", block)
    rows, items = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(documents(spark, rows), bench)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute_report(rows, items)


def test_removal(spark, monkeypatch):
    rows, items = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows).withColumns({"spans": F.lit("mine"), "n_words": F.lit(-1), "_found": F.lit("f"), "_row": F.lit("r")})
    bad = {i for i, r in brute_report(rows, items).items() if r[4]}
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.dtypes == docs.dtypes and {r.doc_id for r in left.collect()} == {i for i, _ in rows} - bad
    assert {(r.spans, r.n_words, r._found, r._row) for r in left.collect()} == {("mine", -1, "f", "r")}
    monkeypatch.setattr(decontaminate, "MAX_BLOCK_BYTES", 200)
    again = decontaminate.remove_contaminated(docs, bench)
    assert again.dtypes == docs.dtypes and sorted(map(str, again.collect())) == sorted(map(str, left.collect()))
    cut = decontaminate.remove_contaminated(documents(spark, [(1, "keep a. Short-one! keep b"), (2, "short x one")]), bench, "spans")
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "keep a. ! keep b", 2: "short x one"}
