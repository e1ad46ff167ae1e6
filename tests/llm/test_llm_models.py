"""The two learned scores on held-out rows, the pipeline against plain versions of its stages, and the queries' SQL."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grantmill.llm import labels as folds
from grantmill.llm import queries, quality, toxicity

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None), (2, ""), (3, "a"), (4, "idiot " * 30_000), (5, "Plain words here. " * 40), (5, "Plain words here. " * 40), (None, "x")]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@needs_tables
@pytest.mark.parametrize("name, label, least", [("op9_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.93)])
def test_held_out_rows(spark, name, label, least):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= (0.3 if label == "quality" else 0.5)) for i, r in got.items())
    out = [(got[i].predicted, y) for i, y in truth.items() if held_out(i)]
    assert np.mean([p == y for p, y in out]) >= least


def test_training_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(7, 0, 0), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    got = folds.training_rows(labels, "quality").collect()
    assert {r.doc_id for r in got} == {i for i in range(400) if not held_out(i)} and all(r.y == r.doc_id % 2 for r in got)
    assert folds.training_rows(labels, "quality", 50).count() == 50
    balanced = folds.training_rows(labels, "quality", 50, balanced=True).groupBy("y").count().collect()
    assert sorted(map(tuple, balanced)) == [(0, 25), (1, 25)]


@pytest.mark.parametrize("report", [quality.report, toxicity.report])
@pytest.mark.parametrize("rows", [[], [(5, 1, 1)], [(3, 0, 0), (5, 1, 1), (6, 1, 0)]])
def test_edge_rows_get_scores(spark, report, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in EDGE], DOCS).withColumns({"score": F.lit("x"), "spans": F.lit(1), "y": F.lit(2)})
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = report(docs, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    assert report(docs.limit(0), labels).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(rounds=60).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9 and (1, 0) in model.pairs
    assert len(model.score(np.zeros((0, 4)))) == 0


def plain_marginals(field, e):
    """Sum over all paths."""
    import itertools

    total, toxic = 0.0, np.zeros(len(e))
    for path in itertools.product((0, 1), repeat=len(e)):
        w = field.start * path[0] + sum(v for v, s in zip(e, path) if s) + sum(field.change[a, b] for a, b in zip(path, path[1:]))
        total += np.exp(w)
        toxic += np.exp(w) * np.array(path)
    return toxic / total


def test_marginals_are_those_of_all_paths():
    field = toxicity.ChainField()
    field.change, field.start = np.array([[0, -0.7], [0.3, 0.9]]), -1.2
    e = np.array([[0.5, -1, 2, 0.1, -0.3], [-2, 1, 0, 0, 3]])
    for row, got in zip(e, field.marginals(e)):
        assert np.allclose(got, plain_marginals(field, row))
    p, expected = field._expectations(e)
    assert np.allclose(p, field.marginals(e)) and np.isclose(expected.sum(), 2 * 4)


def test_spans_and_unseen_forms(spark):
    rng = np.random.default_rng(3)
    filler = lambda: " ".join(rng.choice(["well", "you", "quite", "plain", "words", "of", "any", "kind", "here", "there"], 25))
    rows = [(i, f"{filler()} loweid{'abc'[i % 3] * (i % 4 + 1)} {filler()}" if i % 2 else filler(), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows + [(1000, "well, you LOWEIDzzz!", "en", "s", 0), (1001, "quite well", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got[1000].score > 0.5 > got[1001].score
    assert ["well, you LOWEIDzzz!".encode()[s.start : s.end] for s in got[1000].spans] == [b"LOWEIDzzz"]


@needs_tables
def test_pipeline(spark):
    """Each stage, written and read, against a plain version over what the stage before has kept."""
    from test_llm_pairs import brute_components, brute_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage{k}")
        out = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage{k}")
        if k < 4:
            assert out.columns == columns
            after = {r.doc_id for r in out.collect()}
        if k == 0:
            scores = {r.doc_id: r.predicted for r in queries.QUERIES["op9_quality"](spark, SF).collect()}
            assert after == {i for i, _ in before if scores[i]}
        elif k == 1:
            assert after == {i for i, _, _, kept, _ in brute_dedup(before) if kept}
        elif k == 2:
            assert after == {i for i, (_, c) in brute_components(before).items() if i == c}
        elif k == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            vocabulary = {w for _, t in items for w in t.lower().split()}
            suspects = [(i, t) for i, t in before if sum(w in vocabulary for w in t.lower().split()) >= 13]
            bad = {i for i, r in brute_report_fast(suspects, items).items() if r}
            assert after == {i for i, _ in before} - bad
        seen.append(out)
        docs = out
    assert {r.doc_id for r in seen[4].collect()} == {r.doc_id for r in seen[3].collect()}


def brute_report_fast(rows, items):
    """Whether documents are contaminated, with a plain set of windows."""
    from test_llm_pairs import words_of

    windows = set()
    for _, t in items:
        w = words_of(t)
        windows |= {tuple(w[s : s + 13]) for s in range(max(1, len(w) - 12) if w else 0)}
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        words, hit = words_of(t), set()
        for k in sizes:
            for p in range(len(words) - k + 1):
                if tuple(words[p : p + k]) in windows:
                    hit.update(range(p, p + k))
        out[i] = bool(hit) and 20 * len(hit) >= len(words)
    return out


@needs_tables
@pytest.mark.parametrize("name", [*queries.ORACLES])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = (queries.QUERIES | queries.CHECKS)[name](spark, SF), con.sql(queries.ORACLES[name])
    key = sorted(got.columns)
    assert key == sorted(expected.columns)
    rows = [tuple(r[c] for c in key) for r in got.collect()]  # not by pandas, where whole numbers beside nulls are floats
    places = [expected.columns.index(c) for c in key]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[k] for k in places)) for r in expected.fetchall())


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


# The additive model against plain loops


def plain_tree(bins, g, h, n_bins, rate, least):
    """The same tree of two levels by trying every cut."""
    inside = lambda v, a, b: sum(x for x, k in zip(v, bins) if a <= k < b)

    def cut(begin, end):
        best, at = 1e-9, None
        g_all, h_all = inside(g, begin, end), inside(h, begin, end)
        for m in range(begin + 1, end):
            gl, hl = inside(g, begin, m), inside(h, begin, m)
            gr, hr = g_all - gl, h_all - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g_all**2 / (h_all + 1)
            if hl >= least / 4 and hr >= least / 4 and gain > best + 1e-12:
                best, at = gain, m
        return at

    middle = cut(0, n_bins)
    halves = [(0, n_bins)] if middle is None else [(0, middle), (middle, n_bins)]
    out = [0.0] * n_bins
    for begin, end in halves:
        at = cut(begin, end)
        for a, b in [(begin, end)] if at is None else [(begin, at), (at, end)]:
            out[a:b] = [rate * inside(g, a, b) / (inside(h, a, b) + 1)] * (b - a)
    return out


def test_trees_of_the_additive_model_equal_a_search_of_all_cuts():
    rng = np.random.default_rng(11)
    model = quality.AdditiveModel(bins=9, least=1.0)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        bins, g, h = rng.integers(0, 9, n), rng.normal(size=n), rng.uniform(0.01, 0.25, n)
        assert np.allclose(model._tree(bins, g, h), plain_tree(bins.tolist(), g.tolist(), h.tolist(), 9, model.rate, 1.0))


def test_quadrants_of_pairs_equal_a_search_of_all_cuts():
    rng = np.random.default_rng(12)
    model = quality.AdditiveModel(pair_bins=5, least=1.0)
    for _ in range(40):
        n = int(rng.integers(8, 80))
        a, b, g, h = rng.integers(0, 5, n), rng.integers(0, 5, n), rng.normal(size=n), rng.uniform(0.05, 0.25, n)
        found, gain = model._quadrants(a * 5 + b, g, h)
        best, want = 0.0, np.zeros((5, 5))
        for i in range(4):
            for j in range(4):
                parts = [(x, y, ((a <= i) == x) & ((b <= j) == y)) for x in (True, False) for y in (True, False)]
                if min(h[m].sum() for *_, m in parts) < 0.25:
                    continue
                own = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for *_, m in parts) - g.sum() ** 2 / (h.sum() + 1)
                if own > best + 1e-12:
                    best, want = own, np.zeros((5, 5))
                    for x, y, m in parts:
                        want[np.ix_((np.arange(5) <= i) == x, (np.arange(5) <= j) == y)] = model.rate * g[m].sum() / (h[m].sum() + 1)
        assert np.isclose(max(gain, 0), best) and np.allclose(found, want.ravel())


def test_scores_of_the_additive_model_equal_a_loop_over_its_tables():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.AdditiveModel(rounds=30, pairs=3).fit(x, y)
    assert model.pairs
    for row, got in zip(x, model.score(x)):
        place = lambda edges, v: sum(e <= v for e in edges)
        value = model.intercept + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, row))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            value += t[place(model.coarse[a], row[a]) * model.pair_bins + place(model.coarse[b], row[b])]
        assert np.isclose(got, 1 / (1 + np.exp(-value)))


def test_toxicity_by_pieces_scores_the_same(monkeypatch):
    """Long texts are told in small pieces and grids, with the scores of the whole."""
    import numpy as np
    import pyarrow as pa

    texts = [None, b"", *(b"good bad worse " * (k * 37 % 90) for k in range(60))]
    field = toxicity.ChainField()
    whole = toxicity.Tagger(field).tag(texts)[0]
    monkeypatch.setattr(toxicity, "MAX_GRID", 300)
    monkeypatch.setattr(toxicity, "MAX_PIECE", 2000)
    batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else t.decode() for t in texts])], names=["text"])
    parts = [*toxicity.pieces(batch)]
    assert sum(p.num_rows for p in parts) == len(texts) and all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 2000 for p in parts)
    own = [toxicity.Tagger(field).tag(p.column(0).cast(pa.binary()).to_pylist())[0] for p in parts]
    np.testing.assert_allclose(np.concatenate(own), whole)
