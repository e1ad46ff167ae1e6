"""Cases beyond what the operators once covered: whole hosts, whole texts, long chains, many small pieces, files on disk."""

import hashlib
import itertools
import json
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grantmill.llm import html_text, huffman, packing, resharding, tool_calls, toxicity
from grantmill.llm import labels as folds

# Pages

FIXED = "<div><p>Ann writes for us.</p></div>"


def page(k, body="", tag="article"):
    return f"<html><body><{tag}><h1>Head {k}</h1>{body}<ul><li>Item {k}</li></ul></{tag}></body></html>"


def test_a_host_with_few_pages_keeps_its_text(spark):
    rows = [(k, "http://one.example/x", page(1, FIXED, "section")) for k in range(9)]  # copies of one page
    got = {r.text for r in html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {"Head 1\nAnn writes for us.\nItem 1"}


def test_every_page_of_a_host_tells_what_is_template(spark):
    pages = sorted((page(k, "<h2>Shared</h2>" if k else "<h2>Other</h2>", "section") for k in range(40)), key=html_text._mark)
    odd = [p for p in pages if "Other" in p]
    pages = [p for p in pages if p not in odd] + odd  # in no small sample
    rows = [(k, "http://big.example/x", p) for k, p in enumerate(pages)]
    got = {r.text for r in html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert len(got) == 40 and all("Shared" in t or "Other" in t for t in got)


def test_template_text_within_articles_goes(spark):
    rows = [(k, "http://a.example/x", page(k, FIXED)) for k in range(5)]
    got = {r.page_id: r.text for r in html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: f"Head {k}\nItem {k}" for k in range(5)}


def texts_of(spark, pages):
    rows = [(k, "http://a.example/x", p) for k, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_the_wrapper_finds_the_main_text_without_names(spark):
    words = lambda k, n: " ".join(f"w{k}{'abcdefgh'[j % 8]}" for j in range(n))
    links = lambda k: "".join(f'<li><a href="/{j}">{words(k, 2)}</a></li>' for j in range(6))
    pages = [f'<body><div class="xa">{words(k, 4)}</div><div class="xb"><div class="xc"><h2>Head {k}</h2><p>{words(k, 60)}</p><p>{words(k, 30)}</p><ul>{links(k)}</ul></div></div><div class="xe"><ul>{links(k)}</ul></div></body>' for k in range(6)]
    assert texts_of(spark, pages) == {k: f"Head {k}\n{words(k, 60)}\n{words(k, 30)}" for k in range(6)}
    alone = f'<body><div class="xa">a b</div><div class="xb"><p>{words(1, 50)}</p></div></body>'  # too few pages to align
    assert texts_of(spark, [alone]) == {0: f"a b\n{words(1, 50)}"}


def test_copies_of_one_article_keep_their_text(spark):
    pages = [f"<html><script>track({k})</script><body><div class='ad'>buy {k}</div><article><h1>Head</h1><p>all the same</p></article></body></html>" for k in range(6)]
    assert texts_of(spark, pages) == dict.fromkeys(range(6), "Head\nall the same")


def test_blocks_of_article_like_names_without_a_host(spark):
    pages = [f"<body><main><p>one {k}</p></main><article><p>two {k} {'long ' * 30}</p></article></body>" for k in range(4)]
    assert texts_of(spark, pages) == {k: f"two {k} " + " ".join(["long"] * 30) for k in range(4)}


def test_pages_that_strain_the_parser(spark):
    deep = "<div>" * 3000 + "inner <p>text</p>" + "</div>" * 3000
    hidden = "<div>" * 250 + '<nav><div>menu</div></nav>seen' + "</div>" * 250
    wide = "".join(f"<p>a{k}</p><pre>b{k}</pre>" for k in range(20_000))
    quotes = '<a "' * 20_000 + "x"
    odd = '<a "x>"' * 20_001 + '<b ="x>"' * 20_001 + "<p>end</p>"
    names = "<p " + "n" * 100_000 + ">named</p>"
    got = texts_of(spark, [f"<article>{x}</article>" for x in (deep, wide, names, hidden)] + [quotes, odd])
    assert got[0] == "inner\ntext" and got[2] == "named" and got[3] == "seen"
    assert got[1] == "\n".join(f"{x}{k}" for k in range(20_000) for x in "ab") and got[5].endswith("end")


@pytest.mark.parametrize("seed", range(5))
def test_alignments(seed):
    rng = np.random.default_rng(seed)
    a, b = (tuple(rng.choice(list("pqrst"), rng.integers(0, 9))) for _ in range(2))
    best = max(n for n in range(min(len(a), len(b)) + 1) if {*itertools.combinations(a, n)} & {*itertools.combinations(b, n)})
    for align, least in ((html_text._by_table, best), (html_text._by_occurrence, 0)):
        found = align(a, b)
        assert [i for i, _ in found if i is not None] == [*range(len(a))] and [j for _, j in found if j is not None] == [*range(len(b))]
        pairs = [(i, j) for i, j in found if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) >= least


# Toxicity


def test_all_windows_of_a_document_are_learned():
    texts = [b"plain " * 100 + b"late " * 300 + b"loweid " + b"plain " * 30, b"plain " * 480]
    windows, words, tags = toxicity.windows_of(texts, np.array([1.0, 0.0]), {b"late ", b"lowe"})
    assert [words[k] for k in windows.ravel() if words[k]] == b" ".join(texts).split()
    assert tags.sum() == 301 and not tags[-10:].any()


def test_words_that_some_clean_documents_hold_still_tell():
    texts = [b" ".join(bytes([97 + k // 26, 97 + k % 26, 97 + i]) for i in range(5)) + b" plain" + (b" clown" if k % 2 or k % 100 == 0 else b"") for k in range(400)]
    y = np.arange(400) % 2
    assert b"clown " in toxicity.label_words(texts, y) and b"plain " not in toxicity.label_words(texts, y)


def test_the_score_is_not_bounded_by_the_worst_token():
    field = toxicity.ChainField()
    field.document = np.zeros(5), np.ones(5), np.array([3.0, 0.5, 0, 0, 0, 0])
    assert field.score(np.array([toxicity.summary(np.array([0.2]))]))[0] > 0.5


def test_one_chance_hit_is_not_toxicity(spark):
    rng = np.random.default_rng(5)
    calm = lambda n: [f"w{k}" for k in rng.integers(0, 400, n)]
    rows = [(k, " ".join(calm(60) + (["loweid", "trashy", "scummy"] * 2 if k % 4 == 0 else ["loweid"] if k % 10 == 1 else []))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.report(docs, labels).collect()}
    assert got == {k: int(k % 4 == 0) for k in range(600)}


# Tool calls


@pytest.mark.parametrize("local", [100_000, 2])
def test_long_chains_are_no_cycles(spark, monkeypatch, local):
    monkeypatch.setattr(tool_calls, "LOCAL_NEEDS", local)
    n = 300 if local > 2 else 70
    calls = [{"id": f"c{k}", "depends_on": [f"c{j}" for j in (k - 1, k - 2) if j >= 0]} for k in range(n)]
    calls += [{"id": "p", "depends_on": ["q", "c0"]}, {"id": "q", "depends_on": ["p"]}, {"id": "r", "depends_on": ["q"]}]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls[::-1]}))]
    got = {r.call_id: r.depth for r in tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()}
    assert got == {f"c{k}": k for k in range(n)} | {"p": -1, "q": -1, "r": -1}


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_rows_that_cannot_be_read_are_problems(spark):
    deep, half = "[" * 3000 + "]" * 3000, '"\\ud800"'
    bad = [{"type": "string", "pattern": "("}, {"minLength": "3"}, {"type": [{}]}, {"type": "object", "required": 5}, {"enum": 5}, {"pattern": "^(a+)+$"}, {"properties": 3}, {"allOf": 1}]
    tools = [{"name": f"t{k}", "parameters": s} for k, s in enumerate(bad)]
    values = ["a", "abc", "a", {}, 1, "a" * 40 + "!", {"a": 1}, 1]
    calls = [{"id": f"c{k}", "name": f"t{k}", "arguments": json.dumps(v)} for k, v in enumerate(values)]
    rows = [
        (1, 0, "system", json.dumps({"tools": tools})), (1, 1, "assistant", json.dumps({"tool_calls": calls})),
        (2, 0, "assistant", '{"tool_calls": [{"id": ' + half + ', "name": ' + half + ', "arguments": {"x": ' + half + "}}]}"), (2, 1, "tool", '{"tool_call_id": ' + half + ', "content": ' + half + "}"),
        (3, 0, "assistant", '{"tool_calls": [{"id": "d", "arguments": ' + deep + "}]}"), (4, 0, "assistant", '{"tool_calls": [{"id": 1e999, "arguments": {"n": 1e999, "m": ' + "9" * 400 + "}}]}"),
    ]
    got = tool_calls.link(spark.createDataFrame(rows, CONVERSATION)).collect()
    assert len({r.problem for r in got if r.conv_id == 1 and r.kind == "call"}) > 2 and all(r.problem for r in got if r.conv_id == 1 and r.kind == "call")
    assert {(r.kind, r.linked) for r in got if r.conv_id == 2 and r.kind != "message"} == {("call", True), ("result", True)}
    assert '"x":"\\ud800"' in next(r.json for r in got if r.conv_id == 2 and r.kind == "call")
    assert [r.problem for r in got if r.conv_id == 3] == ["nested too deeply"] and len([r for r in got if r.conv_id == 4]) == 2


def test_turns_become_calls(spark):
    rows = [(1, 0, "system", "Be\nshort"), (1, 1, "user", "Hi"), (1, 2, "assistant", 'say "x" ' * 9), (1, 3, "user", None), (1, 4, "assistant", None), (1, 5, "user", "é"), (1, None, "user", "t"), (None, 0, "assistant", "x")]
    made = tool_calls.from_turns(spark.createDataFrame(rows, CONVERSATION).withColumns({"id": F.lit("i"), "name": F.lit("n")}))
    got = {(r.conv_id, r.turn, r.kind): r for r in tool_calls.link(made).collect()}
    assert (got[1, 2, "call"].depth, got[1, 4, "call"].depth, got[1, 4, "call"].problem, got[1, 2, "call"].valid) == (0, 1, "$.words: minimum", True)
    assert got[1, 3, "result"].anchor_turn == 2 and got[1, 5, "result"].linked and got[1, 1, "result"].problem == "no call"
    assert json.loads(got[1, 2, "message"].json)["content"] == 'say "x" ' * 9 and json.loads(got[1, None, "message"].json)["content"] == "t"
    assert len(got) == 11 and not got[None, 0, "call"].linked


# Shards


def test_rewrite_replaces_only_what_changes(spark, tmp_path):
    target = str(tmp_path / "store")
    rows = [(k, "x" * 10, "aa"[: k % 3], k % 3) for k in range(90)] + [(0, "x" * 10, "other", 0)] * 2 + [(500, "kept", "", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int").write.partitionBy("shard").parquet(target)
    before = sorted(str(f) for f in (tmp_path / "store/shard=3").glob("part-*"))
    docs = spark.read.parquet(target)
    moved = {0: 0, 1: 0, 2: 1, 3: 3}  # shard 2 is emptied
    places = [(i, len(t) + 1, zlib.crc32(t.encode()), o, moved[o], k) for k, (i, t, _, o) in enumerate(rows)]
    spark.createDataFrame(places, "doc_id long, size long, text_crc32 long, old int, shard int, slot long").write.parquet(str(tmp_path / "places"))
    assert resharding.rewrite(docs, spark.read.parquet(str(tmp_path / "places")), target) == [0, 1, 2]
    got = spark.read.parquet(target).select("doc_id", "text", "lang", "shard").collect()
    assert sorted(map(tuple, got)) == sorted((i, t, x, moved[o]) for i, t, x, o in rows)
    assert sorted(str(f) for f in (tmp_path / "store/shard=3").glob("part-*")) == before


def test_report_comes_from_rewritten_files(spark, monkeypatch):
    seen = []
    real = resharding.YearLog
    monkeypatch.setattr(resharding, "YearLog", lambda *args, **options: (seen.append(real(*args, **options)), seen[-1])[1])
    docs = spark.createDataFrame([(k // 2, "same", "s%d" % (k % 5)) for k in range(200)], "doc_id long, text string, source string")
    got = resharding.report(docs).collect()
    assert seen[0].versions() == [0, 1]
    held = seen[0].read().collect()
    assert len(got) == len(held) == 200 and {r.shard for r in held} == set(range(16))
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((r.doc_id, r.shard) for r in held)


def test_capacities_must_hold_all_rows(spark):
    docs = spark.createDataFrame([(k, "x" * 9, "s") for k in range(20)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="200 bytes"):
        resharding.reshard(docs, 2, old=F.lit(0), capacities={0: 50, 1: 60})
    roomy = resharding.reshard(docs, 2, old=F.lit(0), capacities={0: 150, 1: 150}).collect()
    assert sorted(r.doc_id for r in roomy) == [*range(20)] and sum(r.size for r in roomy if r.shard == 1) == 50


def paths(field, emissions):
    """Probability of the toxic state at each place, summed over all paths."""
    weights = {}
    for path in itertools.product((0, 1), repeat=len(emissions)):
        x = field.start * path[0] + sum(e for e, s in zip(emissions, path) if s) + sum(field.change[a, b] for a, b in itertools.pairwise(path))
        weights[path] = np.exp(x)
    total = sum(weights.values())
    return np.array([sum(w for p, w in weights.items() if p[k]) / total for k in range(len(emissions))])


def test_scores_are_those_of_all_paths(spark):
    kinds = ["calm plain words", "you loweid", "some LOWEIDs here", "", "trashy loweid loweid", "quite calm"]
    rows = [(k, kinds[k % 6] + f" w{k % 5}") for k in range(120)] + [(200, None), (201, "loweid\ttrashy, calm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int("owe" in kinds[k % 6].lower())) for k in range(120)], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, field).collect():
        words = toxicity.words_of((r.text or "").encode())
        p = paths(field, [field.emission(w) for w in words]) if words else np.zeros(0)
        top = sorted([*p, 0, 0, 0], reverse=True)[:3]
        summary = [*(np.log(x + 0.01) for x in top), np.log(sum(p) + 0.01), np.log(1 + sum(x >= 0.5 for x in p))]
        means, deviations, w = field.document
        z = w[0] + sum(v * (x - m) / d for v, x, m, d in zip(w[1:], summary, means, deviations))
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-5)
        assert len(r.spans) == (p >= 0.5).sum()


def test_without_toxic_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(k, "foo bar") for k in range(30)], "doc_id long, text string")
    got = toxicity.report(docs, spark.createDataFrame([(k, 0) for k in range(30)], "doc_id long, toxic int")).collect()
    assert {(r.score, r.predicted, r.n_spans) for r in got} == {(0.0, 0, 0)}


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(k, "x" * (k * 10), k % 2) for k in range(20)]
    got = folds.bounded(spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3), 500).collect()
    assert 0 < sum(len(r.text) for r in got) <= 500 and {tuple(r) for r in got} <= set(rows)
    assert len(folds.bounded(spark.createDataFrame(rows, "doc_id long, text string, y int"), 1 << 20).collect()) == 20


# Token files


def test_codes_of_very_many_ids():
    rng = np.random.default_rng(1)
    lengths = huffman.code_lengths(rng.integers(1, 50, 70_000))
    assert 17 <= lengths.max() <= 18 and sum(2.0 ** -lengths.astype(float)) == 1
    ids = rng.integers(0, 70_000, 3000)
    codes, sizes, marks = huffman.encode(ids, np.array([1000, 2000]), lengths, huffman.canonical_codes(lengths))
    cuts = np.cumsum(sizes)[:-1].tolist()
    docs = [(k, n, c, m.tobytes()) for k, (n, c, m) in enumerate(zip((1000, 2000), (codes[: cuts[0]], codes[cuts[0] :]), marks))]
    got = dict(huffman.decode_block(huffman.pack_block(docs), huffman.decode_table(lengths)))
    assert (np.concatenate([got[0], got[1]]) == ids).all()


# Packing


def fewest(lengths, size):
    """Exact, for some pieces: bins are filled one by one around the largest piece left."""
    best = {}

    def go(left):
        if not left:
            return 0
        if left not in best:
            top, rest = left[-1], left[:-1]
            found = len(left)
            for n in range(len(rest) + 1):
                for own in {tuple(sorted(c)) for c in itertools.combinations(rest, n) if sum(c) + top <= size}:
                    after = list(rest)
                    for x in own:
                        after.remove(x)
                    found = min(found, 1 + go(tuple(after)))
            best[left] = found
        return best[left]

    return go(tuple(sorted(lengths)))


@pytest.mark.parametrize("seed", range(8))
def test_fewest_sequences_of_more_pieces(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(12, 60, 12).tolist()
    patterns = packing.bin_completion(Counter(lengths), 100)
    assert sum(n for _, n in patterns) == fewest(lengths, 100) <= sum(n for _, n in packing.best_fit(Counter(lengths), 100))


def test_smaller_pieces_than_four_to_a_sequence():
    lengths = [30, 28, 27, 26, 22, 21, 20, 19, 18, 17, 16, 15, 14, 13, 7, 7]  # 300 in all
    assert sum(n for _, n in packing.bin_completion(Counter(lengths), 100)) == 3



def test_sequences_of_many_documents_beat_best_fit():
    counts = dict.fromkeys(range(300, 401), 20)
    patterns = packing.bin_completion(counts, 2048, max_nodes=2000)
    assert sum(n for _, n in patterns) < sum(n for _, n in packing.best_fit(counts, 2048)) == 371


def test_fillings_of_any_number():
    assert next(packing.fillings([10, 11], {10: 5, 11: 5}, 53, 5)) == (11, 11, 11, 10, 10)
    assert next(packing.fillings([10, 50], {10: 5, 50: 1}, 50, 0)) == (50,)


# The pipeline


def tables_of(spark, folder, documents, labels, benchmark):
    for name, rows, schema in (("documents", *documents), ("labels", *labels), ("benchmark", *benchmark)):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, component string, spans string, score double, _row long, piece int"
LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


def test_pipeline_on_odd_rows(spark, tmp_path):
    from test_llm_pairs import EDGE, brute_components, brute_dedup, brute_report, near_copies

    own = ["d", "c", "s", 0.5, 7, 3]
    item = "the quick brown fox jumps over the lazy dog and runs far away from here"
    texts = [*EDGE, (8, EDGE[7][1]), (9, "aa bb"), *((50 + i, t) for i, t in near_copies(4, 80)), (400, f"well {item} indeed"), (401, None)]
    rows = [(i, t, "en", None, None, *own) for i, t in texts]
    marks = [(i, k % 2, None) for k, (i, _) in enumerate(texts)] + [(999, 1, 0), (None, 1, 1)]
    folder = tables_of(spark, tmp_path, (rows, COLUMNS), (marks, LABELS), ([(1, item), (2, None), (3, "")], ITEMS))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.dtypes, [(r.doc_id, r.text) for r in docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        if k == 1:
            expected = sorted(((i, h) for i, _, _, stays, h in brute_dedup(kept) if stays), key=str)
        elif k == 2:
            groups = brute_components([(i, t) for i, t in kept if i is not None])
            expected = sorted((i for i, _ in kept if i is None or groups[i][1] == i), key=str)
        elif k == 3:
            bad = {i for i, r in brute_report([(i, t) for i, t in kept if i is not None], [(1, item), (2, None), (3, "")]).items() if r[4]}
            expected = sorted((i for i, _ in kept if i not in bad), key=str)
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.dtypes == columns and {tuple(r)[5:] for r in docs.collect()} <= {tuple(own)}
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        if k == 1:
            assert sorted(((i, hashlib.sha256(exact_lower(t)).hexdigest()) for i, t in kept), key=str) == sorted(set(expected), key=str)
        elif k > 1:
            assert sorted((i for i, _ in kept), key=str) == expected
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in kept}


def exact_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def test_pipeline_of_nothing(spark, tmp_path):
    folder = tables_of(spark, tmp_path, ([], COLUMNS), ([], LABELS), ([], ITEMS))
    assert corpus_pipeline.run(spark, folder).count() == 0
