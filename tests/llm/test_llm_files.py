"""Resharding, token files, packing, pages and tool calls: round trips, brute force, edge cases."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantmill.llm import html_text, huffman, packing, places, resharding, tokens, tool_calls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, "Hello, World!", " two  blanks ", "line\nline\n\nend\n", "é İ ß 中文 ﬁ", "a\0b \0c", "x" * 5000, "word " * 9000, "<|endoftext|> and <|startoftext|>", "the&&& end*** I'm.", "  odd   white"]


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, 0) for k, t in enumerate(texts)], DOCS)


# Tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(tokens.vocabulary(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


PIECES = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　", "é", "́", "İ", "Σ", "'s", "I'm", "1", "23", "!!", "...", "<|endoftext|>", "中文", "🙂", "\x0b", "\x1c", "\x85", "ﬁ", "the", "ing", ",", "\0"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_ids_are_the_library_s(library, text):
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        got = tokens.encoder(tokens.vocabulary(name), spaced).encode(text)
        assert np.frombuffer(got, "<u4").tolist() == library[name].encode(text, add_special_tokens=False).ids


# Huffman files


@pytest.mark.parametrize("counts", [[0, 5], [0], [], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89], [10**6, *[1] * 300], [7] * 64])
@pytest.mark.parametrize("limit", [9, 16])
def test_code_lengths(counts, limit):
    lengths = huffman.code_lengths(np.array(counts, np.int64), limit).astype(int)
    used = [n for n in lengths if n]
    assert len(used) == sum(c > 0 for c in counts) and max(used, default=0) <= limit
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1  # complete
    words = {format(int(c), f"0{n}b") for c, n in zip(huffman.canonical_codes(lengths), lengths) if n}
    assert len(words) == len(used) and not any(a != b and b.startswith(a) for a in words for b in words)


def test_code_is_optimal_where_the_limit_is_slack():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 60)
    heap = [(int(c), k, [k]) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1] + 100, a[2] + b[2]))
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost


def test_block_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.3, n) % 5000 for n in (1, 255, 256, 257, 3000, 1)]
    ids = np.concatenate(docs).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    raw, sizes, marks = huffman.encode(ids, np.array([*map(len, docs)]), lengths, huffman.canonical_codes(lengths))
    ends = np.cumsum(sizes)
    block = huffman.pack_block([(None if k == 2 else k - 5, len(d), raw[e - s : e], m.tobytes()) for k, (d, s, e, m) in enumerate(zip(docs, sizes, ends, marks))])
    got = [*huffman.decode_block(block, huffman.decode_table(lengths))]
    assert [g[0] for g in got] == [-5, -4, None, -2, -1, 0]
    assert all((g[1] == d).all() for g, d in zip(got, docs))
    with pytest.raises(ValueError):
        [*huffman.decode_block(b"nope" + block[4:], huffman.decode_table(lengths))]


def test_token_file(spark, library):
    docs = documents(spark, TEXTS).unionByName(documents(spark, ["tie", "TIE tie"])).withColumn("start", F.lit(9)).repartition(5)
    at, expected = 0, []
    ordered = sorted(((k, t) for k, t in [*enumerate(TEXTS), (0, "tie"), (1, "TIE tie")]), key=lambda x: x[0])
    for k, t in ordered:
        ids = np.array(library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        expected.append((k, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = huffman.report(docs).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(expected)
    assert [r.doc_id for r in got] == [k for k, _ in ordered]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() and sum(r.n_tokens for r in got) == at
    assert huffman.report(documents(spark, [])).count() == 0


# Packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=12))
def test_bins_hold_all_and_no_more(counts):
    patterns = packing.bin_completion(counts, 100, max_nodes=500)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 100 and n > 0
        for x in pattern:
            used[x] += n
    assert used == Counter(counts)
    assert sum(n for _, n in patterns) <= sum(n for _, n in packing.best_fit(counts, 100))


def fewest(lengths, size):
    """Exact, for a few pieces."""
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size:
                go(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        go(k + 1, bins + [lengths[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_few_bins_on_small_cases(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(15, 70) for _ in range(9)), reverse=True)
    assert sum(n for _, n in packing.bin_completion(Counter(lengths), 100)) == fewest(lengths, 100)


def test_bin_completion_beats_best_fit():
    counts = {51: 1, 27: 2, 26: 1, 23: 2, 24: 1, 25: 1, 22: 1, 52: 1}
    assert sum(n for _, n in packing.bin_completion(counts, 100)) == 3


def test_pieces_and_places(spark, library):
    docs = documents(spark, [*TEXTS, "word " * 2047, "word " * 2048, "tie", "tie"]).withColumn("length", F.lit("x")).repartition(3)
    got = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in docs.collect():
        ids = library["byte_bpe_50k.json"].encode(r.text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in own] == [*range(len(own))] and all(p.length == 2048 for p in own[1:])
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == ids
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) <= 2048
    packed = packing.pack(docs, with_ids=True)
    assert packing.sequences(packed).agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * sum(p.length for p in got)
    assert packing.pack(documents(spark, [])).count() == 0


# Places and shards


def test_positions(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randint(0, 9)) for i in range(500)] + [("a", 7, 3)] * 4
    spark.createDataFrame(rows, "g string, i int, w int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for weight in (None, "w"):
        for g in (None, "a", "b"):
            got = sorted(((r.position, 1 if weight is None else r.w) for r in places.positions(df, "g", ["i", "w"], weight).collect() if r.g == g))
            assert len(got) == sum(x[0] == g for x in rows)
            at = 0
            for position, w in sorted(got, key=lambda x: (x[0], x[1] > 0)):
                assert position == at
                at += w


def test_positions_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(places, "BLOCK_ROWS", 8)
    spark.range(1000).withColumn("g", F.col("id") % 3).write.parquet(str(tmp_path / "t"))
    got = places.positions(spark.read.parquet(str(tmp_path / "t")), "g", ["id"]).groupBy("g").agg(F.sort_array(F.collect_list("position")).alias("p")).collect()
    assert all(r.p == [*range(len(r.p))] for r in got) and len(got) == 3


def test_cheapest_flow():
    rng = random.Random(5)
    for _ in range(20):
        supply = {o: rng.randint(0, 50) for o in range(5)}
        demand = {s: 0 for s in range(7)}
        for _ in range(sum(supply.values())):
            demand[rng.randrange(7)] += 1
        flow = resharding.cheapest_flow(supply, demand)
        assert all(sum(n for (o, _), n in flow.items() if o == k) == supply[k] for k in supply)
        assert all(sum(n for (_, s), n in flow.items() if s == k) == demand[k] for k in demand)
        assert sum(n for (o, s), n in flow.items() if o != s) == sum(max(0, n - demand.get(o, 0)) for o, n in supply.items())  # the least that must move


def test_reshard(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.choice([0, 3, 40, 400]), "en", rng.choice([None, "hot", "hot", "hot", f"s{i % 9}"]), 0) for i in range(600)] + [(600, None, None, "hot", None)] * 3
    docs = spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit(-1), "size": F.lit("x")}).repartition(5)
    got = resharding.report(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    slots = {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) < 801  # less than the largest row
    assert all(sorted(s) == [*range(len(s))] for s in slots.values()) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    least = sum(max(0, n - sum(sizes.values()) / 16) for n in Counter({o: sum(r.size for r in got if r.old_shard == o) for o in range(16)}).values())
    assert sum(r.size for r in got if r.shard != r.old_shard) <= 1.05 * least + 16 * 801
    assert resharding.report(documents(spark, [])).count() == 0


def test_rewrite(spark, tmp_path):
    docs = documents(spark, [f"text {k}" * (k % 5) for k in range(200)])
    placed = resharding.reshard(docs, 4, old=(F.col("doc_id") % 3).cast("int")).cache()
    affected = resharding.rewrite(docs, placed, str(tmp_path / "out"))
    assert affected == [0, 1, 2, 3]
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 200 and {(r.doc_id, r.shard, r.slot) for r in written.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy!</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold<br>part.<p>Second &eacute;&#233;  text
here</p><aside>Aside</aside><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form><p>mail</p></form><div class="reader-comments"><p>me too</p></div></article><footer>&copy;</footer>"""


def test_article():
    assert html_text.extract(PAGE, None) == "Head & line\nFirst bold part.\nSecond éé text here\none\ntwo\nc1\nc2"
    assert html_text.extract(None, None) == html_text.extract("", None) == "" and html_text.extract("a <b", None) == "a <b"
    assert html_text.extract("<article>a < b <!-- x --> &amp;lt; <p>c</article>", None) == "a < b &lt;\nc"
    assert html_text.extract("<html><body><nav>n</nav></body></html>", None) == ""
    assert len(html_text.extract("<article>" + "<p>word</p>" * 20_000 + "</article>", None).split("\n")) == 20_000


def test_wrapper_tells_template_text():
    make = lambda k, extra="": f"<html><body><div><p>Welcome to us</p><div><p>Story {k} is long.</p>{extra}</div><p>All rights</p></div></body></html>"
    wrapper = html_text.infer([make(1), make(2, "<p>More.</p>"), make(3)])
    expression = html_text.as_expression(wrapper)
    assert "#TEXT" in expression and ")+" in expression and '"Welcome to us"' in expression
    assert html_text.extract(make(9, "<h3>New</h3>"), wrapper) == "Story 9 is long.\nNew"
    json.loads(json.dumps(wrapper))


def test_pages(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, "HTTP://A.example/y", PAGE), (3, None, PAGE), (4, "junk", None), (5, "http://b.example", ""), (1, "http://a.example/x", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "host": F.lit("h"), "n_chars": F.lit(0)})
    got = html_text.report(pages).collect()
    text = html_text.extract(PAGE, None)
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(1, text, len(text))] * 2 + [(2, text, len(text)), (3, text, len(text)), (4, "", 0), (5, "", 0)])
    assert html_text.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Tool calls


def test_canonical_and_schemas():
    assert tool_calls.canonical({"b": 1.0, "a": [1.5, None, True, float("nan")], "é": "x\n"}) == '{"a":[1.5,null,true,null],"b":1,"é":"x\\n"}'
    schema = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string", "minLength": 2, "pattern": "^a"}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "k": {"enum": ["x", 1]}, "l": {"type": "array", "items": {"type": "number"}, "uniqueItems": True}}, "additionalProperties": False}
    ok = lambda v: not tool_calls.violations(v, schema)
    assert ok({"q": "ab"}) and ok({"q": "ab", "n": 5, "k": 1, "l": [1, 2.5]})
    assert not any(map(ok, [{}, {"q": "a"}, {"q": "bb"}, {"q": "ab", "n": 6}, {"q": "ab", "n": True}, {"q": "ab", "k": 2}, {"q": "ab", "l": [1, 1]}, {"q": "ab", "z": 0}, [], None]))


def test_linking(spark):
    call = lambda *calls, **more: json.dumps({"tool_calls": list(calls), **more})
    rows = [
        (1, 0, "system", json.dumps({"content": "Hi", "tools": [{"name": "find", "parameters": {"type": "object", "required": ["q"]}}]})),
        (1, 1, "user", "{not json"),
        (1, 2, "assistant", call({"id": "b", "name": "find", "arguments": '{"q": 2.0}', "depends_on": ["a"]}, {"id": "a", "name": "find", "arguments": {"x": 1}}, content="Looking")),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": 2}})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": None})),
        (1, 5, "assistant", call({"id": "a", "name": "other"}, {"name": "find"}, "text", {"id": "c", "arguments": "{oops"})),
        (1, 6, "assistant", call({"id": "p", "depends_on": ["q"]}, {"id": "q", "depends_on": ["p"]})),
        (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": 1})),
        (None, 0, "user", None), (None, 1, "assistant", call({"id": "a"})), (3, None, None, ""), (3, None, None, ""),
    ]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("k")).repartition(3)
    got = tool_calls.ordered(tool_calls.link(conversations)).collect()
    of = {(r.conv_id, r.turn, r.item): r for r in got}
    assert len(got) == len(of) + 1  # the repeated row is two messages
    one, two = of[1, 2, 1], of[1, 2, 2]
    assert (one.call_id, one.depth, one.linked, one.valid, one.json) == ("b", 1, True, True, '{"arguments":{"q":2},"id":"b","name":"find","role":"assistant","turn":2}')
    assert (two.call_id, two.depth, two.linked, two.problem) == ("a", 0, False, "$.q: missing")
    order = [r.call_id for r in got if r.conv_id == 1 and r.turn in (2, 3) and r.call_id]
    assert order == ["a", "b", "b"] and of[1, 3, 0].linked and of[1, 3, 0].json == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"b","turn":3}'
    assert of[1, 4, 0].problem == of[2, 0, 0].problem == "no call"
    assert [of[1, 5, k].problem for k in (1, 2, 3, 4)] == ["id used before", "no id", "no object", "arguments are no JSON"]
    assert of[1, 6, 1].depth == of[1, 6, 2].depth == -1
    assert of[1, 1, 0].kind == "message" and json.loads(of[1, 1, 0].json)["content"] == "{not json" and json.loads(of[None, 0, 0].json)["content"] is None
    assert not of[None, 1, 1].linked
    assert tool_calls.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
