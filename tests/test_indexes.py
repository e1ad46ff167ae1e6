"""Edit-distance joins, parents and sums across ranges, intervals of trees, expressions by their literal factors."""

import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantmill.operators import concordance, entities, hierarchy, qgrams, relational

# Names within an edit distance


def distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def names_of(seed, n):
    rng = random.Random(seed)
    out = ["", "a", "ab", "ba", "aaaaaaaaaa", "aaaaaaaaa", "aaaaaaaa", "straße", "strase", "\u0001", "😀x", "x😀", None, "dup", "dup"]
    while len(out) < n:
        base = rng.choice(out[:9] + ["grant mill company", "grand mills company", "abcabcabc"])
        chars = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", "c", "", " ", "ß"])
        out.append("".join(chars))
    return out


@pytest.mark.parametrize(("k", "q"), [(1, 3), (2, 2), (3, 3)])
def test_all_pairs_within_a_distance(spark, k, q):
    names = names_of(k, 150)
    df = spark.createDataFrame([(x,) for x in names], "name string").repartition(3)
    got = sorted(map(tuple, qgrams.edit_join(df, "name", k, q=q).collect()))
    known = sorted({x for x in names if x is not None})
    assert got == sorted((a, b, distance(a, b)) for a in known for b in known if a < b and distance(a, b) <= k)


def test_pairs_of_two_tables(spark):
    one, two = names_of(7, 60), names_of(8, 70)
    left, right = (spark.createDataFrame([(x,) for x in n], "name string") for n in (one, two))
    got = sorted(map(tuple, qgrams.edit_join(left, "name", 2, right).collect()))
    assert got == sorted((a, b, distance(a, b)) for a in {*one} - {None} for b in {*two} - {None} if distance(a, b) <= 2)
    assert qgrams.edit_join(left, "name", 2, right.limit(0)).collect() == [] and qgrams.edit_join(left.limit(0), "name", 1).collect() == []


def test_the_join_has_no_nested_loop(spark):
    df = spark.createDataFrame([(x,) for x in names_of(3, 40)], "name string")
    plan = qgrams.edit_join(df, "name", 1)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("k", [1, 2, 3])
def test_numbered_names_meet_no_more_often_than_they_are_near(spark, k):
    """Every gram of numbered names is frequent, so what is shuffled must not grow with their square."""
    moved = []
    for n in (300, 1200):
        one = [f"Customer#{i:09d}" if k == 1 else f"machinery {i}" for i in range(n)]
        two = None if k == 1 else [f"machine {i}" for i in range(n // 3)]
        left, right = (None if x is None else spark.createDataFrame([(v,) for v in x], "name string") for x in (one, two))
        before = shuffled(spark)
        got = sorted(map(tuple, qgrams.edit_join(left, "name", k, right).collect()))
        moved.append(shuffled(spark) - before)
        if n == 300:
            pairs = [(a, b) for a in one for b in one if a < b] if two is None else [(a, b) for a in one for b in two]
            assert got == sorted((a, b, d) for a, b in pairs if abs(len(a) - len(b)) <= k and (d := distance(a, b)) <= k)
    assert moved[1] < 7 * moved[0]


def test_long_names_with_one_edit(spark, monkeypatch):
    monkeypatch.setattr(qgrams, "LONG", 6)
    names = sorted({x for x in names_of(5, 120) if x is not None})
    df = spark.createDataFrame([(x,) for x in names], "name string")
    assert sorted(map(tuple, qgrams.edit_join(df, "name", 1).collect())) == sorted((a, b, 1) for a in names for b in names if a < b and distance(a, b) == 1)


@pytest.mark.parametrize(("k", "two"), [(2, False), (3, True)])
def test_names_joined_by_their_heads(spark, monkeypatch, k, two):
    monkeypatch.setattr(qgrams, "MEETS", 0)
    monkeypatch.setattr(qgrams, "SHARED", 0)
    rng = random.Random(k)
    names = [[*{"", "7", "12", *("".join(rng.choice(["ab", "ba", "b", ""])) + "".join(rng.choice("12a") for _ in range(rng.randint(0, 5))) for _ in range(60))}] for _ in range(2)]
    left, right = (spark.createDataFrame([(x,) for x in n], "name string") for n in names)
    got = sorted(map(tuple, qgrams.edit_join(left, "name", k, right if two else None).collect()))
    others = names[1] if two else names[0]
    assert got == sorted((a, b, distance(a, b)) for a in names[0] for b in others if (two or a < b) and distance(a, b) <= k)


# Parents


def plain_parents(rows):
    out = {}
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=lambda r: r[1])
        for k, (_, seq, level, _) in enumerate(own):
            above = [r for r in own[:k] if level is not None and r[2] is not None and r[2] < level]
            out[group, seq] = above[-1][3] if above else None
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("deep", [2, 6, 60])
def test_parents_across_ranges(spark, parts, deep):
    rng = random.Random(parts * deep)
    rows = [(g, s, None if rng.random() < 0.05 else rng.randint(0, deep), f"{g}{s}") for g, n in (("a", 90), ("b", 3), (None, 12), ("c", 25)) for s in rng.sample(range(1000), n)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, "kept") for r in rows], "cat_id string, seq long, level int, code string, x string")
        found = hierarchy.with_parent(df)
        assert found.columns == ["cat_id", "seq", "level", "code", "x", "parent_code"]
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows) and {(r.cat_id, r.seq): r.parent_code for r in got} == plain_parents(rows)
    assert hierarchy.with_parent(df.limit(0)).collect() == []


@pytest.mark.parametrize("reverse", [False, True])
def test_rows_of_one_place_are_no_parents_of_each_other(spark, reverse):
    rows = [("a", 1, 0, "r"), ("a", 2, 1, "x"), ("a", 2, 2, "y"), ("a", 2, 2, "z"), ("a", 3, 3, "w"), ("a", 3, None, "n"), ("a", 4, 1, "v")]
    df = spark.createDataFrame(rows[::-1] if reverse else rows, "cat_id string, seq long, level int, code string").coalesce(1)
    got = {r.code: r.parent_code for r in hierarchy.with_parent(df).collect()}
    assert got == {"r": None, "x": "r", "y": "r", "z": "r", "w": "x", "n": None, "v": "r"}


def test_running_sums_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), k, rng.randint(1, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {r.o: r.s for r in relational.running_sum(df, ["k"], ["o"], "v", "s").collect()}
    assert got == {o: sum(v2 for k2, o2, v2 in rows if k2 == k and o2 < o) for k, o, _ in rows}


# Intervals


def plain_intervals(nodes):
    """{(group, code): (depth, first, last)} by a walk."""
    below, out = {}, {}
    for g, c, p in nodes:
        below.setdefault((g, p), []).append(c)
    for g in {n[0] for n in nodes}:
        at = 0
        stack = [(c, 0) for c in sorted(below.get((g, None), []), reverse=True)]
        open_ = []
        while stack:
            c, depth = stack.pop()
            while open_ and open_[-1][1] >= depth:
                done = open_.pop()
                out[g, done[0]] = (*out[g, done[0]], at - 1)
            out[g, c] = (depth, at)
            at += 1
            open_.append((c, depth))
            stack += [(x, depth + 1) for x in sorted(below.get((g, c), []), reverse=True)]
        for c, _ in open_:
            out[g, c] = (*out[g, c], at - 1)
    return out


def test_intervals_of_trees(spark):
    rng = random.Random(5)
    nodes = [("t", "n000", None), ("t", "n001", None), ("solo", "n000", None)]
    for k in range(2, 120):
        nodes.append(("t", f"n{k:03}", f"n{rng.choice([0, k - 1, rng.randrange(k)]):03}"))
    nodes += [("chain", f"c{k:02}", f"c{k - 1:02}" if k else None) for k in range(33)]
    odd = [("t", "lost", "nowhere"), ("t", "lost2", "lost"), ("ring", "a", "b"), ("ring", "b", "a"), ("ring", "tail", "a"), ("ring", "ok", None), ("ring", "self", "self")]
    df = spark.createDataFrame([*nodes, *odd], "cat_id string, code string, parent_code string").repartition(4)
    tree = hierarchy.intervals(df)
    got = {(r.cat_id, r.code): (r.depth, r.first, r.last) for r in tree.collect()}
    want = plain_intervals([*nodes, ("ring", "ok", None)])
    assert got == want
    tops = spark.createDataFrame([(g, c) for g, c, _ in nodes[::7]] + [("t", "none"), ("ring", "a")], "cat_id string, code string")
    pairs = sorted(map(tuple, hierarchy.below(tree, tops).collect()))
    assert pairs == sorted((g, c, d) for g, c, _ in nodes[::7] for (h, d), x in want.items() if h == g and want[g, c][1] <= x[1] <= want[g, c][2])
    assert hierarchy.intervals(df.limit(0)).collect() == [] and hierarchy.below(tree, tops.limit(0)).collect() == []


# Expressions

EXPRESSIONS = ["010/1", "01[0-9]/2", "a.*bcd", "ab?c", "ab+c", "x{0,2}yz", "(ab)c", "a|b", "", ".*", "^01.$", r"a\.b", r"\d+/5", "a\\", "[]a]b", "[^a", r"\Qa.b\E", "ab*", "/", "0", "[a[b]]c"]


@pytest.mark.parametrize(("expression", "factor"), [("010/1", "010/1"), ("01[0-9]/2", "01"), ("a.*bcd", "bcd"), ("ab?cd", "cd"), ("abc+d", "abc"), ("x{0,2}yz", "yz"), ("(ab)c", ""), ("a|b", ""), (r"a\.b", "a.b"), (r"12\d+/5", "12"), ("ab*", "a"), (None, "")])
def test_literal_factors(expression, factor):
    assert concordance.literal_factor(expression) == factor


@given(st.sampled_from(EXPRESSIONS), st.text("ab.c01/25xyz", max_size=9))
def test_a_match_holds_the_factor(expression, text):
    try:
        found = re.search(expression, text)
    except re.error:
        return
    if found and "\\Q" not in expression:
        assert concordance.literal_factor(expression) in text


def test_codes_meet_expressions_by_factors(spark):
    rng = random.Random(2)
    codes = ["", "0", "ab", *("".join(rng.choices("abc01/25", k=rng.randint(1, 8))) for _ in range(120))]
    good = [e for e in EXPRESSIONS if e not in ("a\\", "[^a", "[a[b]]c")]
    expressions = spark.createDataFrame([*enumerate(good), (99, "010/1"), (100, "not there")], "seq int, regex string")
    df = spark.createDataFrame([(c,) for c in {*codes}], "code string")
    plain = df.crossJoin(expressions).where(F.regexp_like("code", F.col("regex")))
    found = concordance.matching(df, expressions)
    assert sorted(map(tuple, found.select("code", "seq").collect())) == sorted(map(tuple, plain.select("code", "seq").collect()))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert concordance.matching(df, expressions.limit(0)).collect() == [] and concordance.matching(df.limit(0), expressions).collect() == []


# Similarity of names


def plain_similarity(a, b):
    """Without bounds: every ratio taken whole."""

    def ratio(p, q):
        p, q = sorted((p, q))
        return 100 * SequenceMatcher(None, p, q, autojunk=False).ratio() if p or q else 0.0

    short, long = sorted((a, b), key=lambda x: (len(x), x))
    partial = 0.0
    for i, j, _ in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks() if short else []:
        start = max(0, j - i)
        partial = max(partial, ratio(short, long[start : start + len(short)]))
    partial = 100.0 if partial > 99.5 else partial
    x, y = set(a.lower().split()), set(b.lower().split())
    tokens = 0.0
    if x and y:
        both = " ".join(sorted(x & y))
        one, two = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
        tokens = max(ratio(p, q) for p, q in [(one, two)] + ([(both, one), (both, two)] if both else []))
    s, t = (round(r) + 1e-9 for r in (tokens, partial))
    return 2 * s * t / (s + t)


@given(st.lists(st.sampled_from(["red", "blue", "Red", "ring", "rings", "bolt", "bo", " ", "a"]), max_size=5).map(" ".join), st.lists(st.sampled_from(["red", "blue", "ring", "ri", "bolt", "a", "xyz"]), max_size=5).map(" ".join))
def test_similarity_with_bounds_is_that_without(a, b):
    assert entities.similarity(a, b) == plain_similarity(a, b)


def test_similarities_of_all_parts(spark):
    names = ["small ring", "red widget", "blue bolt", "red ring", "ring small", "", "x"]
    got = entities.pair_similarity(spark.createDataFrame([(n,) for n in [*names, None, "x"]], "n string"), "n").collect()
    assert {(r.a, r.b): r.sim for r in got} == {(a, b): plain_similarity(a, b) for a in names for b in names if a < b}


def test_leaves_stay_out_of_the_rounds(spark, monkeypatch):
    held, plain = [], hierarchy.stored

    def counting(df, name):
        out = plain(df, name)
        held.append((name, out.count()))
        return out

    monkeypatch.setattr(hierarchy, "stored", counting)
    nodes = [("r", None), ("x", "r"), ("y", "x"), ("alone", None), ("lost", "nowhere"), *((f"l{k}", "rxy"[k % 3]) for k in range(50))]
    got = hierarchy.intervals(spark.createDataFrame([("g", *n) for n in nodes], "cat_id string, code string, parent_code string")).collect()
    assert len(got) == 54 and {(r.cat_id, r.code): (r.depth, r.first, r.last) for r in got} == plain_intervals([("g", *n) for n in nodes])
    assert max(n for name, n in held if name in ("jump", "places")) <= 4


def test_names_one_edit_apart_have_no_candidates(spark, monkeypatch):
    """What signatures join is the result: nothing longer than the names is written on the way."""
    held, plain = [], qgrams.stored

    def counting(df, name):
        out = plain(df, name)
        held.append(out.count())
        return out

    monkeypatch.setattr(qgrams, "stored", counting)
    names = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(100)], "name string")
    assert qgrams.edit_join(names, "name", 1).count() == 900 and max(held) == 100
