"""Source audit, fill-in-middle and personal data: brute force, round trips, edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantmill.llm import fill_in_middle, personal_data, source_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Source divergence audit


def plain_audit(rows, least=10, top=10):
    """Everything by loops over dictionaries."""
    counts, holding, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        holding.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in holding.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        of = {s: counts[lang, s] for s in sources}
        of[None] = sum(of.values(), Counter())
        total = {s: sum(c[w] for w in kept) for s, c in of.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (total[s] + 2 * len(kept)) for w in kept} for s, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(f(p[s][w], p[None][w]), w) for w in kept if of[s][w] > 0 and p[s][w] > p[None][w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


def audited(spark, rows, least=10, top=10):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("term", "n", "place", "counts", "p", "rank")})
    return sorted(map(tuple, source_audit.report(df, least, top).collect()))


def test_audit_equals_loops(spark):
    import random

    rng = random.Random(4)
    words = ["Der", "der", "É", "é", "naïve", "a1b", "中文", "x", "Ｘ", "zz-top", "😀", "", "A_b"]
    rows = []
    for k in range(160):
        text = None if k % 23 == 0 else " ".join(rng.choices(words, [k % 7 + 1, 3, 2, 2, 1, 2, 1, 5, 1, 1, 1, 1, 1], k=rng.randint(0, 30)))
        rows.append((k, text, rng.choice(["en", "fr", None, "", "solo"]), rng.choice(["a", "b", "ß", None, "c"]) if k % 3 else "hot", 0))
    rows += [*rows[:10], (1, "alone", "xx", "one", 0), (2, None, "yy", "p", 0), (2, "few", "yy", "q", 0)]
    for least, top in ((10, 10), (1, 2)):
        assert audited(spark, rows, least, top) == plain_audit(rows, least, top)


def test_audit_of_odd_tables(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(1, None, None, None, None)]) == []
    assert audited(spark, [(1, "a", "l", "s", 0), (1, "b", "l", "t", 0)]) == [("l", "s", "pair", "t", 0, 1), ("l", "t", "pair", "s", 0, 1)]
    long = " ".join(f"w{chr(97 + k % 26)}" for k in range(200_000))
    rows = [(k, long if k == 0 else "wa wb", "l", "st"[k % 2], 0) for k in range(20)]
    assert audited(spark, rows) == plain_audit(rows)


def test_probabilities_of_great_counts_are_exact(spark):
    n = [0, 1, 10**9, 4 * 10**12, 3 * 10**15]
    rows = [(c, t, v) for c in n for t in n if t >= c for v in (1, 7, 10**6)]
    df = spark.createDataFrame(rows, "c long, t long, v long")
    got = df.select("c", "t", "v", source_audit.probability(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.t + 2 * r.v) for r in got)


# Fill in middle


def plain_middle(doc_id, text):
    text = text or ""
    n = len(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


ODD = ["", None, "a", "é", "😀", "a\0b\0", "<", "<P", "P>", "<<S", "S>M>", "x<P>y", "<M>", "\n\r\n", "é‍😀‮", "'; DROP TABLE batch; --", "%s {0}", "中" * 3000, "ab " * 60_000]


@pytest.fixture
def odd_rows():
    rows = [(k * 31 + j, t) for k in range(12) for j, t in enumerate(ODD)]
    return [*rows, *rows[:5], (None, "no id"), (-3, "below zero")]


def test_middles_equal_a_plain_version(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumns({"n": F.lit("old"), "row": F.lit(1), "batch": F.lit(2), "points": F.col("doc_id")}).repartition(3)
    got = fill_in_middle.transform(df)
    assert got.columns == ["doc_id", "text", "row", "batch", "points", "n", "form", "prefix_chars", "middle_chars", "fim_text"]
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(tuple(r[5:]) == plain_middle(r.doc_id, r.text) for r in rows)
    assert {"psm", "spm", "plain"} == {r.form for r in rows}
    assert fill_in_middle.restore(got).where(~F.col("restored").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


def test_middle_report(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string")
    want = sorted((str(k), *p[:4], sha(p[4]), sha(t or "")) for k, t in odd_rows for p in [plain_middle(k, t)])
    assert sorted((str(r[0]), *r[1:]) for r in fill_in_middle.report(df).collect()) == want
    assert fill_in_middle.report(df.limit(0)).collect() == []


def test_slices_are_bounded():
    import pyarrow as pa

    text = pa.array(["x" * n for n in (0, fill_in_middle.SLICE_BYTES + 5, 1, 1, fill_in_middle.SLICE_BYTES, *[0] * 5000)])
    cuts = [*fill_in_middle._slices(text)]
    assert [a for a, _ in cuts] == [sum(n for _, n in cuts[:k]) for k in range(len(cuts))] and sum(n for _, n in cuts) == len(text)
    assert all(n == 1 or n <= fill_in_middle.SLICE_ROWS and sum(len(x) for x in text.slice(a, n).to_pylist()) <= fill_in_middle.SLICE_BYTES for a, n in cuts)


# Personal data


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(personal_data.BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "phone": 10 <= len(digits) <= 15,
                "card": 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
            }
            if good[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


PIECES = ["a", "@", "b.c", ".", " ", "-", "+", "1", "22", "255", "256", "0", "4111 1111 1111 1111", "49", "(0)", "é", "😀", "\n", "_", "%", "://", "tel:", "IBAN ", "DE89370400440532013000", "account: ", "user:pw@", "1.2.3.4", "..", "x@y.z", '"', "9" * 25]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_base_spans_are_what_the_expressions_match(text):
    found = personal_data.spans(text)
    assert [s[:3] for s in found if s[3]] == plain_base(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in found) and len({s[:3] for s in found}) == len(found)


@pytest.mark.parametrize(
    ("text", "kind", "hit"),
    [
        ("an jörg@exämple.de.", "email", "jörg@exämple.de"),
        ('to "john doe"@example.com', "email", '"john doe"@example.com'),
        ("ftp://ann:secret@host.example:21/a b", "url", "ftp://ann:secret@host.example:21/a"),
        ("see http://[2001:db8::1]/x", "ip", "2001:db8::1"),
        ("tel:030-1234567.", "phone", "030-1234567"),
        ("IBAN: DE89 3704 0044 0532 0130 00 OK", "account", "DE89 3704 0044 0532 0130 00"),
        ("Account no. 12345678.", "account", "12345678"),
        ("Reisepass Nr. C01234567", "account", "C01234567"),
    ],
)
def test_added_spans(text, kind, hit):
    assert (kind, text.index(hit), text.index(hit) + len(hit), False) in personal_data.spans(text)


@pytest.mark.parametrize("text", ["http://example.org/x?y=1", "the account was 3 pages", "accounts 12345678", "IBAN DE00 3704 0044 0532 0130 00", "a@b", "http://[::zz]/", "tel:12", "@", '"" @x.y', "myssn 123456789x"])
def test_what_is_no_personal_data(text):
    assert [s for s in personal_data.spans(text) if not s[3]] == []


def test_personal_data_tables(spark):
    texts = ["mail a.b@c.de and a.b@c.de, +49 (30) 1234-5678", None, "", "10.0.0.256 10.0.0.1", "😀 4111-1111-1111-1111", "x" * 300_000 + " z@y.xx", "@" * 20_000, "1." * 20_000, "+1(" * 20_000]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumns({"spans": F.lit("old"), "kind": F.lit("k"), "start": F.lit(1)})
    got = {r.doc_id: r for r in personal_data.report(df).collect()}
    assert personal_data.report(df).count() == len(texts) + 1
    for k, t in enumerate(texts):
        base = plain_base(t or "")
        assert [got[k][f"n_{kind}"] for kind in personal_data.BASE] == [sum(s[0] == kind for s in base) for kind in personal_data.BASE]
        assert got[k].base_sha256 == sha(",".join(f"{kind}:{a}:{b}" for kind, a, b in base))
    masked = {r.doc_id: r.redacted for r in personal_data.redact(df).collect()}
    assert masked[0] == "mail [EMAIL] and [EMAIL], [PHONE]" and masked[1] is None and masked[2] == "" and masked[3] == "10.0.0.256 [IP]"
    assert personal_data.redact(df).columns == ["doc_id", "text", "kind", "start", "spans", "redacted"]
    assert personal_data.report(df.limit(0)).collect() == []


def test_spans_that_overlap_are_masked_once():
    text = "http://u:p@host.org/x y"
    assert personal_data.mask(text, personal_data.spans(text)) == "[URL] y"


# Stores that are resharded


def test_a_store_s_own_columns_are_its_own(spark):
    from grantmill.llm import resharding

    rows = [(k, f"text {k}" * (k % 9), f"s{k % 3}", 7, 8, 9, 10) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, slot int, store_row int, old_shard int")
    got = resharding.report(df).collect()
    assert sorted(r.doc_id for r in got) == [*range(300)] and {r.shard for r in got} == {*range(16)}
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= max(r.size for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == [*range(sum(r.shard == s for r in got))] for s in range(16))
    assert resharding.report(df.limit(0)).collect() == []


def test_a_store_that_can_t_be_rewritten_stays_as_it_was(spark, monkeypatch):
    from grantmill.llm import resharding
    from grantmill.sources.yearlog import YearLog

    logs, placed_rows = [], resharding._placed_rows

    class Kept(YearLog):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            logs.append(self)

    def broken(*args):
        return placed_rows(*args).withColumn("text", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("disk is full"))).otherwise(F.col("text")))

    monkeypatch.setattr(resharding, "YearLog", Kept)
    monkeypatch.setattr(resharding, "_placed_rows", broken)
    df = spark.createDataFrame([(k, f"text {k}", f"s{k % 3}") for k in range(60)], "doc_id long, text string, source string")
    with pytest.raises(Exception, match="disk is full"):
        resharding.report(df)
    held = logs[0].read().collect()
    assert sorted(r.doc_id for r in held) == [*range(60)] and all(r.shard == r.old_shard for r in held)
