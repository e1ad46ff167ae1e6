"""Year logs, workbooks, CSV, crawls, nested records, keyword automata."""

import datetime
import decimal
import json
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grantmill.operators import automaton, nested, search
from grantmill.session import work_path
from grantmill.sources import tables, workbook, yearlog
from grantmill.sources.crawl import Crawl, page_links, resolved

# Years


@pytest.fixture
def log(spark):
    return yearlog.YearLog(spark, work_path(spark, "log"))


def years(spark, *rows):
    return spark.createDataFrame(rows, "year int, x string")


def held(df):
    return sorted((r.year if r.year is not None else -1, r.x) for r in df.collect())


def test_a_run_replaces_its_own_years_only(spark, log):
    assert log.manifest().version == -1
    log.write(years(spark, (2019, "a"), (2020, "b"), (None, "n"), (2019, "a")))
    log.write(years(spark, (2020, "c")))
    assert held(log.read()) == [(-1, "n"), (2019, "a"), (2019, "a"), (2020, "c")]
    assert held(log.read(2019, 2020)) == [(2019, "a")] * 2 and held(log.read(2020)) == [(2020, "c")]
    assert held(log.read(version=0)) == [(-1, "n"), (2019, "a"), (2019, "a"), (2020, "b")]
    assert log.versions() == [0, 1]
    with pytest.raises(KeyError):
        log.read(version=7)


def test_runs_that_fail_leave_nothing_visible(spark, log):
    log.write(years(spark, (2019, "a"), (2020, "b")))
    rows = spark.range(400).repartition(8, "id").select(F.lit(2020).alias("year"), F.when(F.col("id") == 399, F.raise_error(F.lit("broken")).cast("string")).otherwise("z").alias("x"))
    with pytest.raises(Exception, match="broken"):
        log.write(rows)
    assert held(log.read()) == [(2019, "a"), (2020, "b")] and log.versions() == [0]
    assert len(log.clean(older_than=-1)) <= 1
    assert held(log.read()) == [(2019, "a"), (2020, "b")]


def test_covered_years_without_rows_are_emptied(spark, log):
    log.write(years(spark, (2018, "a"), (2019, "b"), (2020, "c")))
    log.write(years(spark).where("x IS NOT NULL"))
    assert len(held(log.read())) == 3
    log.write(years(spark, (2019, "d")), covers=[2019, 2020])
    assert held(log.read()) == [(2018, "a"), (2019, "d")]


def test_a_writer_s_number_is_committed_once(spark, log):
    for x in ("a", "b"):
        log.write(years(spark, (2019, x)), writer=("job", 3))
    log.write(years(spark, (2020, "c")), writer=("job", 2))
    log.write(years(spark, (2021, "d")), writer=("other", 1))
    assert held(log.read()) == [(2019, "a"), (2021, "d")]


def test_of_two_commits_at_once_none_is_lost(spark, log):
    log.write(years(spark, (2018, "a")))
    taken = log._publish
    calls = []

    def late(manifest):
        if not calls:  # another run commits first
            calls.append(1)
            yearlog.YearLog(spark, log.path).write(years(spark, (2019, "other")))
        return taken(manifest)

    log._publish = late
    log.write(years(spark, (2020, "mine")))
    assert held(log.read()) == [(2018, "a"), (2019, "other"), (2020, "mine")] and log.versions() == [0, 1, 2]
    assert not taken(yearlog.Manifest(1))


def test_log_columns_and_leftovers(spark, log):
    with pytest.raises(ValueError):
        log.read()
    assert log.read(schema=StructType.fromDDL("year int, x string")).collect() == []
    log.write(years(spark, (2019, "a")))
    log.write(spark.createDataFrame([(2020, "b", 1.5)], "year int, x string, y double"))
    assert sorted((r.year, r.x, r.y) for r in log.read().collect()) == [(2019, "a", None), (2020, "b", 1.5)]
    log.write(spark.createDataFrame([(2019, "c", 2.5)], "year int, x string, y double"))
    assert log.clean() == [] and log.versions() == [2]
    assert len(log.clean(older_than=-1)) == 1
    assert held(log.read()) == [(2019, "c"), (2020, "b")]


def test_runs_that_add_and_compaction(spark, log):
    log.append(years(spark, (2019, "a"), (2020, "b")))
    log.append(years(spark, (2019, "c"), (None, "n")), writer=("w", 1))
    log.append(years(spark, (2019, "c"), (None, "n")), writer=("w", 1))
    assert held(log.read()) == [(-1, "n"), (2019, "a"), (2019, "c"), (2020, "b")]
    assert held(log.read(version=0)) == [(2019, "a"), (2020, "b")]
    now = log.compact()
    assert len(now.years["2019"]) == 1 and held(log.read()) == [(-1, "n"), (2019, "a"), (2019, "c"), (2020, "b")]
    assert log.compact() == now
    log.write(years(spark, (2019, "z")))
    assert held(log.read(2019, 2020)) == [(2019, "z")]
    assert len(log.clean(older_than=-1)) >= 1 and held(log.read()) == [(-1, "n"), (2019, "z"), (2020, "b")]


def test_compaction_gives_way_to_other_commits(spark, log):
    log.append(years(spark, (2019, "a"), (2020, "x")))
    log.append(years(spark, (2019, "b")))
    taken = log._files

    def late(df):
        found = taken(df)
        log._files = taken
        yearlog.YearLog(spark, log.path).append(years(spark, (2019, "c")))
        return found

    log._files = late
    with pytest.raises(yearlog.Conflict):
        log.compact()
    assert held(log.read()) == [(2019, "a"), (2019, "b"), (2019, "c"), (2020, "x")]

    log._files = late
    yearlog.YearLog(spark, log.path).compact()
    log.append(years(spark, (2020, "y")))  # meanwhile 2019 grows
    assert held(log.read(2020)) == [(2020, "x"), (2020, "y")]


def test_a_stream_is_added_once(spark, log, tmp_path):
    years(spark, (2019, "a"), (2020, "b")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("year int, x string").parquet(f"{tmp_path}/in")

    def run(sink, checkpoint):
        stream().writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    add = log.sink("events")

    def killed(rows, number):  # after the commit, before the stream knows of it
        add(rows, number)
        raise OSError("killed")

    with pytest.raises(Exception, match="killed"):
        run(killed, "checkpoint")
    run(add, "checkpoint")
    years(spark, (2020, "c")).write.mode("append").parquet(f"{tmp_path}/in")
    run(add, "checkpoint")
    assert held(log.read()) == [(2019, "a"), (2020, "b"), (2020, "c")]


def test_write_years_keeps_other_years(spark):
    path = work_path(spark, "years")
    tables.write_years(years(spark, (2019, "a"), (2020, "b")), path)
    tables.write_years(years(spark, (2020, "c")), path)
    assert held(tables.read_years(spark, path, 2000, 2100)) == [(2019, "a"), (2020, "c")]


# CSV


def test_surplus_fields_even_empty_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n3,4,\n5,6,7\n8\n,9\n"",""\n10,"a\nb, c"\n')
    (tmp_path / "~lock.csv").write_text("x,y\n99,99\n")
    schema = StructType.fromDDL("x INT, y STRING")
    want = [(1, "2"), (8, None), (None, "9"), (None, None), (10, "a\nb, c")]
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "a.csv"), schema).collect()), key=str) == sorted(want, key=str)
    assert sorted(r.y or "" for r in tables.read_csv(spark, str(tmp_path / "a.csv"), schema).select("y").collect()) == sorted(w[1] or "" for w in want)
    assert sorted(map(tuple, tables.read_matching(spark, str(tmp_path / "*.csv"), schema).collect()), key=str) == sorted([(*w, "a.csv") for w in want], key=str)


# Workbooks

TYPES = "i long, d double, s string, b boolean, day date, at timestamp, m decimal(12,3), n int"


def typed_rows():
    utc = datetime.timezone.utc
    at = datetime.datetime(1969, 7, 20, 20, 17, 40, 125000, utc)
    return [
        (1, 0.1, "plain", True, datetime.date(2020, 2, 29), at, decimal.Decimal("1.500"), 7),
        (-(2**62), 1e300, "a <b> & \"c\" 'd'\n\ttab\r\x01 _x0041_ é 😀  two", False, datetime.date(1901, 1, 1), at, decimal.Decimal("-123456789.125"), -1),
        (None, None, None, None, None, None, None, 0),
        (0, -0.0, "", None, None, None, decimal.Decimal("0.000"), None),
        (5, 123456.789, "x" * 40_000, True, datetime.date(9999, 12, 31), None, None, 2**31 - 1),
    ]


def test_workbook_round_trip(spark):
    path = f"{work_path(spark, 'book')}.xlsx"
    df = spark.createDataFrame(typed_rows(), TYPES)
    tables.write_workbook({"a": df.repartition(3), "b": spark.range(2), "empty": df.limit(0)}, path)
    key = lambda r: str(r.n)
    got = tables.read_workbook(spark, path, "a", df.schema, rows=2)
    assert sorted(got.collect(), key=key) == sorted(df.withColumn("s", F.col("s")).collect(), key=key)
    assert got.rdd.getNumPartitions() == 3
    assert tables.read_workbook(spark, path, "empty", df.schema).collect() == []
    assert [r.id for r in tables.read_workbook(spark, path, "b").orderBy("id").collect()] == ["0", "1"]
    with pytest.raises(Exception, match="no sheet"):
        tables.read_workbook(spark, path, "c", df.schema).collect()


def test_sheets_are_added_and_replaced(spark):
    path = f"{work_path(spark, 'book')}.xlsx"
    tables.write_workbook({"one": spark.range(3), "two": spark.createDataFrame(typed_rows(), TYPES)}, path)
    spark.range(5, 7).write.format("workbook").option("sheet", "one").mode("append").save(path)
    rows = tables.read_workbook(spark, path, "one", StructType.fromDDL("id long")).collect()
    assert sorted(r.id for r in rows) == [5, 6]
    two = tables.read_workbook(spark, path, "two", StructType.fromDDL(TYPES)).collect()
    assert sorted(two, key=lambda r: str(r.n)) == sorted(spark.createDataFrame(typed_rows(), TYPES).collect(), key=lambda r: str(r.n))


def test_a_write_that_fails_leaves_the_workbook_as_it_was(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    tables.write_workbook([spark.range(3)], path)
    with pytest.raises(Exception, match="broken"):
        tables.write_workbook([spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))], path)
    assert sorted(r.id for r in tables.read_workbook(spark, path, None, StructType.fromDDL("id long")).collect()) == [0, 1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]


def test_long_sheets_go_on_in_further_ones(tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "ROWS", 4)
    path = str(tmp_path / "book.xlsx")
    writer = workbook.WorkbookWriter(StructType.fromDDL("id long"), {"path": path, "sheet": "s"}, True)
    writer.commit([writer.write(iter([(k,) for k in range(8)]))])
    with workbook.Book(path) as book:
        assert [*book.sheets] == ["s", "s 2", "s 3"]
        assert [[book.cells(r)[0] for r in book.raw_rows(s)] for s in book.sheets] == [["id", 0, 1, 2], ["id", 3, 4, 5], ["id", 6, 7]]
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]


def foreign(path, prefix=""):
    """A workbook as other programs make them: shared strings, references, styles, gaps, formulas, prefixes."""
    p = f"{prefix}:" if prefix else ""
    ns = f'xmlns{":" + prefix if prefix else ""}="{workbook.NAMESPACE}"'
    cells = [
        f'<{p}row r="1"><{p}c r="A1" t="s"><{p}v>0</{p}v></{p}c><{p}c r="C1" t="s"><{p}v>1</{p}v></{p}c><{p}c r="D1" t="inlineStr"><{p}is><{p}r><{p}t>wh</{p}t></{p}r><{p}r><{p}t>en</{p}t></{p}r></{p}is></{p}c></{p}row>',
        f'<{p}row r="2" spans="1:4"><{p}c r="A2"><{p}v>1.50</{p}v></{p}c><{p}c r="B2"><{p}v>9</{p}v></{p}c><{p}c r="C2" t="str"><{p}f>A1</{p}f><{p}v>f</{p}v></{p}c><{p}c r="D2" s="1"><{p}v>43831</{p}v></{p}c></{p}row>',
        f'<{p}row r="3"/>',
        f'<{p}row r="5"><{p}c r="A5" t="e"><{p}v>#DIV/0!</{p}v></{p}c><{p}c r="C5" t="b"><{p}v>1</{p}v></{p}c><{p}c r="D5" s="2"><{p}v>43831.5</{p}v></{p}c><{p}c r="E5"><{p}v>4</{p}v></{p}c></{p}row>',
    ]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbook.NAMESPACE}" xmlns:r="{workbook.RELATIONS}"><sheets><sheet name="Q &amp; A" sheetId="9" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}"><Relationship Id="rId7" Target="/xl/worksheets/odd.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbook.NAMESPACE}"><si><t>num</t></si><si><r><t>te</t></r><r><t>xt</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{workbook.NAMESPACE}"><numFmts><numFmt numFmtId="170" formatCode="[Red]yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/odd.xml", f'<{p}worksheet {ns}><{p}cols/><{p}sheetData>{"".join(cells)}</{p}sheetData></{p}worksheet>')


@pytest.mark.parametrize("prefix", ["", "x"])
@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_foreign_workbooks(spark, tmp_path, monkeypatch, prefix, chunk):
    monkeypatch.setattr(workbook, "CHUNK", chunk)
    path = str(tmp_path / "f.xlsx")
    foreign(path, prefix)
    with workbook.Book(path) as book:
        assert [*book.sheets] == ["Q & A"]
        rows = [book.cells(r) for r in book.raw_rows("Q & A")]
    assert rows == [["num", None, "text", "when"], [1.5, 9, "f", datetime.datetime(2020, 1, 1)], [], [None, None, True, datetime.datetime(2020, 1, 1, 12), 4]]
    schema = StructType.fromDDL("when timestamp, num string, text string, missing int, file string")
    got = tables.read_workbook(spark, str(tmp_path / "*.xlsx"), "Q & A", schema, file="file").orderBy("when").collect()
    assert [(r.num, r.text, r.missing, r.file) for r in got] == [("1.50", "f", None, "f.xlsx"), (None, "true", None, "f.xlsx")]


# Crawls

GRAPH = {"a": ["b", "c", "a"], "b": ["d", "x"], "c": ["d", "e"], "d": ["a"], "e": ["f"], "f": [], "x": ["g"], "g": ["a"], "lost": ["a"]}


def site(spark, fail=lambda page, attempt: False, asked=None):
    def get(wanted, attempt):
        names = [r.url for r in wanted.collect()]
        if asked is not None:
            asked.extend(names)
        rows = [(n, not fail(n, attempt), "".join(f"<a href='{t}'>{t}</a>" for t in GRAPH[n])) for n in names if n in GRAPH and n != "gone"]
        return spark.createDataFrame(rows, "url string, ok boolean, html string")

    return get


def follow(fetched):
    return tables.anchors(fetched.select("url", "html")).select("url", F.col("href").alias("to"))


def test_crawl_depths_tries_and_circles(spark):
    starts = spark.createDataFrame([("a",), ("a",), ("gone",), (None,)], "url string")
    crawl = Crawl(spark, work_path(spark, "crawl"), site(spark, lambda n, k: n == "x" or n == "c" and k == 1), follow)
    got = {r.url: (r.depth, r.ok, r.tries) for r in crawl.run(starts).collect()}
    assert got == {"a": (0, True, 1), "gone": (0, False, 3), "b": (1, True, 1), "c": (1, True, 2), "d": (2, True, 1), "x": (2, False, 3), "e": (2, True, 1), "f": (3, True, 1)}
    assert {(r.url, r.to) for r in crawl.links().collect()} == {(a, b) for a in "abcdef" for b in GRAPH[a]}


def test_crawl_goes_on_where_it_stopped(spark):
    path, starts, asked = work_path(spark, "crawl"), spark.createDataFrame([("a",)], "url string"), []
    Crawl(spark, path, site(spark, asked=asked), follow).run(starts, levels=2)
    assert sorted(asked) == ["a", "b", "c"]

    def broken(fetched):
        raise OSError("killed")

    with pytest.raises(OSError):  # pages of the level are there, its links are not
        Crawl(spark, path, site(spark), broken).run(starts)
    pages = Crawl(spark, path, site(spark, asked=asked), follow).run(starts)
    assert sorted(asked) == sorted("abcdexfg") and {r.url: r.depth for r in pages.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": 2, "e": 2, "f": 3, "g": 3}
    with pytest.raises(ValueError):
        Crawl(spark, work_path(spark, "crawl"), site(spark), follow).run(starts.limit(0))


def test_addresses(spark):
    rows = [("http://h.x/a/b?q#f", h) for h in ("c", "/c", "../c#top", "//o.x/p", "https://z.y", "mailto:a@b", "#x", "http://[", None, "")]
    df = spark.createDataFrame(rows, "base string, href string")
    got = [r[0] for r in df.select(resolved("base", "href")).collect()]
    assert got == ["http://h.x/a/c", "http://h.x/c", "http://h.x/c", "http://o.x/p", "https://z.y", None, "http://h.x/a/b?q", None, None, "http://h.x/a/b?q"]
    pages = spark.createDataFrame([("http://h/", '<a class=1 href="x">t</a>'), ("http://n/", None)], "url string, html string")
    assert [tuple(r) for r in page_links(pages).collect()] == [("http://h/", "http://h/x")]


# Nested records


def flat(spark, *rows, **options):
    texts = [r if r is None or isinstance(r, str) else json.dumps(r) for r in rows]
    df = spark.createDataFrame([*enumerate(texts)], "id int, j string")
    out = nested.flatten_json(df, "j", **options)
    return out.columns, [r.asDict() for r in out.orderBy("id").collect()]


def test_nested_keys_become_columns(spark):
    columns, rows = flat(spark, {"a": 1, "b": {"c": "x", "d": {"e": True}}, "n": None}, {"b": {"c": "y", "f": [1, 2]}, "a": 2.5}, {})
    assert columns == ["id", "a", "b_c", "b_d_e", "b_f", "n"]
    assert [(r["b_c"], r["b_d_e"], r["b_f"]) for r in rows] == [("x", True, None), ("y", None, [1, 2]), (None, None, None)]
    assert [float(r["a"]) if r["a"] is not None else None for r in rows] == [1.0, 2.5, None]


def test_names_that_clash_are_numbered(spark):
    columns, rows = flat(spark, {"a_b": 1, "a": {"b": 2}, "id": "own"}, {"x": {"y": {"z": 1}, "y_z": 2}, "x_y_z": 3, "x_y": {"z": 4}})
    assert columns == ["id", "a_b", "a_bi", "id_i", "x_y_z", "x_y_zi", "x_y_zii", "x_y_ziii"]
    assert rows[0]["a_b"] == 2 and rows[0]["a_bi"] == 1 and rows[0]["id_i"] == "own"
    assert [rows[1][c] for c in columns[4:]] == [1, 2, 4, 3]


def test_keys_of_mixed_kinds(spark):
    columns, rows = flat(spark, {"p": "text"}, {"p": {"q": 1, "r": {"s": 2}}}, {"p": [1, {"k": 2}]}, {"p": {"q": {"deep": True}}}, {"p": None}, {"p": 7})
    assert columns == ["id", "p", "p_q", "p_q_deep", "p_r_s"]
    assert [r["p"] for r in rows] == ["text", None, '[1,{"k":2}]', None, None, "7"]
    assert [(r["p_q"], r["p_q_deep"], r["p_r_s"]) for r in rows][1:4] == [("1", None, 2), (None, None, None), (None, True, None)]


def test_odd_keys_and_rows(spark):
    columns, rows = flat(spark, {"a.b": 1, "it's": 2, 'say "x"': {"`": 3}, "k: v, <w>": {"é ": "ü"}, "": 5}, "no json", None, "[1]", "3", bad="bad")
    assert set(columns) == {"id", "bad", "a.b", "it's", 'say "x"_`', "k: v, <w>_é ", ""}
    assert rows[0]["a.b"] == 1 and rows[0]["it's"] == 2 and rows[0]['say "x"_`'] == 3 and rows[0]["k: v, <w>_é "] == "ü" and rows[0][""] == 5
    assert [r["bad"] for r in rows] == [None, "no json", None, "[1]", "3"]
    assert flat(spark, None)[0] == ["id"]
    assert nested.flatten_json(spark.createDataFrame([], "id int, j string"), "j").columns == ["id"]


# Keyword automata


def by_expression(text, keywords):
    pattern = "|".join(map(re.escape, filter(None, keywords)))
    return [(m.start(), m.end()) for m in re.finditer(rf"\b(?:{pattern})\b", text, re.I)] if pattern else []


WORDS = ["a", "ab", "b", "ba", "aba", "a b", "b a b", "ä", "Ä b", "c++", "(a)", "-", "a-b", "_a", "x1", "1"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=6), st.lists(st.lists(st.sampled_from([*WORDS, " ", "B", "Ab", ", ", "\n", "é"]), max_size=12).map("".join), max_size=4), st.sampled_from([3, 50]), st.sampled_from([4, 10**6]))
def test_automata_find_what_the_alternation_finds(keywords, texts, stretch, states):
    automaton.STRETCH, kept = stretch, automaton.STRETCH
    try:
        of, start, end, key = automaton.scan([*texts, None], automaton.automata(keywords, states))
    finally:
        automaton.STRETCH = kept
    for k, text in enumerate(texts):
        own = of == k
        assert [*zip(start[own].tolist(), end[own].tolist())] == by_expression(text, keywords)
        assert all(text[a:b].lower() == keywords[n].lower() for a, b, n in zip(start[own], end[own], key[own]))


def test_tables_of_automata_are_bounded(monkeypatch):
    keywords = [*WORDS, *(chr(0x4E00 + k) for k in range(60))]
    whole = automaton.automata(keywords)
    monkeypatch.setattr(automaton, "MAX_CELLS", 100)
    parts = automaton.automata(keywords)
    assert len(whole) == 1 and len(parts) > 5 and all(p.next.size <= 100 for p in parts)
    text = "ab a b \u4e05 b a b x1 \u4e10\u4e11 c++ (a)"
    assert [x.tolist() for x in automaton.scan([text], whole)] == [x.tolist() for x in automaton.scan([text], parts)]


def test_automaton_in_tables(spark):
    texts = ["The wind; WIND power and wind  power", None, "", "straße STRASSE İstanbul ıstanbul Kelvin", "x" * 10_000 + " wind " + "y" * 10_000, "wind́ wínd win\ndwind"]
    keywords = ["wind power", "wind", "straße", "istanbul", "kelvin", "", "Wind"]
    df = spark.createDataFrame([*enumerate(texts)], "id int, t string").withColumns({"hits": F.lit(1), "text": F.lit("x")})
    want = search.C.hits("t", search.C.keyword_pattern([k for k in keywords if k]))
    got = automaton.find(df, "t", keywords).select("id", automaton.surfaces("hits", "t").alias("found"), F.coalesce(want, F.array().cast("array<string>")).alias("want"))
    assert all(r.found == r.want for r in got.collect())
    assert automaton.find(df.limit(0), "t", keywords).collect() == [] and all(r.hits == [] for r in automaton.find(df, "t", []).collect())
    counts = {r.keyword: (r.n, r.texts) for r in automaton.keyword_counts(df, "t", keywords).collect()}
    assert counts["wind power"] == (1, 1) and counts["kelvin"] == (1, 1) and counts["wind"][1] == 2


def test_many_keywords_are_searched_for_as_few_are(spark):
    keywords = [f"k{k}" for k in range(search.MANY + 5)] + ["the", "k1 k2", "The k3"]
    df = spark.createDataFrame([(1, ["K1 k2 the k3", "k7,k7 K7"], None), (2, None, ["k204 zz"]), (3, [], None)], "id int, a array<string>, b array<string>")
    many = search.search(df, {"g": keywords, "h": ["zz"]}, ["a", "b"])
    few = search.search(df, {"g": keywords[-3:] + ["k1", "k2", "k3", "k7", "k204"], "h": ["zz"]}, ["a", "b"])
    plain = lambda out: sorted((r.id, tuple(sorted(r.keys_hit_g.items())), r.total_counts_g, r.total_counts_h) for r in out.collect())
    many_sorted = search.search(df, {"g": keywords[-3:] + keywords[:-3], "h": ["zz"]}, ["a", "b"])
    assert plain(many_sorted) == plain(few) and many.columns == few.columns


def test_a_year_of_any_size_is_compacted_by_many_tasks(spark, log, monkeypatch):
    monkeypatch.setattr(yearlog, "FILE", 100)
    for part in range(2):
        log.append(spark.range(500).selectExpr("2019 AS year", f"concat('x', id + {part * 500}) AS x").union(spark.sql("SELECT NULL, 'n'")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins such small files again
    try:
        now = log.compact()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [len(r) for r in now.years.values()] == [1, 1] and sorted(r.x for r in log.read(2019, 2020).collect()) == sorted(f"x{k}" for k in range(1000))
    assert log.read(2019, 2020).select("_metadata.file_path").distinct().count() > 1 and log.read().where("year IS NULL").count() == 2
