"""Relational operators, hierarchies, concordance, search, names, sources, stages and streams on small fixtures."""

import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grantmill.operators import concordance, entities, hierarchy, relational, search
from grantmill.plans import stages
from grantmill.session import stored, temporaries
from grantmill.sources import fetch, tables
from grantmill.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_many_to_one(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), (None, "n")], "name string, w string")
    assert rows(relational.join_many_to_one(left, right, [("k", "name")]).select("k", "v", "w"), "v") == [("a", 1, "x"), ("b", 2, None), (None, 3, None)]
    with pytest.raises(relational.NotUnique):
        relational.join_many_to_one(left, right.union(right), [("k", "name")])
    with pytest.raises(relational.NotUnique):
        relational.join_one_to_one(left.union(left), left, ["k"])


def test_country_versions(spark):
    countries = spark.createDataFrame([("DE", "DT", "DEU", "Germany"), ("NA", "SW", "NAM", "Namibia")], ["2_Code", "2_Code_old", "3_Code", "Country_Name"])
    df = spark.createDataFrame([(1, "DT", 1977), (2, "DE", 1977), (3, "DE", 1990), (4, "NA", 1990), (5, "DE", None)], "i int, bio_assignee_country string, year int")
    got = relational.merge_country(df, countries).select("i", "Country_Name", "2_Code")
    assert rows(got, "i") == [(1, "Germany", "DT"), (2, None, None), (3, "Germany", "DE"), (4, "Namibia", "NA"), (5, "Germany", "DE")]


def test_null_keys_are_left_out(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "k string, v int")
    assert rows(relational.count_by(df, ["k"], "v")) == [("a", 1)]
    assert rows(relational.value_counts(df, "k")) == [("a", 2)]


def test_lag_summary(spark):
    lags = spark.createDataFrame([(1976, 1, 3), (1977, 2, 1), (1978, 9, 1), (1978, -1, 5), (1990, 40, 2)], "application_year int, gap int, count long")
    got = {(b, g): v for b, g, v in rows(relational.lag_summary(lags))}
    gaps = np.array([1, 1, 1, 2, 9])
    assert got[("1976-1978", ">7")] == pytest.approx(0.2) and got[("1976-1978", "1")] == pytest.approx(0.6)
    assert got[("1976-1978", "mean")] == pytest.approx(gaps.mean()) and got[("1976-1978", "sd")] == pytest.approx(gaps.std())
    assert {b for b, _ in got} == {"1976-1978"}
    assert relational.lag_table(relational.lag_summary(lags)).columns[0] == "gap"


def test_keep_first_and_fill(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "y")], "k string, seq int, v string")
    assert rows(relational.keep_first(df, "k", ["seq"]), "k") == [("a", 1, None), ("b", 5, "y")]
    assert rows(relational.forward_fill(df, ["v"], "seq").select("seq", "v"), "seq") == [(1, None), (2, "x"), (5, "y")]
    gaps = spark.createDataFrame([(k, "v%d" % k if k % 37 == 5 else None, "w" if k == 150 else None) for k in range(200)], "seq int, v string, w string").repartition(3)
    assert rows(relational.forward_fill(gaps, ["v", "w"], "seq"), "seq") == [(k, f"v{(k - 5) // 37 * 37 + 5}" if k >= 5 else None, "w" if k >= 150 else None) for k in range(200)]
    assert relational.forward_fill(gaps.limit(0), ["v"], "seq").count() == 0


def test_taxonomy_and_exclusion(spark):
    df = spark.createDataFrame([(f"{stages.EXCLUDED}|x", 2005), ("Wind", 2005), (None, 2006)], "est_description string, year int")
    assert relational.filter_taxonomy(df).count() == 2
    assert rows(relational.kept_and_total(df, "year"), "year") == [(2005, 2, 2), (2006, 0, 1)]
    assert rows(relational.exclude_category(df, stages.EXCLUDED), "year") == [("Wind", 2005), (None, 2006)]


SCHEDULE = [(0, "1", 0, "Top"), (1, "2", 1, "Sub"), (2, "3.1", 2, "Deep"), (3, None, 1, "Blank"), (4, "2", 1, "Again"), (5, "9", 0, "Other"), (6, "10", 2, "Skip"), (7, "11", 1, "Back")]


@pytest.fixture(scope="module")
def tree(spark):
    raw = spark.createDataFrame([("010", *r) for r in SCHEDULE], "cat_id string, seq int, code string, level int, name string")
    return stored(hierarchy.class_tree(raw, spark.createDataFrame([("010", "Ten")], "cat_id string, cat_name string")), "tree")


def test_tree(tree):
    got = {r.code: (r.parent_code, "||".join(r.ancestor_names)) for r in tree.collect()}
    assert got["31"] == ("2", "Ten||Top||Sub||Deep") and got[""] == ("1", "Ten||Top||Blank") and got["_next"] == ("1", "Ten||Top||Again") and got["root"] == (None, "Ten")
    assert got["10"] == ("9", "Ten||Other||Skip") and got["11"] == ("9", "Ten||Other||Back")  # a level that is skipped
    assert sorted(r.code for r in hierarchy.descendants(tree, "2").collect()) == ["2", "31"]
    assert "root" not in {r.code for r in hierarchy.descendants(tree, "root").collect()}


def test_levels_are_as_many_as_there_are(spark):
    deep = spark.createDataFrame([("c", k, f"n{k}", k, "x") for k in range(20)], "cat_id string, seq int, code string, level int, name string")
    assert {r.code: r.parent_code for r in hierarchy.with_parent(deep).collect()} == {f"n{k}": f"n{k - 1}" if k else None for k in range(20)}


def test_repeated_codes(spark):
    codes = ["a", "b", "a", "a", "c", "b", None, None, "a.", "d"]
    df = spark.createDataFrame([("c", k, c) for k, c in enumerate(codes)], "cat_id string, seq int, code string")
    assert [r.code for r in hierarchy.unique_codes(df).orderBy("seq").collect()] == ["a", "b", "b_next", "b_next_next", "c", "c_next", "", "_next", "_next_next", "d"]


def test_labels(spark, tree):
    classes = spark.createDataFrame([("010", "Class ten"), ("011", "Eleven")], "cat_id string, cat_name string")
    raw = spark.createDataFrame([(1, "US 10 31"), (2, "US 10 77"), (3, "US 99 1"), (4, None), (5, "[]"), (6, "US 10 31")], "i int, raw string")
    got = rows(hierarchy.label_codes(raw, "raw", tree, classes).select("i", "cat_name", "status"), "i")
    assert got == [(1, "Ten||Top||Sub||Deep", "success"), (2, "Class ten", "fail"), (3, None, "fail"), (4, None, "fail"), (5, None, "fail"), (6, "Ten||Top||Sub||Deep", "success")]


def test_ipc_scheme(spark):
    scheme = '<ipcEntry symbol="H"><textBody><title><titlePart><text>ELECTRICITY</text></titlePart></title></textBody><ipcEntry symbol="H04L0009200000"><textBody><title><titlePart><text>Keys</text></titlePart><titlePart><text>Codes</text></titlePart></title></textBody></ipcEntry></ipcEntry>'
    nodes = hierarchy.ipc_nodes(scheme)
    assert nodes == [("H", "ELECTRICITY", None), ("H04L0009200000", "Keys;Codes", "H")]
    df = spark.createDataFrame(nodes, "code string, name string, parent_code string").withColumn("cat_id", F.lit("ipc"))
    tree = hierarchy.closure(df).select(F.col("code").alias("symbol"), F.col("ancestor_names").alias("ancestor_titles"))
    got = hierarchy.label_ipc(spark.createDataFrame([("H04L 9/20 [x]",), ("A01B 1/00",)], "raw string"), "raw", tree)
    assert {r.raw: r.ipc_label for r in got.collect()} == {"H04L 9/20 [x]": "ELECTRICITY||Keys;Codes", "A01B 1/00": None}


def test_topics_keep_stale_levels(spark):
    source = [(1, "Energy", None), (2, ".Solar", "010/2+"), (3, "..Cells", "10/5-9"), (4, "Waste", None), (5, ".Heat", "012"), (6, ".Bad", "a/b-c-d")]
    got = concordance.topics(spark.createDataFrame(source, "seq int, TOPIC string, USPC string"))
    assert rows(got.select("seq", "topic_des"), "seq") == [(2, "Energy|Solar||"), (3, "Energy|Solar|Cells|"), (5, "Waste|Heat|Cells|"), (6, "Waste|Bad|Cells|")]


def test_concordance(spark, tree):
    source = [(1, "wide", "010/2+"), (2, "list", "010/3.1,9+; 010/1, 9+"), (3, "range", "10/5-9"), (4, "lost", "010/77+"), (5, "class", "12"), (6, "any", "013/various"), (7, "odd", "1/2-3-4")]
    df = spark.createDataFrame(source, "seq int, topic_des string, USPC string")
    patterns = concordance.expand_patterns(df, tree)
    got = {}
    for s, _, p in rows(patterns):
        got.setdefault(s, set()).add(p)
    assert got == {1: {"010/2", "010/31"}, 2: {"010/31", "010/9", "010/10", "010/11", "010/1"}, 3: {"010/5-9"}, 5: {"012"}, 6: {"013/various"}, 7: {"001/2-3-4"}}
    codes = spark.createDataFrame([("US 10 31",), ("US 10 7",), ("US 12 4",), ("US 13 99",), ("US 10 10",), ("US 99 9",), (None,)], "raw string")
    compiled = concordance.compile_patterns(patterns)
    found = {r.raw: r.est_description for r in concordance.first_match(codes.repartition(3), "raw", compiled).collect()}
    assert found == {"US 10 31": "wide", "US 10 7": "range", "US 12 4": "class", "US 13 99": "any", "US 10 10": "list", "US 99 9": None, None: None}


def test_search(spark):
    schema = "id int, abstract_paras array<string>, claims_claims array<string>, description_paras array<string>, keys_hit string"
    df = spark.createDataFrame([(1, ["Solar cell"], ["solar"], None, "old"), (2, None, None, None, None)], schema)
    got = search.search(df, {"v1": ["solar", "cell"], "v2": []})
    assert "keys_hit" not in got.columns
    one, two = got.orderBy("id").collect()
    assert one.keys_hit_v1 == {"Solar": 1} and one.total_counts_v1 == 1  # "cellsolar": sections are glued
    assert search.search(df, {"v1": ["solar", "cell"]}, blank=True).orderBy("id").first().total_counts_v1 == 3
    assert two.keys_hit_v1 == {} and two.total_counts_v1 == 0 and one.total_counts_v2 == 0
    sheet = tables.keyword_groups(spark.createDataFrame([(0, "wind\u00a0", "pv"), (1, "wave", None)], "seq int, v1 string, v2 string"), "seq")
    assert sorted(rows(sheet)) == [("v1", 0, "wind"), ("v1", 1, "wave"), ("v2", 0, "pv")]
    assert search.group_keywords(sheet) == {"v1": ["wind", "wave"], "v2": ["pv"]}
    assert search.group_keywords(tables.keyword_groups(spark.createDataFrame([("a", "b")], "v1 string, v2 string"))) == {"v1": ["a"], "v2": ["b"]}
    long = spark.createDataFrame([("v1", 0, "a (b) c"), ("v1", 1, "d")], "group string, pos int, keyword string")
    assert search.group_keywords(long, clean=True) == {"v1": ["a c", "d"]}


def test_similarity():
    assert entities.similarity("ACME", "ACME") == pytest.approx(100)
    assert entities.similarity("", "ACME") < 1e-6
    assert entities.similarity("ACME WORKS", "WORKS ACME") == entities.similarity("WORKS ACME", "ACME WORKS")
    assert entities.token_set_ratio("acme works", "acme") == 100 and entities.partial_ratio("cme w", "acme works") == 100
    assert entities.longest_common("xabyabz", "zab") == "ab" and entities.longest_common("abc", "") == entities.longest_common("", "abc") == ""


def test_standard_names(spark):
    clusters = [("ACME WORKS", 0), ("ACME LABS", 0), ("ACME LINES", 0), ("AB", 1), ("CD", 1), ("X", 2), ("PQ 12", 3), ("PQ 34", 3), ("ZZ 34", 3)]
    got = {r.CompanyName: r.StandardName for r in entities.standard_names(spark.createDataFrame(clusters, "CompanyName string, cluster int")).collect()}
    assert {got[n] for n in ("ACME WORKS", "ACME LABS", "ACME LINES")} == {"ACME"} and got["AB"] == got["CD"] == "AB" and got["X"] == "X" and got["PQ 12"] == "PQ;;34"


def test_affinity_propagation():
    s = np.full((6, 6), 10.0)
    s[:3, :3] = s[3:, 3:] = 95.0
    labels = entities.affinity_propagation(s + np.arange(6)[:, None] * 1e-3, 50.0)
    assert len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[3]
    assert entities.affinity_propagation(np.zeros((1, 1)), 50).tolist() == [0]


def test_resolve(spark):
    names = [("ACME WORKS INC", 30), ("ACME WORKS LTD", 25), ("ZETA CORP", 40), ("RARE NAME", 2)]
    got = {r.names: r for r in entities.resolve(spark.createDataFrame(names, "names string, count long")).collect()}
    assert got["ACME WORKS INC"].names_v2 == got["ACME WORKS LTD"].names_v2 == "ACME WORKS"
    assert got["RARE NAME"].cluster is None and got["ZETA CORP"].StandardName == "ZETA"


def test_csv_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,country,n\n001,NA,1\n002,DE\n003,"x ""y"", z",3\n004,FR,4,5\n')
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), StructType.fromDDL("id STRING, country STRING, n INT"))
    assert rows(got, "id") == [("001", "NA", 1), ("002", "DE", None), ("003", 'x "y", z', 3)]


def test_sheets_years_json(spark, tmp_path):
    df = spark.createDataFrame([(2005, 1.23456), (2006, 2.0)], "year int, v double")
    assert tables.write_sheets([df, df], str(tmp_path / "book"), digits=4) == ["Sheet1", "Sheet2"]
    assert rows(tables.read_sheet(spark, str(tmp_path / "book"), "Sheet2", df.schema), "year") == [(2005, 1.2346), (2006, 2.0)]
    tables.write_years(df, str(tmp_path / "years"))
    assert rows(tables.read_years(spark, str(tmp_path / "years"), 2006, 2007).select("year")) == [(2006,)]
    for _ in range(2):
        tables.write_meta(df, str(tmp_path / "meta"))
    assert rows(tables.read_year_counts(spark, str(tmp_path / "meta"))) == [(2005, 1), (2006, 1)]
    tables.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "x.csv").write_text("a\n1\n")
    (tmp_path / "~x.csv").write_text("a\n2\n")
    assert rows(tables.read_matching(spark, str(tmp_path / "*.csv"), StructType.fromDDL("a INT")).select("a")) == [(1,)]
    (tmp_path / "k.txt").write_text(" Wind Power \n\nPV\n")
    assert rows(tables.read_keywords(spark, str(tmp_path / "k.txt"))) == [("wind power",), ("pv",)]
    assert rows(spark.createDataFrame([("['a', 'b']",), ("oops[",), (None,)], "x string").select(tables.literal_list("x"))) == [(["a", "b"],), ([""],), (None,)]
    odd = [("[]", []), ("('x',)", ["x"]), ("[1, 'b']", ["1", "b"]), ("['it\\'s']", ["it's"]), ("[\"q\", 'r',]", ["q", "r"]), ("{'a'}", [""]), (" ['a'] ", ["a"])]
    assert [r[0] for r in spark.createDataFrame([(x,) for x, _ in odd], "x string").coalesce(1).select(tables.literal_list("x")).collect()] == [x for _, x in odd]


def test_crawl(spark):
    index = '<a href="/y1">Patent Grant Full Text (JAN - DEC 2005)</a><a href="/z">Other</a>'
    links = tables.archive_years(spark.createDataFrame([(index,)], "html string"))
    assert rows(links) == [("Patent Grant Full Text (JAN - DEC 2005)", "2005", "/y1")]
    child = spark.createDataFrame([("t1", '<a href="b.zip">b.zip</a><a href="a.zip">a.zip</a>'), ("t2", "<p>none</p>")], "title string, html string")
    files = tables.archive_files(child)
    assert rows(files, "title") == [("t1", ["b.zip", "a.zip"], True), ("t2", [], False)]
    assert tables.all_done(files).first()[0] is False
    assert spark.range(1).select(tables.file_url(F.lit("2005"), F.lit("a.zip"), "http://x/")).first()[0] == "http://x/2005/a.zip"
    status = spark.createDataFrame([("t", {"a": True, "b": False})], "title string, down_status map<string,boolean>")
    assert rows(tables.failed_files(status)) == [("t", "b")]


def test_fetch(spark):
    def get(url):
        if url == "down":
            raise OSError("no route")
        sizes = {"good": 30, "unknown": None, "short": 3, "gone": 30}
        return fetch.Answer(404 if url == "gone" else 200, sizes[url], iter([b"x" * 10, b"y" * 20]))

    wanted = spark.createDataFrame([("t", u) for u in ("good", "unknown", "short", "gone", "down")], "title string, url string")
    got = stored(fetch.fetch(wanted, get, tries=2, rounds=2, pause=0), "fetched")
    assert {r.url: (r.down_status, r.tries) for r in got.collect()} == {"good": (True, 1), "unknown": (True, 1), "short": (False, 4), "gone": (False, 4), "down": (False, 4)}
    assert {r.url for r in relational.pending(wanted, got.where("down_status"), ["url"]).collect()} == {"short", "gone", "down"}
    assert rows(tables.failed_files(fetch.status_map(got)), "url") == [("t", "down"), ("t", "gone"), ("t", "short")]


def test_class_pages(spark):
    page = '<table><tr><td valign="top" width="27">002</td><td>APPAREL</td></tr></table>'
    assert rows(tables.class_list(spark.createDataFrame([(page,)], "html string"))) == [(0, "002", "APPAREL")]
    schedule = '<table><tr><td>skip</td></tr></table><table class="SubTtl"><tr><td><a>1</a></td><td>TOP</td></tr><tr><td>2.1</td><td><img alt="1"></td><td>Sub</td></tr></table>'
    got = tables.schedule_rows(spark.createDataFrame([("010", schedule)], "cat_id string, html string"))
    assert rows(got, "seq") == [("010", 0, "1", 0, "TOP"), ("010", 1, "2.1", 1, "Sub")]
    table = "<table><tr><td>x</td></tr></table><table>" + "".join(f"<tr><td>{a}</td><td>{b}</td><td>{c}</td></tr>" for a, b, c in [("h", "h", "h"), ("i", "i", "i"), ("A01B", "1 /00", "old"), ("A01B", "1/00", "new")]) + "</table>"
    cells = tables.html_table(spark.createDataFrame([(table,)], "html string"), 1)
    assert rows(tables.code_map(cells)) == [("A01B 1/00", "new")]


def archive(path, name, text):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(name, text)
    path.write_bytes(buffer.getvalue())


def test_archives_resume(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    archive(tmp_path / "raw" / "a.b.zip", "a.xml", "<x/>")
    (tmp_path / "raw" / "bad.zip").write_bytes(b"no zip")
    assert {r.out_folder for r in tables.zip_inventory(spark, str(tmp_path / "raw")).collect()} == {"a", "bad"}
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    incremental.unpack_available(spark, str(tmp_path / "raw"), out, mark)
    archive(tmp_path / "raw" / "c.zip", "c.xml", "<y/>")
    incremental.unpack_available(spark, str(tmp_path / "raw"), out, mark)
    got = {(r.member, r.text, r.unzip_status) for r in spark.read.parquet(out).collect()}
    assert got == {("a.xml", "<x/>", True), (None, None, False), ("c.xml", "<y/>", True)} and spark.read.parquet(out).count() == 3
    wanted = spark.createDataFrame([("a",), ("b",)], "url string")
    assert rows(relational.pending(wanted, wanted.where("url = 'a'"), ["url"])) == [("b",)]


def test_stages(spark):
    docs = spark.createDataFrame(
        [("00123", "20050101", "20040101", None, "DEX", "US", "Wind", 1), ("D77", "20060101", "x", "ACME", None, "US", "Wind", 0), ("9", "20060101", "20050101", "ACME", None, "US", stages.EXCLUDED, 0)],
        ["bio_doc-number", "bio_date", "bio_application_date", "bio_assignee_name", "bio_applicant_country", "bio_country", "est_description", "total_counts_v1"],
    ).withColumn("bio_assignee_country", F.lit(None).cast("string"))
    small = relational.keep_small(docs)
    countries = spark.createDataFrame([("DE", "DT", "DEU", "Germany"), ("US", "US", "USA", "United States")], ["2_Code", "2_Code_old", "3_Code", "Country_Name"])
    named = relational.merge_country(small.withColumn("year", F.col("year")), countries)
    assignees = spark.createDataFrame([(1, "NEW CO", "GERMANY"), (2, "LATE CO", "GERMANY")], "rf_id int, ee_name string, ee_country string")
    documents = spark.createDataFrame([(1, "123.0"), (2, "123"), (2, None)], "rf_id int, grant_doc_num string")
    fixes = spark.createDataFrame([("GERMANY", "DE", "DEU", "Deutschland")], ["raw_country_name", "2_Code_Fix", "3_Code_Fix", "Country_Name_Fix"])
    mapped = stages.assignee_map(assignees, documents, fixes)
    joined = stages.attach_assignees(named, mapped)
    got = {r["bio_doc-number"]: (r.bio_assignee_name, r.Country_Name) for r in joined.collect()}
    assert got == {"00123": ("NEW CO", "Deutschland"), "D77": ("ACME", "United States"), "9": ("ACME", "United States")}
    names = spark.createDataFrame([("NEW CO", "New"), ("ACME", "Acme")], "names string, Final_Names string")
    final = stages.final_table(joined, names)
    assert [(r["bio_doc-number"], r.final_ee_name) for r in final.collect()] == [("00123", "New")]
    assert [r.final_ee_name for r in stages.final_table(joined, names.where("names = 'ACME'")).collect()] == ["NEW CO"]
    assert rows(stages.summaries(final, ["v1"]).select("version", "application_year", "2_Code", "Country_Name", "count_binary", "total_counts_count", "total_counts_sum")) == [("v1", 2004, "DE", "Deutschland", True, 1, 1)]
    assert rows(stages.summaries(final, ["v1"], stages.COMPANY_KEYS).select("final_ee_name", "total_counts_sum")) == [("New", 1)]
    assert rows(stages.totals_by_country(docs.unionByName(docs.withColumn("bio_application_date", F.lit("20060101"))), countries), "year", "Country_Name") == [(2006, "United States", 2, 4)]
    simple = relational.keep_simple(docs, ["est_description"], "total_counts_v1")
    assert stages.summarise(simple, ["year"], lambda d: d.where("count_binary")).collect()[0].total_counts_sum == 1


def test_label_stage(spark, tree):
    docs = spark.createDataFrame([("1", "US 10 31"), ("2", None)], ["bio_doc-number", "bio_main-classification_national"])
    classes = spark.createDataFrame([("010", "Ten")], "cat_id string, cat_name string")
    patterns = concordance.expand_patterns(spark.createDataFrame([(1, "Energy|||", "010/2+")], "seq int, topic_des string, USPC string"), tree)
    got = stages.label(docs, tree, classes, concordance.compile_patterns(patterns))
    assert {r["bio_doc-number"]: (r.cat_name, r.est_description) for r in got.collect()} == {"1": ("Ten||Top||Sub||Deep", "Energy|||"), "2": (None, None)}


def test_temporaries_go(spark):
    with temporaries(spark):
        held = stored(spark.range(5), "short")
        files = held.inputFiles()
        assert held.count() == 5
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files) and files
    assert stored(spark.range(3), "kept").count() == 3


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; small lookups are broadcast; counts combine before the shuffle."""
    spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(100)], "id int, text string, k int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = relational.count_by(relational.exclude_category(df.where("k > 1"), "x", "text"), ["k"], "id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,1)" in plan and "partial_count" in plan
    joined = relational.join_many_to_one(df, df.select(F.col("id").alias("key"), F.lit(1).alias("w")), [("id", "key")])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in joined
