"""The SQL surface against the column functions; records fetched by their places against full scans."""

import pytest
from pyspark.sql import functions as F

from grantmill.functions import columns as C
from grantmill.functions import sql
from grantmill.session import work_path
from grantmill.sources import offsets, records

VALUES = ["20010203", "1976", "x", "", None, "00012.0", "0", "a|b||c", "||a", "H04L 9/20 [x];G01N 1/00", "H04L  123456/1234567 [y]", "H04L", "solar (PV) cell", "open (end", "(a)(b) c", "USA", "ACME HOLDINGS, LTD", "COMPANY", "GMBH & CO KG", " AND SONS, INC.", "O'NEIL S.A.", "BANK (EUROPE) B.V.", "Société Générale SA", "A\\B INC"]


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("process_year", C.process_year), ("normalise_doc_id", C.normalise_doc_id), ("first_token", C.first_token), ("first_level", C.first_level), ("ipc_code", C.ipc_code), ("clean_keyword", C.clean_keyword),
        ("clean_company", C.clean_name_with_fallback), ("consolidate_country", lambda x: C.consolidate_country(x, F.reverse(x), F.lit(None).cast("string"))),
    ],
)
def test_rules_in_sql_are_those_of_columns(spark, name, column):
    sql.register(spark)
    spark.createDataFrame([(v,) for v in VALUES], "v string").createOrReplaceTempView("sql_values")
    call = "consolidate_country(v, reverse(v), NULL)" if name == "consolidate_country" else f"{name}(v)"
    got = spark.table("sql_values").select("v", F.expr(call).alias("got"), column(F.col("v")).alias("want")).collect()
    assert [r for r in got if r.got != r.want] == []


TEXT = "PATN\nWKU  {n}\nISD  20010203\nABST\nPAL  as in {m}\nCLMS\nPAR  1. A thing.\n"


def test_records_by_a_table_function(spark):
    sql.register(spark)
    rows = [("f1", 1, TEXT.format(n=5, m=6)), ("f2", 2, "PATN\n" + "ABST\nPAL  x\n" * 300), ("f3", 3, None)]
    spark.createDataFrame(rows, "file string, extra int, record string").createOrReplaceTempView("sql_raw")
    got = spark.sql("SELECT file, extra, `bio_doc-number` AS n, abstract_paras, parse_error FROM parse_records(TABLE(sql_raw), 'text') ORDER BY extra").collect()
    assert [(r.file, r.extra, r.n) for r in got] == [("f1", 1, "5"), ("f2", 2, None), ("f3", 3, None)]
    assert got[0].abstract_paras == ["as in 6"] and got[1].parse_error and got[2].parse_error
    assert spark.sql("SELECT * FROM parse_records(TABLE(SELECT * FROM sql_raw WHERE extra > 9), 'text')").collect() == []
    for bad in ("parse_records(TABLE(SELECT 1 AS x), 'text')", "parse_records(TABLE(sql_raw), 'pdf')"):
        with pytest.raises(Exception, match="parse_records needs"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_a_table_function_gives_only_the_columns_wanted(spark):
    sql.register(spark)
    rows = [(1, TEXT.format(n=5, m=6), "own"), (2, "PATN\n" + "ABST\nPAL  x\n" * 300, "own"), (3, None, None)]
    spark.createDataFrame(rows, "extra int, record string, bio_date string").createOrReplaceTempView("sql_some")
    got = spark.sql("SELECT * FROM parse_records(TABLE(sql_some), 'text', 'abstract_paras, bio_date, bio_doc-number') ORDER BY extra")
    assert got.columns == ["extra", "bio_date", "abstract_paras", "bio_doc-number"]
    assert [tuple(r) for r in got.collect()] == [(1, "own", ["as in 6"], "5"), (2, "own", None, None), (3, None, None, None)]
    assert spark.sql("SELECT * FROM parse_records(TABLE(SELECT record FROM sql_some), 'text', 'claims_ok')").columns == ["claims_ok"]
    for bad in ("''", "'record'", "'claims_ok, claims_ok'", "1"):
        with pytest.raises(Exception, match="parse_records needs"):
            spark.sql(f"SELECT * FROM parse_records(TABLE(sql_some), 'text', {bad})").collect()


SOURCES = {
    "text": "PATN\nWKU  {n}\nISD  20010203\nABST\nPAL  as in {m} PATN é\n\n  PATN not a mark\nCLMS\nPAR  1. A thing.   \n",
    "xml": '<?xml version="1.0"?><us-patent-grant><publication-reference><document-id><doc-number>{n}</doc-number></document-id></publication-reference><abstract><p>as in {m} é</p></abstract></us-patent-grant>\n\n',
    "sgml": "<!DOCTYPE PATDOC SYSTEM 'x'><PATDOC><SDOBI><B100><B110><DNUM><PDAT>{n}</PDAT></DNUM></B110></B100></SDOBI><SDOAB><PARA><PDAT>as in {m}</PDAT></PARA></SDOAB></PATDOC>\n",
}
MARKS = {"xml": records.XML_MARK, "sgml": records.SGML_MARK}


@pytest.mark.parametrize("kind", SOURCES)
@pytest.mark.parametrize(("span", "step"), [(37, 16), (256, 100), (1 << 20, 1 << 20)])
def test_fetched_records_are_those_of_a_scan(spark, tmp_path, monkeypatch, kind, span, step):
    monkeypatch.setattr(offsets, "RANGE", span)
    monkeypatch.setattr(offsets, "STEP", step)
    size = 4 if span < 100 else 12
    for name in ("a.txt", "b.txt"):
        body = "".join(SOURCES[kind].format(n=f"{name[0]}{k}" if k % 4 else "both", m=f"{name[0]}{k + 1}") for k in range(size))
        (tmp_path / name).write_bytes(("\n  lead\n" + body).encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    scan = records.scan_text_records(spark, str(tmp_path)) if kind == "text" else records.scan_records(spark, str(tmp_path), MARKS[kind])
    known = {}
    for r in scan.collect():
        try:
            number = records.PARSERS[kind](r.record, False).get("bio_doc-number")
        except Exception:
            continue
        if number is not None:
            known.setdefault(number, []).append((r.file.rpartition("/")[2], r.record))
    index = offsets.build_index(spark, str(tmp_path), kind, work_path(spark, "index"))
    assert index.count() == sum(map(len, known.values())) == 2 * size
    wanted = ["both", "a1", "b3", "none", "a999"]
    got = {}
    for r in offsets.fetch(offsets.find(index, wanted), kind).collect():
        got.setdefault(r.number, []).append((r.file.rpartition("/")[2], r.record))
    assert {n: sorted(x) for n, x in got.items()} == {n: sorted(known[n]) for n in wanted if n in known}


def test_a_lookup_reads_its_own_bytes_only(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("".join(SOURCES["text"].format(n=k, m=k) for k in range(50)))
    index = offsets.build_index(spark, str(tmp_path), "text", work_path(spark, "index"))
    at = offsets.find(index, ["7"]).first()
    raw = bytearray(path.read_bytes())
    path.write_bytes(bytes(raw[k] if at.start <= k < at.start + at.length else 0 for k in range(len(raw))))
    assert "WKU  7" in offsets.fetch(offsets.find(index, ["7"]), "text").first().record
    assert "PushedFilters: [In(number, [7,8])" in offsets.find(index, ["7", "8"])._jdf.queryExecution().toString()
    assert offsets.find(index, map(str, range(offsets.FEW + 5))).count() == 50
    assert offsets.fetch(offsets.find(index, []), "text").collect() == []


def test_places_and_records_in_pieces(spark, tmp_path, monkeypatch):
    """A task holds a few records at a time, of a range with many."""
    monkeypatch.setattr(offsets, "ROWS", 3)
    monkeypatch.setattr(offsets, "BYTES", 70)
    (tmp_path / "x.txt").write_text("".join(f"PATN\nWKU  {k}\nISD  19760106\nABST\nPAL  {'t' * (k * 7 % 50)}\n" for k in range(20)))
    index = offsets.build_index(spark, str(tmp_path / "x.txt"), "text", str(tmp_path / "index"))
    assert sorted(int(r.number) for r in index.collect()) == [*range(20)]
    got = {int(r.number): r.record for r in offsets.fetch(offsets.find(index, [str(k) for k in range(1, 18)]), "text").collect()}
    assert got == {k: f"PATN\nWKU  {k}\nISD  19760106\nABST\nPAL" + (f"  {'t' * (k * 7 % 50)}" if k * 7 % 50 else "") for k in range(1, 18)}
