"""The three record formats, one check for each decision on a quirk."""

import pytest

from grantmill.schema import PARSED
from grantmill.sources import records as R

XML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE us-patent-grant SYSTEM "us-patent-grant-v45.dtd" [ ]>
<us-patent-grant><us-bibliographic-data-grant>
<publication-reference><document-id><country>US</country><doc-number>07654321</doc-number><kind>B2</kind><date>20100202</date></document-id></publication-reference>
<application-reference><document-id><date>20080101</date></document-id></application-reference>
<classifications-ipcr>
<classification-ipcr><ipc-version-indicator><date>20060101</date></ipc-version-indicator><section>H</section><class>04</class><subclass>L</subclass><main-group>9</main-group><subgroup>20</subgroup><symbol-position>F</symbol-position></classification-ipcr>
<classification-ipcr><section>G</section><class>01</class><subclass>N</subclass><main-group>1</main-group><subgroup>00</subgroup></classification-ipcr>
</classifications-ipcr>
<classifications-cpc><classification-cpc><section>Y</section><class>02</class><subclass>E</subclass><main-group>10</main-group><subgroup>50</subgroup></classification-cpc></classifications-cpc>
<classification-national><country>US</country><main-classification>333 21 R</main-classification></classification-national>
<references-cited><citation><classification-national><country>DE</country><main-classification>1</main-classification></classification-national></citation></references-cited>
<us-applicants><us-applicant><addressbook><orgname>Acme &amp; Sons</orgname><address><city>Bonn</city><country>DE</country></address></addressbook></us-applicant></us-applicants>
<inventors><inventor><addressbook><last-name>Weiß</last-name><first-name>Eva</first-name></addressbook></inventor></inventors>
<assignees><assignee><addressbook><orgname>Acme</orgname><address><city>Bonn</city><country>DE</country></address></addressbook></assignee></assignees>
</us-bibliographic-data-grant>
<abstract><p>A <b>solar</b> cell.</p><p>More.</p></abstract><description><p>It is&nbsp;new.</p></description><claims><claim>1. A cell.</claim></claims></us-patent-grant>"""

SGML = """<!DOCTYPE PATDOC PUBLIC "-//USPTO//DTD" [
<!ENTITY X SYSTEM "x.tif">
]>
<PATDOC><SDOBI><B100><B110><DNUM><PDAT>06300001</PDAT></DNUM></B110><B140><DATE><PDAT>20011009</PDAT></DATE></B140><B190><PDAT>US</PDAT></B190></B100>
<B200><B220><DATE><PDAT>19990101</PDAT></DATE></B220></B200>{b300}<B500><B510><B511><PDAT> H04L009</PDAT></B511><B516><PDAT>7</PDAT></B516></B510><B520><B521><PDAT>358 11</PDAT></B521></B520></B500>
<B720><B721><PARTY-US><NAM><FNM><PDAT>Ann</PDAT></FNM><SNM><STEXT><PDAT>Lee</PDAT></STEXT></SNM></NAM><ADR><CITY><PDAT>Ulm</PDAT></CITY></ADR></PARTY-US></B721></B720></SDOBI>
<SDOAB><BTEXT><PARA><PTEXT><PDAT>One.</PDAT></PTEXT></PARA></BTEXT></SDOAB>{sdode}<SDOCL><CL><PDAT>1. It.</PDAT></CL></SDOCL></PATDOC>"""

TEXT = """HHHHHT  header line
PATN
WKU  039300000
APD  19740102
ISD  19760106
INVT
NAM  Smith; John
CTY  Basel
CNT  CHX
INVT
NAM  Other; Jane
ASSG
NAM  Works Ltd.
CNT  DEX
{prir}CLAS
OCL   44589
ICL  B01D  1/00
ABST
PAL  First
      more of it
GOVT
PAC  Rights
BSUM
PAR  The PATN mark in prose.
TBL  1 2 3
CLMS
STM  What is claimed is:
NUM  1.
PAR  1. A thing.
"""


def test_xml():
    got = R.parse_xml(XML)
    assert (got["bio_doc-number"], got["bio_country"], got["bio_date"], got["bio_application_date"]) == ("07654321", "US", "20100202", "20080101")
    assert got["bio_main-classification_ipc"] == "H04L 9/20 [20060101_F_None_None_None_None_None_None];G01N 1/00 [None_None_None_None_None_None_None_None]"
    assert got["bio_main-classification_cpc"].startswith("Y02E 10/50 [") and R.parse_xml(XML, compat=True)["bio_main-classification_cpc"] == ""
    assert got["bio_main-classification_national"] == "US 333 21 R" and got["bio_main-classification_locarno"] == ""
    assert got["bio_applicant_organization_name"] == "Acme & Sons" and got["bio_inventor_last_name"] == "Weiß" and got["bio_assignee_country"] == "DE"
    assert got["abstract_paras"] == ["A solar cell.", "More."] and got["description_paras"] == ["It is\xa0new."] and got["claims_claims"] == ["1. A cell."]
    assert all(got[s] for s in ("bio_ok", "abstract_ok", "description_ok", "claims_ok", "applicant_ok"))


def test_both_parsers_agree():
    whole = XML.replace("&nbsp;", "&#160;")
    fast, lenient = R.parse_well_formed(whole), R.parse_tree(whole)
    assert [(e.tag, e.text(), e.start, e.end) for e in fast.walk()] == [(e.tag, e.text(), e.start, e.end) for e in lenient.walk()]
    assert all([x.text() for x in e.find_all("country")] == [x.text() for x in e.walk() if x.tag == "country"] for e in fast.walk())
    for bad in (XML, "<a><b></a>", "", "text"):  # an entity that is not declared, a tag that is not closed, no element
        with pytest.raises((R.ElementTree.ParseError, ValueError)):
            R.parse_well_formed(bad)


def test_xml_parts_missing():
    bare = R.parse_xml("<?xml?><us-patent-grant><assignees><assignee><addressbook><orgname>X</orgname></addressbook></assignee></assignees></us-patent-grant>")
    assert not bare["bio_ok"] and not bare["abstract_ok"] and bare["abstract_paras"] is None and bare["bio_main-classification_ipc"] == ""
    assert "bio_assignee_name" not in bare  # an assignee without an address is none


@pytest.mark.parametrize("b300, applicant, date, country", [("", "US", "19990101", "US"), ("<B300><B320><DATE><PDAT>19980505</PDAT></DATE></B320><B330><CTRY><PDAT>JP</PDAT></CTRY></B330></B300>", "JP", "19980505", "US")])
def test_sgml(b300, applicant, date, country):
    got = R.parse_sgml(SGML.format(b300=b300, sdode=""))
    assert got["bio_doc-number"] == "06300001" and got["bio_application_date"] == date
    assert got["bio_applicant_country"] == got["bio_assignee_country"] == applicant and got["bio_country"] == country
    assert got["bio_main-classification_ipc"] == " H04L009 [7]" and got["bio_main-classification_national"] == "US 358 11"
    assert got["bio_inventor_last_name"] == got["bio_applicant_last_name"] == "Lee"
    assert got["abstract_paras"] == ["One."] and not got["description_ok"]  # a missing description is no end of the job


def lines(text):
    return "\n".join(x for x in text[text.index("PATN") :].split("\n") if x)


def test_text():
    got = R.parse_text(lines(TEXT.format(prir="")))
    assert got["bio_doc-number"] == "039300000" and got["bio_date"] == "19760106"
    assert (got["bio_applicant_first_name"], got["bio_inventor_last_name"]) == ("John", "Smith")
    assert got["bio_country"] == "US" and got["bio_applicant_country"] == "CHX" and got["bio_assignee_country"] == "DEX"
    assert got["bio_main-classification_national"] == "US 44589" and got["bio_main-classification_ipc"] == "B01D  1/00"
    assert got["abstract_paras"] == ["First", "more of it"] and got["description_paras"] == ["Rights", "The PATN mark in prose.", "1 2 3"]
    assert got["claims_claims"] == ["What is claimed is:", "1.", "1. A thing."] and got["description_ok"]


def test_text_priority_and_compat():
    got = R.parse_text(lines(TEXT.format(prir="PRIR\nCNT  JPX\n")))
    assert got["bio_applicant_country"] == got["bio_assignee_country"] == "JPX" and got["bio_country"] == "DEX"
    old = R.parse_text(lines(TEXT.format(prir="")), compat=True)
    assert old["claims_claims"] == [] and not old["description_ok"]  # the last section was lost


def test_text_name_without_semicolon_and_many_sections():
    got = R.parse_text("PATN\nWKU  1\nISD  19760101\nINVT\nNAM  Plato")
    assert got.get("bio_applicant_first_name") is None and not got["applicant_ok"]
    with pytest.raises(ValueError):
        R.parse_text("\n".join(["PATN", *["INVT"] * 250]))


def test_names_and_flattening():
    assert [R.next_name("NAM", {"NAM": 1}), R.next_name("NAM", {"NAM": 1, "NAM_i": 1})] == ["NAM_i", "NAM_ii"]
    assert R.flatten_values({"A": "x", "PAL": ["y", "z"]}) == ["x", "y", "z"] and R.flatten_values(None) == []


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "2010").mkdir()
    (tmp_path / "2010" / "a.xml").write_text(XML + "\n" + XML.replace("07654321", "07654322") + "\n")
    (tmp_path / "2010" / "b.xml").write_text(XML.replace("07654321", "07654323") + "\n<?xml broken")
    raw = R.scan_records(spark, str(tmp_path), R.XML_MARK, "*.xml")
    assert raw.count() == 4
    parsed = R.parse_records(raw, "xml")
    assert parsed.schema == PARSED
    assert sorted(r[0] for r in R.content(parsed).select("`bio_doc-number`").collect()) == ["07654321", "07654322", "07654323"]
    log = R.parse_log(parsed).collect()
    assert sum(r.parse_error is not None for r in log) == 1 and sum(r.bio_ok for r in log) == 3
    assert R.find_record(raw.unionByName(raw.selectExpr("file", "replace(record, '07654322', '07654329') || '07654322' AS record")), "07654322", "xml").count() == 1


def test_scan_cuts_white_space_at_the_end(spark, tmp_path):
    ends = ["", " ", "\n\n", " \t\x0b\f\r\n", "\xa0 ", " \x85", " \u2028", "\n\u2029", " \u2029\n", "\x85 \n"]
    (tmp_path / "a.xml").write_bytes(b"".join(f"{R.XML_MARK} {k}{end}".encode() for k, end in enumerate(ends)) + R.XML_MARK.encode() + b" 10\xff \n")
    got = [r.record for r in R.scan_records(spark, str(tmp_path), R.XML_MARK).orderBy("record").collect()]
    rule = spark.read.option("lineSep", R.XML_MARK).text(str(tmp_path)).where(r"value rlike r'\S'").selectExpr(rf"'{R.XML_MARK}' || regexp_replace(value, r'(?<!\s)\s+$', '') AS record")
    assert got == [r.record for r in rule.orderBy("record").collect()] and len(got) == len(ends) + 1


def test_scan_text(spark, tmp_path):
    data = (TEXT.format(prir="") + TEXT.format(prir="").split("\n", 1)[1].replace("039300000", "039300001")).encode() + b"PAR  bad \xff byte\n"
    (tmp_path / "pftaps.txt").write_bytes(data)
    (tmp_path / "bare.txt").write_text(TEXT.format(prir="").split("\n", 1)[1].replace("039300000", "039300002"))
    raw = R.scan_text_records(spark, str(tmp_path), "*.txt")
    got = R.content(R.parse_records(raw, "text")).select("`bio_doc-number`", "description_paras", "claims_claims").collect()
    assert sorted(r[0] for r in got) == ["039300000", "039300001", "039300002"]
    assert all("The PATN mark in prose." in r.description_paras for r in got)
    assert any(r.claims_claims[-1] == "bad  byte" for r in got)
    assert R.scan_text_records(spark, str(tmp_path), "pftaps.txt", compat=True).count() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "file string, record string")
    for kind in R.PARSERS:
        assert R.parse_records(empty, kind).count() == 0
    null = spark.createDataFrame([("f", None)], "file string, record string")
    assert R.parse_records(null, "xml").first().parse_error


ODD = [
    "<A><B>x</B>y</A>", "<A><B>x</A>", "<a><b>x</b></a>", "<A><B>&amp;&lt;&eacute;</B></A>", "<A><B>&#128;</B></A>", "<A><B>a\r\nb</B></A>", "<A><B/><C D='>'>t</C></A>", "<A><!-- <B>n</B> --><B>x</B></A>",
    "<A><B><![CDATA[x<C>]]></B></A>", "<A><?pi <B>n</B>?><B>x</B></A>", "<A><_B>x</_B></A>", "<!DOCTYPE A [\n<!ENTITY X SYSTEM 'x.tif'>\n<!ENTITY y 'why'>\n]>\n<A><B>x&y;</B></A>", "<!DOCTYPE A SYSTEM 'x.dtd'>\n<A>\n<B>x</B >\n</A>\n",
    "<A><A>in</A><B><A>x</A></B></A>", "<A><TITLE>a <B>b</B></TITLE><SCRIPT>c</SCRIPT></A>", "no tag", "", "<A>x</A><B>y</B>", "<A><B>x &AMP; y</B></A>", "<!DOCTYPE A [<!ENTITY x '<B>n</B>'>]><A>&x;</A>", "<A xmlns='u'><B>x</B></A>", "<A><B:C>x</B:C></A>",
]


@pytest.mark.parametrize("text", [*ODD, SGML.format(b300="", sdode="")])
def test_the_fast_tree_of_sgml_is_the_lenient_one(text):
    def seen(parse):
        try:
            root = parse(text)
        except ValueError as e:
            return str(e)
        tags = ["a", "b", "c", "title", "pdat", "b110", "patdoc", "_b", "b:c"]
        paths = [[root.find(t), root.find("b", t), root.find("a", t)] for t in tags]
        return [[None if e is None else e.text() for e in p] for p in paths], [[e.text() for e in root.find_all(t)] for t in tags], {k: e.text() for k, e in root.firsts().items()}

    assert seen(R.fast_sgml) == seen(R.parse_tree)


def test_common_records_take_the_fast_tree():
    assert isinstance(R.fast_sgml("<!DOCTYPE PATDOC SYSTEM 'x.dtd' [\n<!ENTITY X SYSTEM 'x.tif'>]>\n<PATDOC><A>x &amp; y</A></PATDOC>\n"), R._Node)
    assert isinstance(R.fast_xml(XML.replace("&nbsp;", " ")), R._Node) and not isinstance(R.fast_xml("<A><b>x</b></A>"), R._Node)


def test_the_fast_tree_of_xml_gives_the_same_record(monkeypatch):
    cases = [XML, XML.replace("&nbsp;", " "), XML.replace("&nbsp;", " ").replace("claim>", "CLAIM>")]
    fast = [R.parse_xml(x) for x in cases]
    monkeypatch.setattr(R, "fast_xml", R.parse_well_formed)
    assert fast == [R.parse_xml(x) for x in cases]


def test_lines_are_cut_at_their_ends(spark, tmp_path):
    ends = ["a \t", "  ", "b\r", "", "c \u2028", "d\x0b\x0c ", " e  f ", "\u0085", " \u2029", "\u00a0 ", "g"]
    (tmp_path / "x.txt").write_bytes(("PATN\n" + "\n".join(ends) + "\nPATN \n\nh  \n\n").encode())
    got = [r.record for r in R.scan_text_records(spark, str(tmp_path)).select("record").collect()]
    assert got == ["PATN\na\nb\nc\u2028\nd\n e  f\n\u0085\n\u2029\n\u00a0\ng", "PATN\nh"]
