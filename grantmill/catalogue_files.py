"""Further named queries: files, saved pages, archives and record fields, and whole stages, each with its SQL.

What a query reads it first writes: record archives, CSV files, workbooks, keyword
sheets, saved pages and zip files, made of the driver's tables.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalogue import V1, V2, Tables, _record_files, _record_rows, _sql_hits, _tagged_source, _text_source, query
from .functions import columns as C
from .operators import concordance, entities, hierarchy, relational, search
from .plans import stages
from .session import stored, work_path
from .sources import fetch, records, tables
from .streaming import incremental

# Record fields


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, written by the driver to the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


_XML = (
    '<?xml version="1.0"?><us-patent-grant><publication-reference><document-id><country>US</country><doc-number>{key}</doc-number><date>{date}</date></document-id></publication-reference>'
    "<application-reference><document-id><date>19900101</date></document-id></application-reference>"
    "<us-applicants><us-applicant><addressbook><last-name>{name}</last-name><first-name>Al</first-name><address><city>Bern</city><country>{land}</country></address></addressbook></us-applicant>"
    "<us-applicant><addressbook><last-name>Second</last-name></addressbook></us-applicant></us-applicants>"
    "<classifications-ipcr>(({ipcr}))<classification-ipcr><ipc-version-indicator><date>20060101</date></ipc-version-indicator><section>H</section><class>04</class><subclass>L</subclass><main-group>{code}</main-group><subgroup>20</subgroup>"
    "<symbol-position>F</symbol-position><classification-value>I</classification-value><action-date><date>{date}</date></action-date><generating-office><country>US</country></generating-office>"
    "<classification-status>B</classification-status><classification-data-source>H</classification-data-source></classification-ipcr></classifications-ipcr>"
    "<classifications-cpc><main-cpc><classification-cpc><cpc-version-indicator><date>20130101</date></cpc-version-indicator><section>G</section><class>06</class><subclass>F</subclass><main-group>1</main-group><subgroup>{code}</subgroup>"
    "<symbol-position>L</symbol-position><classification-value>A</classification-value><scheme-origination-code>C</scheme-origination-code></classification-cpc></main-cpc></classifications-cpc>"
    "<classification-locarno><edition>9</edition><main-classification>{code}</main-classification></classification-locarno>"
    "<description><heading>h</heading><p>one <i>{status}</i></p><p>two</p></description></us-patent-grant>"
).replace("{ipcr}", "<classification-ipcr><section>A</section><class>01</class><subclass>B</subclass><main-group>1</main-group><subgroup>00</subgroup></classification-ipcr>")


@query("""WITH r AS (SELECT *, o_orderkey % 400 AS code, strftime(o_orderdate, '%Y%m%d') AS d FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey::VARCHAR AS doc_number, '19900101' AS application_date, c_name AS applicant_last, 'Al' AS applicant_first, 'C' || c_nationkey AS applicant_country, 'Bern' AS applicant_city, true AS applicant_ok,
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'A01B 1/00 [None_None_None_None_None_None_None_None];' END || 'H04L ' || code || '/20 [20060101_F_I_' || d || '_US_B_H_None]' AS ipc,
'G06F 1/' || code || ' [20130101_L_A_None_None_None_None_C]' AS cpc, code || ' [9]' AS locarno, 'one ' || o_orderstatus || ';two' AS description FROM r""")
def xml_fields(t):
    df = records.parse_records(_tagged_source(t, _XML, records.XML_MARK), "xml")
    return df.select(
        F.col("`bio_doc-number`").alias("doc_number"), F.col("bio_application_date").alias("application_date"), F.col("bio_applicant_last_name").alias("applicant_last"), F.col("bio_applicant_first_name").alias("applicant_first"),
        F.col("bio_applicant_country").alias("applicant_country"), F.col("bio_applicant_city").alias("applicant_city"), "applicant_ok", F.col("`bio_main-classification_ipc`").alias("ipc"),
        F.col("`bio_main-classification_cpc`").alias("cpc"), F.col("`bio_main-classification_locarno`").alias("locarno"), F.array_join("description_paras", ";").alias("description"),
    )


@query("""SELECT o_orderkey::VARCHAR AS doc_number, CASE WHEN o_orderkey % 3 = 0 THEN '19890101' ELSE '19900101' END AS application_date, c_name AS applicant_last, 'Ann' AS applicant_first, 'Bern' AS applicant_city,
CASE WHEN o_orderkey % 3 = 0 THEN 'C' || c_nationkey ELSE 'US' END AS applicant_country, 'H04L ' || (o_orderkey % 400) || ' [7]' AS ipc, 'one ' || o_orderstatus || ';two' AS description FROM orders JOIN customer ON o_custkey = c_custkey""")
def sgml_fields(t):
    source = (
        "<!DOCTYPE PATDOC SYSTEM 'x.dtd'><PATDOC><SDOBI><B100><B110><DNUM><PDAT>{key}</PDAT></DNUM></B110><B140><DATE><PDAT>{date}</PDAT></DATE></B140><B190><PDAT>US</PDAT></B190></B100>"
        "<B200><B220><DATE><PDAT>19900101</PDAT></DATE></B220></B200>[[<B300><B320><DATE><PDAT>19890101</PDAT></DATE></B320><B330><CTRY><PDAT>{land}</PDAT></CTRY></B330></B300>]]"
        "<B500><B510><B511><PDAT>H04L {code}</PDAT></B511><B516><PDAT>7</PDAT></B516></B510></B500>"
        "<B720><B721><PARTY-US><NAM><FNM><PDAT>Ann</PDAT></FNM><SNM><STEXT><PDAT>{name}</PDAT></STEXT></SNM></NAM><ADR><CITY><PDAT>Bern</PDAT></CITY></ADR></PARTY-US></B721></B720></SDOBI>"
        "<SDODE><PARA><PTEXT><PDAT>one {status}</PDAT></PTEXT></PARA><PARA><PTEXT><PDAT>two</PDAT></PTEXT></PARA></SDODE></PATDOC>"
    )
    df = records.parse_records(_tagged_source(t, source, records.SGML_MARK), "sgml")
    return df.select(
        F.col("`bio_doc-number`").alias("doc_number"), F.col("bio_application_date").alias("application_date"), F.col("bio_applicant_last_name").alias("applicant_last"), F.col("bio_applicant_first_name").alias("applicant_first"),
        F.col("bio_applicant_city").alias("applicant_city"), F.col("bio_applicant_country").alias("applicant_country"), F.col("`bio_main-classification_ipc`").alias("ipc"), F.array_join("description_paras", ";").alias("description"),
    )


@query("""SELECT o_orderkey::VARCHAR AS doc_number, c_name AS applicant_last, 'Ann' AS applicant_first, 'Bern' AS applicant_city, '3000' AS applicant_zip, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'US' END AS applicant_country,
'H04L ' || (o_orderkey % 400) AS ipc, 'made by ' || o_orderstatus || ';part;one;drawn' AS description, true AS applicant_ok FROM orders JOIN customer ON o_custkey = c_custkey""")
def text_fields(t):
    source = (
        "PATN\nWKU  {key}\nAPD  19900101\nISD  {date}\nINVT\nNAM  {name}; Ann\nCTY  Bern\nZIP  3000\nCLAS\nOCL  1\nICL  H04L {code}\n"
        "GOVT\nPAL  made by {status}\nPARN\nPAR  part\nBSUM\nPA1  one\nDRWD\nPAC  drawn\n[[PRIR\nAPN  1\n]]CLMS\nPAR  1. A thing."
    )
    df = records.parse_records(_text_source(t, source), "text")
    return df.select(
        F.col("`bio_doc-number`").alias("doc_number"), F.col("bio_applicant_last_name").alias("applicant_last"), F.col("bio_applicant_first_name").alias("applicant_first"), F.col("bio_applicant_city").alias("applicant_city"),
        F.col("bio_applicant_zip").alias("applicant_zip"), F.col("bio_applicant_country").alias("applicant_country"), F.col("`bio_main-classification_ipc`").alias("ipc"), F.array_join("description_paras", ";").alias("description"), "applicant_ok",
    )


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'ValueError: 202 sections' END AS parse_error, count(*) AS n, count(CASE WHEN o_orderkey % 3 <> 0 THEN 1 END) AS numbered FROM orders GROUP BY 1""")
def failing_records(t):
    """Records with too many sections are rows with an error, the others are whole."""
    source = "PATN\nWKU  {key}\nISD  {date}\n[[" + "ABST\nPAL  x\n" * 199 + "DETD\nPAL  y\n]]CLMS\nPAR  1. A thing."
    df = records.parse_records(_text_source(t, source), "text")
    return df.groupBy("parse_error").agg(F.count(F.lit(1)).alias("n"), F.count("bio_doc-number").alias("numbered"))


@query("SELECT max(o_orderkey)::VARCHAR AS doc_number, 1::BIGINT AS found FROM orders")
def record_lookup(t):
    """The record that bears the last order's number; the next ones cite it."""
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    source = f"PATN\nWKU  {{key}}\nISD  {{date}}\nABST\nPAL  as in {last}\nCLMS\nPAR  1. A thing."
    found = records.find_record(_text_source(t, source), str(last), "text")
    return records.parse_records(found, "text").groupBy(F.col("`bio_doc-number`").alias("doc_number")).agg(F.count(F.lit(1)).alias("found"))


@query("SELECT strftime(o_orderdate, '%Y')::INT AS year, count(*) AS n, count(DISTINCT o_orderkey) AS numbers FROM orders GROUP BY 1")
def records_by_year(t):
    """Records of two formats in one table, written by year and read back for all years."""
    source = "PATN\nWKU  {key}\nISD  {date}\nABST\nPAL  x\nCLMS\nPAR  1."
    parsed = stages.parse_year_files(t.spark, [("text", _record_files(t, source), None)])
    path = work_path(t.spark, "years")
    tables.write_years(records.content(parsed), path)
    read = tables.read_years(t.spark, path, 1900, 2100)
    return read.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bio_doc-number").alias("numbers"))


@query("SELECT count(*) AS n, count(*) * 5 AS lines FROM orders")
def pretty_records(t):
    """Records written for reading, a line for each element."""
    path = work_path(t.spark, "pretty")
    source = '<?xml version="1.0"?><us-patent-grant><number>{key}</number><sections><p>{status}</p></sections></us-patent-grant>'
    records.write_records(_record_rows(t, source), path)
    lines = t.spark.read.text(path).where("trim(value) <> ''")
    return lines.agg(F.count_if(F.col("value").rlike("^  <number>[0-9]+</number>$")).alias("n"), (F.count(F.lit(1)) - F.count_if(F.col("value") == "  </sections>")).alias("lines"))


@query("SELECT strftime(o_orderdate, '%Y')::INT AS year, count(*) AS n, min(o_orderkey::VARCHAR) AS first FROM orders GROUP BY 1")
def json_route(t):
    """Records as JSON, then flat as CSV, then read."""
    source = "PATN\nWKU  {key}\nISD  {date}\nABST\nPAL  x\nCLMS\nPAR  1. A, \"quoted\" thing."
    path = work_path(t.spark, "route")
    flat = records.content(records.parse_records(_text_source(t, source), "text"))
    tables.write_json(flat, f"{path}/json")
    read = t.spark.read.schema(flat.schema).json(f"{path}/json")
    columns = {"bio_doc-number": "number", "year": "year", "claims_claims": "claims"}
    out = read.select(*(F.col(f"`{c}`").alias(n) for c, n in columns.items())).withColumn("claims", F.array_join("claims", ";"))
    out.write.option("header", "true").option("escape", '"').csv(f"{path}/csv")
    rows = tables.read_csv(t.spark, f"{path}/csv", StructType.fromDDL("number STRING, year INT, claims STRING"))
    return rows.where("claims LIKE '%\"quoted\"%'").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))


@query("SELECT doc_id, (strlen(text) // 1024)::INT AS kb FROM documents WHERE text IS NOT NULL")
def value_sizes(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", C.size_in_kb("text").alias("kb"))


# Files


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY 1")
def csv_scan(t):
    """Orders written as CSV beside a file with bad lines."""
    path = work_path(t.spark, "csv")
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate")).write.option("header", "true").csv(path)
    _put(t.spark, f"{path}/bad.csv", b"o_orderkey,o_orderstatus,o_totalprice,o_orderdate\n1,X,2,3,too,many\n")
    rows = tables.read_csv(t.spark, path, StructType.fromDDL("o_orderkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate STRING"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.substring(F.min("o_orderdate"), 1, 10).alias("first"))


@query("SELECT strftime(o_orderdate, '%Y')::INT AS year, count(*) AS count FROM orders GROUP BY 1")
def year_counts_file(t):
    path = work_path(t.spark, "meta")
    tables.write_meta(t.orders.withColumn("year", F.year("o_orderdate")), path)
    return tables.read_year_counts(t.spark, path)


@query("SELECT n_nationkey::BIGINT AS key, round(n_nationkey / 7, 4) AS share FROM nation UNION ALL SELECT r_regionkey, round(r_regionkey / 7, 4) FROM region")
def workbook(t):
    """Two tables as sheets of a real workbook, figures rounded."""
    path = f"{work_path(t.spark, 'book')}.xlsx"
    frames = [t.nation.select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") / 7).alias("share")), t.region.select(F.col("r_regionkey").alias("key"), (F.col("r_regionkey") / 7).alias("share"))]
    sheets = tables.write_workbook(frames, path, digits=4)
    schema = StructType.fromDDL("key LONG, share DOUBLE")
    return relational.union_all([tables.read_workbook(t.spark, path, s, schema) for s in sheets])


@query("SELECT r_name || '.csv' AS file_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def matching_files(t):
    """A file for each region, and a lock file that is left out."""
    path = work_path(t.spark, "files")
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.collect_list("n_name"), "\n").alias("lines")).collect()
    for r in rows:
        _put(t.spark, f"{path}/{r.r_name}.csv", f"n_name\n{r.lines}\n".encode())
    _put(t.spark, f"{path}/~lock.csv", b"n_name\nNOWHERE\n")
    return tables.read_matching(t.spark, f"{path}/*.csv", StructType.fromDDL("n_name STRING")).select(F.regexp_replace("file_name", "%20", " ").alias("file_name"), "n_name")


@query("SELECT c_custkey, c_name, c_mktsegment || '|' || c_nationkey AS tags FROM customer")
def json_round_trip(t):
    """Half of the rows as lines of JSON, half as one document."""
    path = work_path(t.spark, "json")
    df = t.customer.select("c_custkey", "c_name", F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))
    tables.write_json(df.where("c_custkey % 2 = 0"), f"{path}/lines")
    tables.write_json_document(df.where("c_custkey % 2 = 1"), f"{path}/one")
    both = t.spark.read.schema(df.schema).json(f"{path}/lines").unionByName(tables.read_json(t.spark, f"{path}/one", df.schema))
    return both.select("c_custkey", "c_name", F.array_join("tags", "|").alias("tags"))


@query("SELECT lower(n_name) AS keyword FROM nation")
def keyword_file(t):
    path = work_path(t.spark, "keywords")
    t.nation.select(F.concat(F.lit("  "), "n_name", F.lit(" \n"))).write.text(path)
    return tables.read_keywords(t.spark, path)


@query(f"SELECT doc_id, len({_sql_hits(V1)})::INT AS total_counts_v1, len({_sql_hits(V2)})::INT AS total_counts_v2 FROM documents")
def keyword_sheet(t):
    """A sheet of keyword groups, written and read, searched for in the texts."""
    path = work_path(t.spark, "sheet")
    cells = [(k, f"{a}\u00a0", b) for k, (a, b) in enumerate(zip(V1, V2))]
    tables.write_sheets({"keys": t.spark.createDataFrame(cells, "seq int, v1 string, v2 string").coalesce(1)}, path)
    sheet = tables.read_sheet(t.spark, path, "keys", StructType.fromDDL("seq INT, v1 STRING, v2 STRING"))
    groups = search.group_keywords(tables.keyword_groups(sheet, "seq"))
    return search.search(t.documents.withColumn("paras", F.array("text")), groups, sections=["paras"]).select("doc_id", "total_counts_v1", "total_counts_v2")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_name ELSE p_type || ' ' || p_brand || ')' END AS keyword FROM part""")
def cleaned_keywords(t):
    """Keywords with something in parentheses, nothing after them, none closed, and two of them."""
    forms = [F.col("p_name"), F.concat("p_name", F.lit(" (of "), "p_brand", F.lit(") "), "p_type"), F.concat("p_name", F.lit(" (open "), "p_brand"), F.concat("p_type", F.lit("(a (b) "), "p_brand", F.lit(")"))]
    return t.part.select("p_partkey", C.clean_keyword(F.element_at(F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("keyword"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_brand WHEN 2 THEN '' ELSE 'it''s ' || p_brand || '|1' END AS items FROM part""")
def literal_lists(t):
    brand, kind = F.col("p_brand"), F.col("p_type")
    texts = [F.concat(F.lit("['"), brand, F.lit("', \""), kind, F.lit("\"]")), F.concat(F.lit("('"), brand, F.lit("',)")), F.concat(F.lit("[oops "), brand), F.concat(F.lit("['it\\'s "), brand, F.lit("', 1]"))]
    text = F.element_at(F.array(*texts), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", F.array_join(tables.literal_list(text), "|").alias("items"))


# Saved pages and archives


@query("SELECT n_name || ' Patent Grant Full Text (Jan 1, ' || (1990 + n_nationkey) || ')' AS title, (1990 + n_nationkey)::VARCHAR AS year, 'http://x.example/' || n_nationkey AS parent_url FROM nation")
def index_years(t):
    link = F.concat(F.lit('<p><a class="l" href="http://x.example/'), F.col("n_nationkey").cast("string"), F.lit('">'), "n_name", F.lit(" <b>Patent Grant Full Text</b> (Jan 1, "), (F.col("n_nationkey") + 1990).cast("string"), F.lit(")</a> <a href='/'>other</a></p>"))
    pages = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("<html>"), F.array_join(F.collect_list(link), "\n")).alias("html"))
    return tables.archive_years(pages)


def _parents(t: Tables) -> DataFrame:
    """A page for each region with links to its nations' archives; region 0 has none."""
    link = F.concat(F.lit('<a href="'), "n_name", F.lit('.zip">'), "n_name", F.lit(".zip</a>"))
    html = F.when(F.col("n_regionkey") == 0, F.lit("<p>none</p>")).otherwise(F.array_join(F.array_sort(F.collect_list(link)), " "))
    return t.nation.groupBy("n_regionkey").agg(html.alias("html")).select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("title"), "html")


@query("""SELECT 'R' || n_regionkey AS title, CASE WHEN n_regionkey = 0 THEN '' ELSE string_agg(n_name || '.zip', '|' ORDER BY n_name) END AS file_url, n_regionkey <> 0 AS status, false AS all_done FROM nation GROUP BY n_regionkey""")
def archive_links(t):
    found = tables.archive_files(_parents(t))
    return found.crossJoin(tables.all_done(found)).withColumn("file_url", F.array_join("file_url", "|"))  # one row


@query("SELECT 'http://x.example/data/' || n_regionkey || '/' || n_name || '.zip' AS url, 'R' || n_regionkey AS title FROM nation WHERE n_nationkey % 3 = 0")
def failed_downloads(t):
    """Addresses built, statuses gathered by title, and those that failed."""
    url = tables.file_url(F.col("n_regionkey").cast("string"), F.concat("n_name", F.lit(".zip")), "http://x.example/data/")
    rows = t.nation.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("title"), url.alias("url"), (F.col("n_nationkey") % 3 != 0).alias("down_status"))
    return tables.failed_files(fetch.status_map(rows)).select("url", "title")


def _answers(url: str):
    """A stand-in for the network: every fifth address is missing, every seventh too short, others fail at first."""
    n = int(url.rsplit("/", 1)[1])
    if n % 5 == 0:
        raise OSError("no answer")
    return fetch.Answer(200, 5 if n % 7 == 0 else None, iter([b"x" * n, b"end"]))


@query("SELECT n_name AS title, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AS down_status, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 THEN 1 ELSE 6 END::INT AS tries, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 THEN n_nationkey + 3 ELSE 0 END::INT AS bytes FROM nation")
def downloads(t):
    wanted = t.nation.select(F.col("n_name").alias("title"), F.concat(F.lit("http://x.example/"), F.col("n_nationkey").cast("string")).alias("url"))
    got = fetch.fetch(wanted, _answers, tries=3, rounds=2, pause=0)
    return got.select("title", "down_status", "tries", F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes"))


@query("SELECT n_name AS title, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AS down_status, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 THEN n_nationkey + 3 ELSE 0 END::BIGINT AS bytes FROM nation")
def downloads_in_parts(t):
    """Contents that come in small parts, written as they come."""
    wanted = t.nation.select(F.col("n_name").alias("title"), F.concat(F.lit("http://x.example/"), F.col("n_nationkey").cast("string")).alias("url"))
    parts = stored(fetch.fetch_parts(wanted, _answers, tries=3, rounds=2, pause=0, part_bytes=2), "parts")
    sizes = fetch.whole_parts(parts).groupBy("url").agg(F.sum(F.octet_length("content")).alias("bytes"))
    return parts.where("down_status IS NOT NULL").join(sizes, "url", "left").select("title", "down_status", F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query("SELECT r_name AS folder, n_name || '.txt' AS member, n_nationkey || ' ' || n_name AS text, true AS unzip_status FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'broken', NULL, NULL, false")
def unpacked_archives(t):
    """Zip files, one of them broken, listed and unpacked by a stream that runs twice."""
    path = work_path(t.spark, "zips")
    for r in t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("own")).collect():
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for n in r.own:
                z.writestr(f"{n.n_name}.txt", f"{n.n_nationkey} {n.n_name}")
        _put(t.spark, f"{path}/raw/2000/{r.r_name}.a.zip", held.getvalue())
    _put(t.spark, f"{path}/raw/2001/broken.zip", b"PK no archive")
    for _ in range(2):
        incremental.unpack_available(t.spark, f"{path}/raw", f"{path}/out", f"{path}/checkpoint")
    folders = tables.zip_inventory(t.spark, f"{path}/raw").select(F.col("zip_file").alias("path"), F.regexp_replace("out_folder", "%20", " ").alias("folder"))
    out = t.spark.read.parquet(f"{path}/out")
    return out.join(folders, "path").select("folder", "member", "text", "unzip_status")


@query("SELECT r_regionkey::VARCHAR AS class_id, r_name AS title FROM region")
def class_index(t):
    cell = F.concat(F.lit('<tr><td valign="top" width="27">'), F.col("r_regionkey").cast("string"), F.lit("</td><td><a href='#'>"), "r_name", F.lit("</a></td></tr>"))
    page = t.region.agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(cell), ""), F.lit("<tr><td>x</td><td>y</td></tr></table>")).alias("html"))
    return tables.class_list(page).select("class_id", "title")


_SCHEDULE = """WITH RECURSIVE s AS (SELECT n_regionkey AS cat, n_nationkey AS seq, n_nationkey % 3 AS level, CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE '1' || n_nationkey END AS raw, n_name AS name FROM nation),
d AS (SELECT *, row_number() OVER (PARTITION BY cat, raw ORDER BY seq) > 1 AS dup FROM s),
r AS (SELECT *, sum(CASE WHEN dup THEN 0 ELSE 1 END) OVER (PARTITION BY cat ORDER BY seq) AS run FROM d),
c AS (SELECT *, first_value(raw) OVER (PARTITION BY cat, run ORDER BY seq) || repeat('_next', (row_number() OVER (PARTITION BY cat, run ORDER BY seq) - 1)::INT) AS code FROM r),
p AS (SELECT *, (SELECT max(q.seq) FROM c q WHERE q.cat = c.cat AND q.seq < c.seq AND q.level < c.level) AS up FROM c),
t AS (SELECT p.cat, p.seq, p.code, r_name || '||' || p.name AS path FROM p JOIN region ON r_regionkey = p.cat WHERE up IS NULL UNION ALL SELECT p.cat, p.seq, p.code, t.path || '||' || p.name FROM p JOIN t ON p.cat = t.cat AND p.up = t.seq)"""


def _schedules(t: Tables) -> DataFrame:
    """Rows of class schedules, read from saved pages, a page for each region."""
    code = F.when(F.col("n_nationkey") % 4 == 3, "").otherwise(F.concat(F.lit("1."), F.col("n_nationkey").cast("string")))
    level = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit('<img src="d" alt="'), (F.col("n_nationkey") % 3).cast("string"), F.lit('">')))
    row = F.concat(F.lit("<tr><td>"), code, F.lit("</td><td>"), level, F.lit('</td><td class="SubTtl">'), "n_name", F.lit("</td></tr>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "")
    pages = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("<table><tr><td>other</td><td>1</td></tr></table><table>"), lines, F.lit("</table>")).alias("html"))
    return tables.schedule_rows(pages.select(F.lpad(F.col("n_regionkey").cast("string"), 3, "0").alias("cat_id"), "html"))


def _titles(t: Tables) -> DataFrame:
    return t.region.select(F.lpad(F.col("r_regionkey").cast("string"), 3, "0").alias("cat_id"), F.col("r_name").alias("cat_name"))


@query(f"{_SCHEDULE} SELECT lpad(cat::VARCHAR, 3, '0') AS cat_id, code, path FROM t")
def class_trees(t):
    """Schedules scraped, codes made unique, trees built under their class's title."""
    tree = hierarchy.class_tree(_schedules(t), _titles(t))
    return tree.where(F.col("code") != hierarchy.ROOT).select("cat_id", "code", F.concat_ws("||", "ancestor_names").alias("path"))


@query(f"""{_SCHEDULE}, w AS (SELECT t.cat, t.code AS top, u.code FROM t JOIN t u ON u.cat = t.cat AND (u.path = t.path OR starts_with(u.path, t.path || '||')))
SELECT 1::INT AS seq, 'wide' AS topic_des, lpad(cat::VARCHAR, 3, '0') || '/' || code AS pattern FROM w WHERE cat = 1 AND top = '11' UNION SELECT 2, 'list', '002/18' UNION SELECT 2, 'list', '002/' || code FROM w WHERE cat = 2 AND top = '112' UNION SELECT 2, 'list', '002/112' UNION SELECT 3, 'class', '004'""")
def expanded_patterns(t):
    """Patterns with descendants of a filled tree."""
    tree = stored(hierarchy.class_tree(_schedules(t), _titles(t)), "tree")
    rows = t.spark.createDataFrame([(1, "wide", "1/1.1+"), (2, "list", "2/1.8,1.12+"), (3, "class", "4")], "seq int, topic_des string, USPC string")
    return concordance.expand_patterns(rows, tree)


@query("SELECT n_regionkey || ' ' || substr(n_name, 1, 1) || '1' AS ipc_code, arg_max(n_name, n_nationkey) AS name FROM nation GROUP BY 1")
def code_concordance(t):
    """A concordance table of a saved page; of a code's rows the last counts."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_regionkey").cast("string"), F.lit("</td><td>"), F.substring("n_name", 1, 1), F.lit(" 1</td><td>"), "n_name", F.lit("</td></tr>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "")
    page = t.nation.agg(F.concat(F.lit("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr>"), lines, F.lit("</table>")).alias("html"))
    return tables.code_map(tables.html_table(page))


@query("SELECT n_nationkey::VARCHAR AS \"Code\", n_name AS \"Topic\" FROM nation")
def table_with_header(t):
    """The second table of a page; its first row names the columns."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), "n_name", F.lit("</td></tr>"))
    page = t.nation.agg(F.concat(F.lit("<table><tr><td>no</td></tr></table><table><tr><th>Code</th><th>Topic</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return tables.with_header(tables.html_table(page, 1), 2).drop("row")


@query("""SELECT c_custkey, CASE WHEN n_nationkey IS NOT NULL THEN r_name || '||' || n_name || ';part' END AS ipc_label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 3 LEFT JOIN region ON n_regionkey = r_regionkey""")
def ipc_labels(t):
    """Symbols labelled by a scheme in XML; symbols it lacks have no label."""
    entry = F.concat(F.lit('<ipcEntry symbol="N'), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit('0000000000"><textBody><title><titlePart><text>'), "n_name", F.lit("</text></titlePart><titlePart><text>part</text></titlePart></title></textBody></ipcEntry>"))
    region = F.concat(F.lit('<ipcEntry symbol="R'), F.col("r_regionkey").cast("string"), F.lit('"><textBody><title><titlePart><text>'), "r_name", F.lit("</text></titlePart></title></textBody>"), F.array_join(F.collect_list(entry), ""), F.lit("</ipcEntry>"))
    rows = t.nation.where("n_regionkey <> 3").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(region.alias("x")).collect()
    nodes = hierarchy.ipc_nodes("<ipc>" + "".join(r.x for r in rows) + "</ipc>")
    df = t.spark.createDataFrame(nodes, "code string, name string, parent_code string").withColumn("cat_id", F.lit("ipc"))
    tree = hierarchy.closure(df).select(F.col("code").alias("symbol"), F.col("ancestor_names").alias("ancestor_titles"))
    raw = F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit(" "), F.lit("0/0 [x];"))
    return hierarchy.label_ipc(t.customer.select("c_custkey", raw.alias("raw")), "raw", tree).select("c_custkey", "ipc_label")


# Streams


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY ALL""")
def windowed_stream(t):
    """Windows that the watermark has closed, appended by a stream; rows that come later are dropped."""
    path = work_path(t.spark, "windows")
    day = F.date_format(F.to_utc_timestamp("w.start", F.current_timezone()), "yyyy-MM-dd")
    flat = lambda s: incremental.windowed_counts(s).select(day.alias("day"), "event_type", "n", F.round("v", 2).alias("total"))
    utc = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")).cast("timestamp")
    events = t.events.withColumn("ts", utc)
    late = events.join(events.agg(F.min("ts").alias("_first")), F.col("ts") == F.col("_first")).drop("_first")
    for rows in (events, late):
        rows.write.mode("append").parquet(f"{path}/source")
        incremental.run_available(incremental.stream_parquet(t.spark, f"{path}/source", events.schema), f"{path}/table", f"{path}/checkpoint", flat)
    return t.spark.read.parquet(f"{path}/table")


# Stages


def _assigned(t: Tables) -> DataFrame:
    """Records with their assignment: suppliers are assignees, orders documents."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    assignees = t.supplier.select(F.col("s_suppkey").alias("rf_id"), F.col("s_name").alias("ee_name"), text("N", "s_nationkey").alias("ee_country"))
    number = F.when(F.col("o_orderkey") % 11 == 0, "nan").otherwise(F.concat(F.lit("00"), F.col("o_orderkey").cast("string"), F.lit(".0")))
    n = t.supplier.count()
    documents = t.orders.select((F.col("o_orderkey") % (2 * n) + 1).alias("rf_id"), number.alias("grant_doc_num"))
    countries = t.nation.where("n_nationkey % 4 <> 1").select(text("N", "n_nationkey").alias("raw_country_name"), F.col("n_name").alias("Country_Name_Fix"), F.substring("n_name", 1, 2).alias("2_Code_Fix"), F.substring("n_name", 1, 3).alias("3_Code_Fix"))
    mapped = stages.assignee_map(assignees, documents, countries)
    grants = t.orders.select(
        F.concat(F.lit("0"), F.col("o_orderkey").cast("string")).alias("bio_doc-number"), F.date_format("o_orderdate", "yyyyMMdd").alias("bio_date"), F.when(F.col("o_orderkey") % 13 != 0, "19900101").alias("bio_application_date"),
        F.when(F.col("o_orderkey") % 2 == 0, "OWN").alias("bio_assignee_name"), F.lit("Own Land").alias("Country_Name"), F.lit("OL").alias("2_Code"), F.lit("OLD").alias("3_Code"),
        F.when(F.col("o_orderkey") % 7 == 0, "EXX").alias("bio_assignee_country"), F.when(F.col("o_orderkey") % 5 == 0, "FR").alias("bio_applicant_country"), F.lit("DE").alias("bio_country"),
        F.when(F.col("o_orderkey") % 17 == 0, stages.EXCLUDED).alias("est_description"), F.lit("long text").alias("abstract_paras"),
    )
    return stages.attach_assignees(grants, mapped)


_ASSIGNED = """WITH d AS (SELECT o_orderkey AS k, s_name AS ee, s_nationkey AS land FROM orders JOIN supplier ON s_suppkey = o_orderkey % (2 * (SELECT count(*) FROM supplier)) + 1 WHERE o_orderkey % 11 <> 0),
a AS (SELECT o_orderkey AS k, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'OWN' END AS own, ee, n_name AS fix, land FROM orders LEFT JOIN d ON d.k = o_orderkey LEFT JOIN nation ON n_nationkey = land AND n_nationkey % 4 <> 1),
r AS (SELECT *, own IS NULL AND fix IS NOT NULL AND length('N' || land) > 1 AS use_fix FROM a)"""


@query(f"{_ASSIGNED} SELECT CASE WHEN k = 0 THEN '' ELSE k::VARCHAR END AS doc, coalesce(own, ee) AS assignee, CASE WHEN use_fix THEN fix ELSE 'Own Land' END AS country, CASE WHEN use_fix THEN fix[1:2] ELSE 'OL' END AS code2, CASE WHEN use_fix THEN fix[1:3] ELSE 'OLD' END AS code3 FROM r")
def assignee_stage(t):
    df = _assigned(t)
    return df.select(C.normalise_doc_id("`bio_doc-number`").alias("doc"), F.col("bio_assignee_name").alias("assignee"), F.col("Country_Name").alias("country"), F.col("2_Code").alias("code2"), F.col("3_Code").alias("code3"))


@query(f"""{_ASSIGNED} SELECT strftime(o_orderdate, '%Y')::INT AS year, 1990::INT AS application_year, CASE WHEN k % 7 = 0 THEN 'EX' WHEN k % 5 = 0 THEN 'FR' ELSE 'DE' END AS country,
CASE WHEN ee IS NOT NULL AND right(ee, 1) = '1' THEN 'FINAL ONE' ELSE coalesce(own, ee) END AS final_name, count(*) AS n FROM r WHERE k % 13 <> 0 AND k % 17 <> 0 GROUP BY ALL""")
def final_stage(t):
    """Small records with their final names: texts dropped, years and countries derived, one category left out."""
    small = relational.keep_small(_assigned(t), ("abstract_paras",))
    names = t.supplier.where("right(s_name, 1) = '1'").select(F.col("s_name").alias("names"), F.lit("FINAL ONE").alias("Final_Names"))
    final = stages.final_table(small, names)
    if "abstract_paras" in final.columns:
        raise AssertionError("texts are to be dropped")
    return final.groupBy("year", "application_year", F.col("bio_assignee_country").alias("country"), F.col("final_ee_name").alias("final_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y')::INT AS year, o_orderkey % 5 AS total_counts, o_orderkey % 5 > 0 AS count_binary FROM orders")
def simple_columns(t):
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("bio_date"), (F.col("o_orderkey") % 5).alias("total_counts_v9"))
    return relational.keep_simple(df, ["o_orderkey"], "total_counts_v9")


@query("SELECT o_orderpriority AS p, count(*) AS total_counts_count, sum(o_orderkey % 5)::BIGINT AS total_counts_sum FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def summary_with_transform(t):
    df = t.orders.withColumns({"total_counts": (F.col("o_orderkey") % 5).cast("long"), "p": F.col("o_orderpriority")})
    return stages.summarise(df, ["p"], lambda x: x.where("o_orderstatus = 'O'"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def without_national(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, "US 1").alias("bio_main-classification_national"), F.when(F.col("o_orderkey") % 2 == 0, "H04L").alias("bio_main-classification_ipc"))
    return relational.without_national(df).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_match(t):
    return relational.first_where(t.orders, "o_totalprice > 100000", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name || '|' || c_nationkey || '|' || c_mktsegment || '|' || c_name AS flat FROM customer")
def flattened(t):
    nested = F.array(F.array(F.array("c_name", F.col("c_nationkey").cast("string")), F.array("c_mktsegment")), F.array(F.array("c_name")), F.lit(None).cast("array<array<string>>"))
    return t.customer.select("c_custkey", F.array_join(C.flatten_all(nested, 3), "|").alias("flat"))


@query("SELECT p_brand FROM part")
def one_field(t):
    return t.part.select("p_brand")


# Names


_COMMON = """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x, length(p_name) % 5 AS c FROM part),
p AS (SELECT a.c, a.x AS a, b.x AS b FROM n a JOIN n b ON a.c = b.c AND a.x < b.x),
s AS (SELECT c, a, b, i, l FROM p, range(1, 60) u(i), range(1, 60) v(l) WHERE i + l - 1 <= length(a) AND contains(b, substr(a, i, l))),
m AS (SELECT c, a, b, substr(a, arg_min(i, i - l * 1000), max(l)) AS t FROM s GROUP BY c, a, b),
k AS (SELECT c, trim(t) AS t, count(*) AS n, min(a || chr(1) || b) AS seen FROM m GROUP BY c, trim(t)),
w AS (SELECT c, string_agg(t, ';' ORDER BY seen) AS std FROM (SELECT *, max(n) OVER (PARTITION BY c) AS top FROM k) WHERE n = top GROUP BY c)"""


@query(f"{_COMMON} SELECT n.x AS CompanyName, n.c::INT AS cluster, coalesce(w.std, (SELECT min(x) FROM n q WHERE q.c = n.c)) AS StandardName FROM n LEFT JOIN w ON w.c = n.c")
def common_names(t):
    """What the names of a cluster share, clusters being given."""
    clusters = t.part.select(F.col("p_name").alias("CompanyName"), (F.length("p_name") % 5).cast("int").alias("cluster")).distinct()
    return entities.standard_names(clusters)


@query("SELECT n * (n - 1) // 2 AS pairs, true AS in_range, true AS same_words_alike FROM (SELECT count(DISTINCT p_name) AS n FROM part)")
def similarity_laws(t):
    """Every pair once, from 0 to 100; names of the same words are wholly alike by words."""
    found = entities.pair_similarity(t.part, "p_name")
    words = lambda c: F.array_sort(F.split(c, " "))
    alike = F.bool_and((words("a") != words("b")) | (F.col("sim") > 60))
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.bool_and(F.col("sim").between(0, 100.001)).alias("in_range"), alike.alias("same_words_alike"))


@query("SELECT count(DISTINCT p_name) AS names, true AS numbered, true AS settled FROM part")
def cluster_laws(t):
    """Every name in one cluster, numbers without gaps, clusters the same when made again from pairs in another order."""
    pairs = stored(entities.pair_similarity(t.part, "p_name"), "pairs")
    one, two = entities.cluster_names(pairs), entities.cluster_names(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim").repartition(3))
    both = one.join(two.withColumnRenamed("cluster", "again"), "CompanyName", "full")
    return both.agg(F.count_distinct("CompanyName").alias("names"), (F.max("cluster") + 1 == F.count_distinct("cluster")).alias("numbered"), F.bool_and(F.col("cluster") == F.col("again")).alias("settled"))


@query("SELECT upper(p_name) AS names, count(*) AS count, count(*) > 20 AS clustered FROM part GROUP BY 1")
def resolution(t):
    """Names with their counts; those more frequent than the threshold, and only those, have a cluster and a standard name."""
    found = entities.resolve(stored(relational.value_counts(t.part.withColumn("names", F.upper("p_name")), "names"), "names"))
    return found.select("names", "count", (F.col("cluster").isNotNull() & F.col("StandardName").isNotNull()).alias("clustered"))
