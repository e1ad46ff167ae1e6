"""Named queries over tables that runs replace year by year, real workbooks, crawls and nested records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalogue import _RECORDS, V1, V2, _record_files, _sql_hits, _text_source, query
from .functions import columns as C
from .functions import sql
from .operators import automaton, concordance, hierarchy, nested, qgrams, relational
from .session import work_path
from .sources import offsets, records, tables
from .sources.crawl import Crawl
from .sources.yearlog import YearLog

# Years


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, year(o_orderdate)::INT AS year FROM orders)
SELECT year, count(*) AS n, round(sum(CASE WHEN year = 1997 THEN -o_totalprice ELSE o_totalprice END), 2) AS total, 2::BIGINT AS version FROM o WHERE year <> 1999 GROUP BY year""")
def year_log(t):
    """All years of orders; 1997 run again with other values, 1998 with what fails half-way, 1999 with no rows."""
    log = YearLog(t.spark, work_path(t.spark, "year-log"))
    orders = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    log.write(orders, writer=("first", 1))
    log.write(orders.withColumn("o_totalprice", -F.col("o_totalprice")), writer=("first", 1))  # the same run once more: nothing happens
    log.write(orders.where("year = 1997").withColumn("o_totalprice", -F.col("o_totalprice")))
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    broken = orders.where(F.col("year").between(1996, 1998) | (F.col("o_orderkey") == last)).withColumn("o_totalprice", F.when(F.col("o_orderkey") == last, F.raise_error(F.lit("a broken record")).cast("double")).otherwise(0.0))
    try:
        log.write(broken.repartition(8))
        raise AssertionError("the run was to fail")
    except Exception as e:
        if "a broken record" not in str(e):
            raise
    log.write(orders.where("year = 1999 AND o_orderkey < 0"), covers=[1999])
    found = log.read().groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return found.withColumn("version", F.lit(log.manifest().version).cast("long"))


@query("""SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1""")
def year_log_as_of(t):
    """Years 1996 to 1998 as they were before a run that has replaced them."""
    log = YearLog(t.spark, work_path(t.spark, "year-log"))
    orders = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    first = log.write(orders)
    log.write(orders.withColumn("o_totalprice", F.lit(0.0)))
    return log.read(1996, 1999, first.version).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# Workbooks


def _three_sheets(t) -> str:
    path = f"{work_path(t.spark, 'book')}.xlsx"
    frames = {"nations": t.nation, "suppliers": t.supplier, "customers": t.customer}
    tables.write_workbook(frames, path)
    return path


@query("""SELECT 'nation' AS kind, n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::BIGINT AS place, NULL::DOUBLE AS balance FROM nation
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey, round(c_acctbal, 2) FROM customer""")
def workbook_sheets(t):
    """Three tables written to one workbook and read by the names of its sheets."""
    path = _three_sheets(t)
    read = lambda sheet, schema: tables.read_workbook(t.spark, path, sheet, StructType.fromDDL(schema))
    nation = read("nations", "n_nationkey LONG, n_name STRING, n_regionkey LONG").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("place"), F.lit(None).cast("double").alias("balance"))
    rest = []
    for sheet, kind, p in (("suppliers", "supplier", "s"), ("customers", "customer", "c")):
        key = f"{p}_{kind[:4]}key"
        own = read(sheet, f"{key} LONG, {p}_name STRING, {p}_nationkey LONG, {p}_acctbal DOUBLE")
        rest.append(own.select(F.lit(kind), key, f"{p}_name", f"{p}_nationkey", F.round(f"{p}_acctbal", 2)))
    return nation.union(rest[0]).union(rest[1])


@query("""SELECT 'R' || n_regionkey || '.xlsx' AS file, 'Sheet1' AS sheet, n_nationkey::BIGINT AS key, n_name AS name FROM nation UNION ALL SELECT 'all.xlsx', 'Sheet2', r_regionkey, r_name FROM region UNION ALL SELECT 'all.xlsx', 'Sheet1', 0, 'x'""")
def workbooks_by_pattern(t):
    """A workbook for each region and one of two sheets, read by a pattern; a lock file is left out."""
    folder = work_path(t.spark, "books")
    nations = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    keys = sorted(r[0] for r in t.region.select("r_regionkey").collect())
    for k in keys:
        tables.write_workbook([nations.where(F.col("n_regionkey") == k).drop("n_regionkey")], f"{folder}/R{k}.xlsx")
    tables.write_workbook([t.region.limit(1).select(F.lit(0).alias("key"), F.lit("x").alias("name")), t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))], f"{folder}/all.xlsx")
    tables.write_workbook([nations.drop("n_regionkey")], f"{folder}/~$all.xlsx")
    rows = tables.read_workbook(t.spark, f"{folder}/*.xlsx", "*", StructType.fromDDL("file STRING, sheet STRING, key LONG, name STRING"), file="file", sheet_column="sheet")
    return rows


# Crawls


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
e AS (SELECT DISTINCT page_id AS a, (length(h) * 31 + unicode(h[2])) % n AS b FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]+)"', 1)) AS h FROM pages) CROSS JOIN n WHERE page_id % 13 <> 5),
r AS (SELECT page_id AS p, 0 AS depth FROM pages WHERE page_id % 97 = 3 UNION SELECT b, depth + 1 FROM r JOIN e ON p = a WHERE depth < 40)
SELECT 'http://site.example/' || p AS url, min(depth)::INT AS depth, p % 13 <> 5 AS ok, CASE WHEN p % 13 = 5 THEN 3 WHEN p % 7 = 2 THEN 2 ELSE 1 END::INT AS tries FROM r GROUP BY p""")
def crawl(t):
    """Pages reached from several starts over the links of all pages; each seventh answers at the second try, each thirteenth never."""
    n = t.pages.count()
    number = F.regexp_extract("url", r"([0-9]+)$", 1).cast("long")
    site = t.pages.select(F.concat(F.lit("http://site.example/"), F.col("page_id").cast("string")).alias("url"), "html")

    def get(wanted: DataFrame, attempt: int) -> DataFrame:
        answers = (number % 13 != 5) & ((number % 7 != 2) | F.lit(attempt > 1))
        return site.join(wanted, "url", "left_semi").select("url", answers.alias("ok"), F.when(answers, F.col("html")).alias("html"))

    def links(fetched: DataFrame) -> DataFrame:
        to = (F.char_length("href") * 31 + F.ascii(F.substring("href", 2, 1))) % n
        return anchors_of(fetched).select("url", F.concat(F.lit("http://site.example/"), to.cast("string")).alias("to"))

    def anchors_of(fetched: DataFrame) -> DataFrame:
        return tables.anchors(fetched.select("url", "html")).where("href LIKE '/_%'")

    starts = site.where(number % 97 == 3).select("url")
    found = Crawl(t.spark, work_path(t.spark, "crawl"), get, links).run(starts)
    return found.select("url", "depth", "ok", "tries")


# Nested records


@query("""SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 2 = 0 THEN 'k' || o_orderkey END AS order_keyi, o_orderstatus AS order_status, c_name AS customer_name, CASE WHEN o_orderkey % 5 <> 0 THEN n_name END AS customer_place_nation,
CASE WHEN o_orderkey % 5 = 0 THEN 'nowhere' END AS customer_place, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 100 ELSE -1 END AS "sums_F", CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 100 ELSE -1 END AS "sums_O", CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 100 ELSE -1 END AS "sums_P",
coalesce(lines, '') AS lines_keys, coalesce(n_lines, 0)::INT AS n_lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey, '|' ORDER BY l_linenumber, l_partkey) AS lines, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def nested_records(t):
    """Orders as JSON with their customers and lines, keys varying from row to row, one key an object here and a text there; flat again."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t.orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    far = F.col("o_orderkey") % 5 == 0
    place = F.when(far, F.to_json(F.struct(F.lit("nowhere").alias("place")))).otherwise(F.to_json(F.struct(F.struct(F.col("n_name").alias("nation")).alias("place"))))
    text = F.concat(
        F.lit('{"order":'), F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))),
        F.lit(',"customer":{"name":"'), "c_name", F.lit('",'), F.substr(place, F.lit(2)),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(',"order_key":"k'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise(""),
        F.lit(',"sums":{"'), "o_orderstatus", F.lit('":'), (F.col("o_orderkey") % 100).cast("string"), F.lit("}"),
        F.when(F.col("l").isNotNull(), F.concat(F.lit(',"lines":{"keys":'), F.to_json(F.transform("l", lambda x: x["l_partkey"])), F.lit(',"whole":'), F.to_json("l"), F.lit("}"))).otherwise(""), F.lit("}"),
    )
    flat = nested.flatten_json(rows.select(text.alias("record")), "record", bad="broken").where("broken IS NULL")
    count = F.coalesce(F.json_array_length("lines_whole"), F.lit(0)).alias("n_lines")
    return flat.select("order_key", "order_keyi", "order_status", "customer_name", "customer_place_nation", "customer_place", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("sums_F", "sums_O", "sums_P")), F.coalesce(F.array_join("lines_keys", "|"), F.lit("")).alias("lines_keys"), count)


# Keywords by the thousand

_WORD = r"(?:[A-Za-z0-9_]|[^\x00-\x7F\p{P}\p{S}\p{Z}])+"


@query(rf"""WITH k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(concat_ws(' ', p_name, p_brand, p_type), '\w+'))) AS keyword FROM part),
x AS (SELECT text FROM documents UNION ALL SELECT concat_ws(' ', p_name, p_brand, p_type) FROM part),
w AS (SELECT row_number() OVER () AS id, regexp_extract_all(text, '{_WORD}') AS words FROM x)
SELECT keyword, count(*) AS n, count(DISTINCT id) AS texts FROM k JOIN (SELECT id, lower(unnest(words)) AS word FROM w) ON word = keyword GROUP BY keyword""")
def keyword_automaton(t):
    """Every different word of the parts as a keyword, in all documents and parts."""
    named = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    words = t.part.select(F.explode(F.regexp_extract_all(F.lower(named), F.lit(r"\w+"), F.lit(0))).alias("w")).distinct()
    keywords = [r.w for r in words.orderBy("w").collect()]  # a keyword list
    return automaton.keyword_counts(t.documents.select("text").unionByName(t.part.select(named.alias("text"))), "text", keywords)


@query(f"SELECT doc_id, len({_sql_hits(V1)})::BIGINT AS total_v1, len({_sql_hits(V2)})::BIGINT AS total_v2, array_to_string(list_sort({_sql_hits(V1)}), ',') AS hits_v1, array_to_string({_sql_hits(V2)}, ',') AS in_order_v2 FROM documents")
def keyword_hits_automaton(t):
    """The keyword lists of keyword_hits, by automata."""
    docs = t.documents.withColumn("glued", C.glue_sections(F.array("text")))
    found = automaton.find(automaton.find(docs, "glued", V1, "one"), "glued", V2, "two")
    one, two = automaton.surfaces("one", "glued"), automaton.surfaces("two", "glued")
    return found.select("doc_id", F.size("one").cast("long").alias("total_v1"), F.size("two").cast("long").alias("total_v2"), F.array_join(F.array_sort(one), ",").alias("hits_v1"), F.array_join(two, ",").alias("in_order_v2"))


# Names within an edit distance


@query("""WITH n AS (SELECT DISTINCT c_name AS x FROM customer UNION SELECT s_name FROM supplier)
SELECT a.x AS a, b.x AS b, levenshtein(a.x, b.x)::BIGINT AS distance FROM n a JOIN n b ON a.x < b.x AND abs(length(a.x) - length(b.x)) <= 1 WHERE levenshtein(a.x, b.x) <= 1""")
def similar_names(t):
    """All names of customers and suppliers that one edit tells apart."""
    return qgrams.edit_join(t.customer.select(F.col("c_name").alias("name")).union(t.supplier.select("s_name")), "name", 1)


@query("""WITH c AS (SELECT DISTINCT lower(c_mktsegment) || ' ' || ltrim(substr(c_name, 10), '0') AS x FROM customer), s AS (SELECT DISTINCT 'machine ' || ltrim(substr(s_name, 10), '0') AS x FROM supplier)
SELECT c.x AS a, s.x AS b, levenshtein(c.x, s.x)::BIGINT AS distance FROM c JOIN s ON abs(length(c.x) - length(s.x)) <= 3 WHERE levenshtein(c.x, s.x) <= 3""")
def names_of_two_tables(t):
    """Names of customers and of suppliers that up to three edits tell apart."""
    number = lambda c: F.ltrim(F.substring(c, 10, 99), F.lit("0"))
    customers = t.customer.select(F.concat(F.lower("c_mktsegment"), F.lit(" "), number("c_name")).alias("name"))
    return qgrams.edit_join(customers, "name", 3, t.supplier.select(F.concat(F.lit("machine "), number("s_name")).alias("name")))


# Hierarchies of any size

_LINES = "SELECT l_orderkey::BIGINT * 1000000000 + l_partkey * 10000 + l_linenumber * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY l_suppkey, l_extendedprice, l_quantity) AS seq, (l_quantity::INT * 7 + l_linenumber) % 9 AS level FROM lineitem"


@query(f"""WITH l AS ({_LINES}), p AS (SELECT *, {", ".join(f"max(CASE WHEN level < {k} THEN seq END) OVER w AS p{k}" for k in range(1, 9))} FROM l WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, (CASE level {" ".join(f"WHEN {k} THEN p{k}" for k in range(1, 9))} END)::VARCHAR AS parent_code FROM p""")
def line_parents(t):
    """All lines as one schedule: the nearest line before with a lower level. As in the SQL, nulls stand last, quantities are rounded, and a level below 1 has no parent."""
    last = (1 << 63) - 1  # the place of lines without a seq
    same = Window.partitionBy("l_orderkey", "l_partkey", "l_linenumber").orderBy(*(F.col(c).asc_nulls_last() for c in ("l_suppkey", "l_extendedprice", "l_quantity")))
    seq = F.col("l_orderkey").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_linenumber") * 1000 + F.row_number().over(same)
    rows = t.lineitem.select(F.lit("one").alias("cat_id"), F.coalesce(seq, F.lit(last)).alias("place"), ((F.rint("l_quantity").cast("int") * 7 + F.col("l_linenumber")) % 9).alias("level"))
    found = hierarchy.with_parent(rows.withColumn("code", F.nullif("place", F.lit(last)).cast("string")), seq="place")
    return found.select(F.nullif("place", F.lit(last)).alias("seq"), F.when(F.col("level") > 0, F.col("parent_code")).alias("parent_code"))


def _tree(t) -> DataFrame:
    """Regions, nations, customers, orders."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    levels = [(t.region, "r", "r_regionkey", None, None), (t.nation, "n", "n_nationkey", "r", "n_regionkey"), (t.customer, "c", "c_custkey", "n", "c_nationkey"), (t.orders, "o", "o_orderkey", "c", "o_custkey")]
    parts = [df.select(F.lit("w").alias("cat_id"), text(p, key).alias("code"), (text(q, up) if q else F.lit(None).cast("string")).alias("parent_code")) for df, p, key, q, up in levels]
    return relational.union_all(parts)


_PATHS = """WITH n AS (SELECT 'r' || r_regionkey AS code, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


@query(f"""WITH RECURSIVE {_PATHS[5:]}, t AS (SELECT code, 0::BIGINT AS depth, code AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.code, depth + 1, t.path || chr(1) || n.code FROM n JOIN t ON n.parent = t.code)
SELECT code, depth, row_number() OVER (ORDER BY path) - 1 AS first FROM t""")
def tree_intervals(t):
    """Depth and pre-order number of every region, nation, customer and order."""
    return hierarchy.intervals(_tree(t)).select("code", "depth", "first")


@query(f"""WITH RECURSIVE {_PATHS[5:]}, a AS (SELECT code, code AS top, parent FROM n UNION ALL SELECT a.code, n.code, n.parent FROM a JOIN n ON a.parent = n.code)
SELECT top, count(*) AS nodes, min(code) AS smallest FROM a WHERE top[1] <> 'o' GROUP BY top""")
def interval_descendants(t):
    """What lies below every region, nation and customer."""
    tree = hierarchy.intervals(_tree(t))
    found = hierarchy.below(tree, tree.where("code NOT LIKE 'o%'"))
    return found.groupBy("top").agg(F.count(F.lit(1)).alias("nodes"), F.min("code").alias("smallest"))


# Many expressions


_PATTERN = "lpad((b * 3 % 50)::VARCHAR, 3, '0') || '/' || (length(p_type) * 13 + b) % 40"


@query(f"""WITH k AS (SELECT DISTINCT p_brand, p_type, substr(p_brand, 7)::INT AS b FROM part), e AS (SELECT row_number() OVER (ORDER BY p_brand, p_type) AS seq, p_brand || ' ' || p_type AS topic, {_PATTERN} AS rx, b % 3 AS form FROM k),
c AS (SELECT p_partkey, lpad(p_size::VARCHAR, 3, '0') || '/' || p_partkey % 200 AS code FROM part)
SELECT p_partkey, arg_min(topic, seq) AS est_description FROM c LEFT JOIN e ON CASE form WHEN 0 THEN regexp_matches(code, rx || '.*') WHEN 1 THEN regexp_matches(code, rx[1:4] || '.*') ELSE contains(code, rx) END GROUP BY p_partkey""")
def pattern_index(t):
    """As many expressions as the parts have brands and types, each met through its literal factor."""
    brand = F.substring("p_brand", 7, 9).cast("int")
    kinds = t.part.select("p_brand", "p_type").distinct().withColumns({"b": brand, "seq": F.row_number().over(Window.orderBy("p_brand", "p_type"))})  # a list of topics
    head, tail = F.concat(F.lpad((F.col("b") * 3 % 50).cast("string"), 3, "0"), F.lit("/")), ((F.char_length("p_type") * 13 + F.col("b")) % 40).cast("string")
    pattern = F.when(F.col("b") % 3 == 0, F.concat(head, tail, F.lit("+"))).when(F.col("b") % 3 == 1, F.concat(head, F.lit("various"))).otherwise(F.concat(head, tail))
    compiled = concordance.compile_patterns(kinds.select("seq", F.concat_ws(" ", "p_brand", "p_type").alias("topic_des"), pattern.alias("pattern")))
    raw = t.part.select("p_partkey", F.concat(F.lit("US "), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_partkey") % 200).cast("string")).alias("raw"))
    return concordance.first_match(raw, "raw", compiled).select("p_partkey", "est_description")


# Records by their places


@query("""SELECT o_orderkey::VARCHAR AS number, strftime(o_orderdate, '%Y%m%d') AS bio_date, c_name AS inventor, o_orderstatus || ' one' AS abstract FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders GROUP BY 1) ON k = o_custkey AND first = o_orderkey""")
def record_index(t):
    """The first order of every customer, fetched from the archives of all orders by its place."""
    source = "PATN\nWKU  {key}\nAPD  19900101\nISD  {date}\nINVT\nNAM  {name}; Ann\nABST\nPAL  {status} one\nCLMS\nPAR  1. A thing."
    path = work_path(t.spark, "archive-index")
    index = offsets.build_index(t.spark, _record_files(t, source, packed=False), "text", path, glob="*.txt")
    firsts = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")).select(F.col("first").cast("string").alias("number"))
    parsed = records.parse_records(offsets.fetch(offsets.find(index, firsts), "text"), "text")
    return parsed.select(F.col("`bio_doc-number`").alias("number"), "bio_date", F.col("bio_inventor_last_name").alias("inventor"), F.get("abstract_paras", F.lit(0)).alias("abstract"))


# SQL


@query("""SELECT year(o_orderdate)::INT AS year, count(*) AS n, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even FROM orders GROUP BY 1""")
def sql_rules(t):
    """Scalar rules in plain SQL."""
    sql.register(t.spark)
    t.orders.createOrReplaceTempView("grantmill_orders")
    return t.spark.sql("""SELECT process_year(date_format(o_orderdate, 'yyyyMMdd')) AS year, count(*) AS n,
        count_if(normalise_doc_id(concat('00', o_orderkey, '.0')) IN (CAST(o_orderkey AS STRING), '') AND first_token(concat(o_orderstatus, '|x')) = o_orderstatus AND o_orderkey % 2 = 0) AS even FROM grantmill_orders GROUP BY 1""")


@query(_RECORDS)
def sql_parse_records(t):
    """Records parsed by a table function in plain SQL."""
    sql.register(t.spark)
    source = "PATN\nWKU  {key}\nAPD  19900101\nISD  {date}\nINVT\nNAM  {name}; Ann\nCTY  Basel\nINVT\nNAM  Other; Bo\nASSG\nNAM  Works\n[[PRIR\nCNT  {land}\n]]CLAS\nOCL  {code}\nABST\nPAL  {status} one\nPAL  two\nCLMS\nSTM  What is claimed is:\nPAR  1. A thing."
    _text_source(t, source).createOrReplaceTempView("grantmill_raw")
    return t.spark.sql("""SELECT `bio_doc-number` AS doc_number, bio_date, bio_inventor_last_name AS last_name, bio_assignee_country AS assignee_country,
        `bio_main-classification_national` AS national, abstract_paras[0] AS abstract, CAST(size(claims_claims) AS BIGINT) AS n_claims
        FROM parse_records(TABLE(SELECT record FROM grantmill_raw), 'text', 'bio_doc-number, bio_date, bio_inventor_last_name, bio_assignee_country, bio_main-classification_national, abstract_paras, claims_claims')""")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, 1::BIGINT AS most_runs FROM events GROUP BY event_type")
def year_log_stream(t):
    """Events added by a stream whose batch is tried twice, then compacted."""
    path = work_path(t.spark, "year-stream")
    log = YearLog(t.spark, f"{path}/log")
    add = log.sink("events")

    def twice(rows: DataFrame, number: int) -> None:
        dated = rows.withColumn("year", F.year("ts"))
        add(dated, number)
        add(dated, number)

    for half in (0, 1):
        t.events.where(F.pmod(F.xxhash64("event_type"), F.lit(2)) == half).write.mode("append").parquet(f"{path}/in")
        source = t.spark.readStream.schema(t.events.schema).parquet(f"{path}/in")
        source.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    most = max(map(len, log.compact().years.values()))
    found = log.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.withColumn("most_runs", F.lit(most).cast("long"))
