"""Files and saved pages as tables, and tables as files."""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .workbook import WorkbookSource
from .yearlog import YearLog

# Delimited files


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, header: bool = True, file: str | None = None) -> DataFrame:
    """Rows with too many fields are skipped, empty surplus ones count too; short ones are filled with nulls; nothing is inferred.

    file: a column for the file's name.
    """
    # Rows with more or fewer fields than columns are kept as they stand in _raw, so that fields can be counted.
    text = StructType([*(StructField(f.name, StringType()) for f in schema.fields), StructField("_raw", StringType())])
    rows = spark.read.csv(path, schema=text, header=header, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True, columnNameOfCorruptRecord="_raw")
    unquoted = F.regexp_replace("_raw", r'(^|,)"(?:[^"]|"")*"', "$1")
    commas = F.char_length(unquoted) - F.char_length(F.replace(unquoted, F.lit(","), F.lit("")))
    kept = rows.where(F.col("_raw").isNull() | (commas < len(schema.fields)))
    names = [F.col("_metadata.file_name").alias(file)] if file else []
    return kept.select(*(F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields), *names)


def read_year_counts(spark: SparkSession, path: str) -> DataFrame:
    """A file of (year, count) without a header, in order."""
    return spark.read.csv(path, schema="year INT, count LONG", header=False).orderBy("year")


def literal_list(value: Column | str) -> Column:
    """A list written as Python text; what is no such list becomes ['']. For archives of the old CSV form.

    The common form, plain strings in one kind of quotes, is read without Python; only
    lists with escapes, numbers and the like go to the parser, in Arrow batches.
    """
    c = F.trim(F.col(value) if isinstance(value, str) else value)
    single, double = r"'[^'\\\n]*'", r'"[^"\\\n]*"'
    item = f"(?:{single}|{double})"
    plain = c.rlike(rf"^\[\s*(?:{item}\s*(?:,\s*{item}\s*)*,?\s*)?\]$")
    items = F.transform(F.regexp_extract_all(c, F.lit(item), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))

    @F.pandas_udf("array<string>")
    def parse(texts: pd.Series) -> pd.Series:
        def read(text):
            try:
                found = ast.literal_eval(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return [""]
            return [str(x) for x in found] if isinstance(found, (list, tuple)) else [""]

        return texts.map(lambda x: None if x is None else read(x))

    return F.when(plain, items).otherwise(parse(F.when(~plain, c)))


def write_years(df: DataFrame, path: str, year: str = "year", covers: Iterable[int] = ()) -> None:
    """Replace the years that df has rows of, all of them or, if the run fails, none; other years stay.

    covers: years that are emptied where df has no rows of them. See ``yearlog.YearLog``.
    """
    YearLog(df.sparkSession, path, year).write(df, covers)


def read_years(spark: SparkSession, path: str, first: int, end: int, year: str = "year") -> DataFrame:
    """Years first to end - 1 as the last run that was committed has left them; only their files are read."""
    return YearLog(spark, path, year).read(first, end)


def write_meta(df: DataFrame, path: str, year: str = "year") -> None:
    """Rows of each year; written again, it is the same."""
    df.groupBy(year).agg(F.count(F.lit(1)).alias("count")).orderBy(year).coalesce(1).write.mode("overwrite").csv(path, header=False)


# Workbooks


def write_workbook(sheets: dict[str, DataFrame] | Sequence[DataFrame], path: str, digits: int | None = None) -> list[str]:
    """One .xlsx file, made anew; sheets by name, or Sheet1, Sheet2, ...; digits rounds floating columns."""
    named = sheets if isinstance(sheets, dict) else {f"Sheet{k}": df for k, df in enumerate(sheets, 1)}
    for k, (name, df) in enumerate(named.items()):
        df.sparkSession.dataSource.register(WorkbookSource)
        writer = df.write.format("workbook").option("sheet", name).mode("append" if k else "overwrite")
        (writer if digits is None else writer.option("digits", digits)).save(path)
    return [*named]


def read_workbook(spark: SparkSession, paths: str, sheet: str | None = None, schema: StructType | None = None, file: str | None = None, sheet_column: str | None = None, rows: int = 100_000) -> DataFrame:
    """A sheet (None: the first, '*': all) of the .xlsx files of a path or pattern, columns by header; lock files are left out.

    file, sheet_column: columns for the names of file and sheet. Each task reads ``rows`` rows.
    """
    spark.dataSource.register(WorkbookSource)
    options = {"sheet": sheet, "fileColumn": file, "sheetColumn": sheet_column, "rowsPerPartition": rows}
    reader = spark.read.format("workbook").options(**{k: v for k, v in options.items() if v is not None})
    return (reader if schema is None else reader.schema(schema)).load(paths)


# Sheets as folders of CSV


def write_sheets(sheets: dict[str, DataFrame] | Sequence[DataFrame], path: str, digits: int | None = None) -> list[str]:
    """A folder for each sheet, by name, or Sheet1, Sheet2, ...; digits rounds floating columns."""
    named = sheets if isinstance(sheets, dict) else {f"Sheet{k}": df for k, df in enumerate(sheets, 1)}
    for name, df in named.items():
        if digits is not None:
            df = df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
    return [*named]


def read_sheet(spark: SparkSession, path: str, sheet: str, schema: StructType) -> DataFrame:
    return read_csv(spark, f"{path}/{sheet}", schema)


def read_matching(spark: SparkSession, paths: str, schema: StructType) -> DataFrame:
    """All files of a pattern but lock files (with '~'), with their names; rows as ``read_csv`` has them."""
    return read_csv(spark, paths, schema, file="file_name").where(~F.contains("file_name", F.lit("~")))


# JSON


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """All rows as one document, a list, in one file of the folder; a task streams them into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([lead + rows[0], *("," + r for r in rows[1:])])], names=["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])

    one = df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1)
    one.mapInArrow(run, "value string").write.mode("overwrite").text(path)


# Keywords


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("keyword")).where("keyword <> ''")


def keyword_groups(sheet: DataFrame, order: str | None = None) -> DataFrame:
    """(group, pos, keyword) of a sheet with a column for each group; no-break blanks come off, blank cells go.

    order: a column that numbers the sheet's rows; by default they count as they stand.
    """
    numbered = sheet.withColumn("pos", F.monotonically_increasing_id() if order is None else F.col(order).cast("long"))
    names = [c for c in sheet.columns if c != order]
    melted = numbered.unpivot(["pos"], names, "group", "keyword")
    return melted.select("group", "pos", F.btrim("keyword", F.lit("\u00a0")).alias("keyword")).where("keyword IS NOT NULL AND keyword <> ''")


def with_header(cells: DataFrame, width: int) -> DataFrame:
    """Rows (row, cells) of one table with its first row as the names of ``width`` columns; row stays."""
    first = cells.where("row = 0").select("cells").first()
    names = [*(first[0] if first else []), *(f"column{k}" for k in range(len(first[0]) if first else 0, width))][:width]
    return cells.where("row > 0").select("row", *(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))


# Saved web pages


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """href and text of every link, in order, with the page's other columns."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("*", F.posexplode(found).alias("pos", "_a"))
    href = F.regexp_extract("_a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("_a", r"(?s)<[^>]*>", ""), r"\s+", " "))
    return rows.withColumns({"href": href, "text": text}).drop("_a", html)


def archive_years(pages: DataFrame, phrase: str = "Patent Grant Full Text") -> DataFrame:
    """Links of an index page to the archives of a year: title, year, parent_url."""
    found = anchors(pages).where(F.contains("text", F.lit(phrase)))
    return found.select(F.col("text").alias("title"), F.regexp_extract("text", r"\s+([0-9]{4})\)", 1).alias("year"), F.col("href").alias("parent_url"))


def archive_files(pages: DataFrame, key: str = "title") -> DataFrame:
    """Of each parent page the links whose text names a zip file, and whether there are any."""
    links = anchors(pages).where(F.contains("text", F.lit(".zip")))
    files = links.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]).alias("file_url"))
    return pages.select(key).distinct().join(files, key, "left").select(key, F.coalesce("file_url", F.array().cast("array<string>")).alias("file_url"), F.col("file_url").isNotNull().alias("status"))


def all_done(links: DataFrame) -> DataFrame:
    return links.agg(F.coalesce(F.bool_and("status"), F.lit(True)).alias("all_done"))


def file_url(year: Column | str, name: Column | str, prefix: str) -> Column:
    return F.concat_ws("/", F.lit(prefix.rstrip("/")), F.col(year) if isinstance(year, str) else year, F.col(name) if isinstance(name, str) else name)


def failed_files(links: DataFrame) -> DataFrame:
    """(title, url) of downloads whose status is false."""
    return links.select("title", F.explode(F.map_entries("down_status")).alias("e")).where("NOT e.value").select("title", F.col("e.key").alias("url"))


def _cells(html: str) -> list[list[list[str]]]:
    """Rows of cells of every table, in order."""
    from .records import parse_tree

    try:
        tables = parse_tree(f"<root>{html}</root>").find_all("table")
    except RecursionError:  # a page nested too deeply has no table that could be told
        return []
    out = []
    for t in tables:
        rows = [[" ".join(c.text().split()) for c in r.walk() if c.tag in ("td", "th")] for r in t.find_all("tr")]
        out.append([r for r in rows if r])
    return out


def html_table(pages: DataFrame, number: int = 0, html: str = "html") -> DataFrame:
    """(row, cells) of a page's table, with the page's other columns."""
    rest = pages.drop(html)
    schema = StructType([*rest.schema.fields, *StructType.fromDDL("row INT, cells ARRAY<STRING>").fields])
    place = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, cells = [], [], []
            for k, page in enumerate(batch.column(place).to_pylist()):
                tables = _cells(page) if page else []
                for i, r in enumerate(tables[number] if len(tables) > number else []):
                    rows.append(k)
                    numbers.append(i)
                    cells.append(r)
            own = [batch.column(c).take(pa.array(rows, pa.int32())) for c in range(batch.num_columns) if c != place]
            yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=schema.fieldNames())

    return pages.mapInArrow(run, schema)


def code_map(cells: DataFrame) -> DataFrame:
    """(ipc_code, name) of a concordance table: rows after the second, the last of a code counts."""
    rows = cells.where("row > 1").select(F.regexp_replace(F.concat_ws(" ", F.get("cells", F.lit(0)), F.replace(F.get("cells", F.lit(1)), F.lit(" "), F.lit(""))), r"\s+$", "").alias("ipc_code"), F.get("cells", F.lit(2)).alias("name"), "row")
    return rows.groupBy("ipc_code").agg(F.max_by("name", "row").alias("name"))


def class_list(pages: DataFrame, html: str = "html") -> DataFrame:
    """(class_id, title) of an index page: a narrow cell at the top holds the class, the next its title."""
    pattern = r"(?is)<td[^>]*valign\s*=\s*[\"']?top[\"']?[^>]*width\s*=\s*[\"']?27[\"']?[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"
    found = pages.select(F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))).alias("seq", "_m"))
    plain = lambda k: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("_m", pattern, k), r"(?s)<[^>]*>", ""), r"\s+", " "))
    return found.select("seq", plain(1).alias("class_id"), plain(2).alias("title"))


def schedule_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(seq, code, level, name) of a class schedule: rows of subtitle tables; an image's alt text is the level, else 0."""
    rest = [c for c in pages.columns if c != html]
    schema = StructType([*(pages.schema[c] for c in rest), *StructType.fromDDL("seq INT, code STRING, level INT, name STRING").fields])
    place = pages.columns.index(html)
    table, row = re.compile(r"(?is)<table.*?</table>"), re.compile(r"(?is)<tr.*?</tr>")
    cell, alt = re.compile(r"(?is)<td[^>]*>(.*?)</td>"), re.compile(r"(?is)<img[^>]*alt\s*=\s*[\"']?(\d+)")

    def plain(x: str) -> str:
        return " ".join(re.sub(r"(?s)<[^>]*>", " ", x).split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, page in enumerate(batch.column(place).to_pylist()):
                seq = 0
                for t in table.findall(page or ""):
                    if "SubTtl" not in t:
                        continue
                    for r in row.findall(t):
                        cells = cell.findall(r)
                        if len(cells) < 2:
                            continue
                        level = alt.search(r)
                        at.append(k)
                        out.append((seq, plain(cells[0]) or None, int(level[1]) if level else 0, plain(cells[-1])))
                        seq += 1
            own = [batch.column(c).take(pa.array(at, pa.int32())) for c in range(batch.num_columns) if c != place]
            columns = list(zip(*out)) or [[], [], [], []]
            types = (pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, types))], names=schema.fieldNames())

    return pages.mapInArrow(run, schema)


# Archives


def zip_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Archives one folder level below, not yet unpacked; contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    folder = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\..*$", "")
    return rows.select(F.col("path").alias("zip_file"), folder.alias("out_folder"), F.col("length"), F.lit(False).alias("unzip_status"))


def unpack(archives: DataFrame) -> DataFrame:
    """(path, member, text, unzip_status) of archives given as (path, content); one that can't be read gives one row with false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in members(path, content):  # one member at a time
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["path", "member", "text", "unzip_status"])

    def members(path: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in z.namelist():
                    if not m.endswith("/"):
                        yield path, m, z.read(m).decode("utf-8", "ignore"), True
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
            yield path, None, None, False

    return archives.select("path", "content").mapInArrow(run, "path string, member string, text string, unzip_status boolean")
