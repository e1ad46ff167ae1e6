"""Workbooks (.xlsx) as a Spark data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

A workbook is a zip of XML files. Reading plans one partition for each file, sheet and
range of rows; a partition streams the sheet, passes over rows outside its range without
parsing them, and holds no more than one row and the shared strings. Writing makes one
part for each task, rows as XML, compressed; the commit streams the parts into the sheet
of a new file beside the workbook, copies the other sheets, and renames it, so a reader
sees the old workbook or the new one. Parts of tasks that failed are never named in the
commit and go with the parts' folder.

Options: ``path`` (reading: also a pattern; files with '~' in their name are lock files
and left out), ``sheet`` (a name; reading: ``*`` for all; by default the first, or Sheet1),
``header`` (true), ``rowsPerPartition``, ``fileColumn`` and ``sheetColumn`` (reading: names
of columns for the file's and the sheet's name), ``digits`` (writing: of floating columns).
Writing ``append`` adds the sheet to the workbook, or replaces the one of its name, and
leaves others; ``overwrite`` makes the workbook anew.

Defined results: columns are found by their header, in any order; a column that a sheet
lacks is null; without a schema all columns are strings. Cells are cast by the schema, and
what can't be cast, an error or an empty cell is null; blank rows are left out. Cells beyond
the header, and headers that are empty, don't count. Numbers are written so that they read
back the same; dates and timestamps (UTC) as serial days. Texts are written whole, however
long; rows beyond ROWS go on in further sheets ("name 2"), each with the header.
Files are opened by pyarrow's file systems, so paths are local ones, hdfs, s3 or gs.
"""

from __future__ import annotations

import datetime
import decimal
import fnmatch
import io
import math
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

#: Rows of a sheet at most, its header included: the format's own limit.
ROWS = 1 << 20
CHUNK = 1 << 16
# The format's own number formats that show a date or a time, and day 0.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DAY_ZERO, DAY_ZERO_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
NAMESPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT = "application/vnd.openxmlformats-officedocument.spreadsheetml"

_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])[^>]*?(/?)>")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or re.match(r"[a-z][a-z0-9]+:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def matching(path: str) -> list[str]:
    """The files that a path or a pattern names, without lock files, in order."""
    fs, plain = _open(path)
    if not re.search(r"[*?\[]", plain):
        return [path]
    fixed = re.split(r"[*?\[]", plain, maxsplit=1)[0].rpartition("/")[0] or "/"
    found = fs.get_file_info(pafs.FileSelector(fixed, allow_not_found=True, recursive="/" in plain[len(fixed) + 1 :]))
    names = [f.path for f in found if f.type == pafs.FileType.File and f.path.count("/") == plain.count("/") and fnmatch.fnmatchcase(f.path, plain)]
    prefix = path[: len(path) - len(plain)]
    return sorted(prefix + n for n in names if "~" not in n.rpartition("/")[2])


# Reading


class Book:
    """One open workbook."""

    def __init__(self, path: str):
        fs, plain = _open(path)
        self.path = path
        self._file = fs.open_input_file(plain)
        self.zip = zipfile.ZipFile(self._file)
        self.names = set(self.zip.namelist())
        self._shared: list[str] | None = None
        self._dates: list[bool] | None = None
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in self.names else {}
        properties = next((e for e in book if _local(e.tag) == "workbookPr"), None)
        self.day_zero = DAY_ZERO_1904 if properties is not None and properties.get("date1904") in ("1", "true") else DAY_ZERO
        #: Name of each sheet to its file, in order.
        self.sheets: dict[str, str] = {}
        for e in book.iter():
            if _local(e.tag) == "sheet":
                target = targets.get(next((v for k, v in e.attrib.items() if _local(k) == "id" and k != "sheetId"), None)) or ""
                self.sheets[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self._file.close()

    def shared(self) -> list[str]:
        if self._shared is None:
            self._shared = []
            if "xl/sharedStrings.xml" in self.names:
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if _local(e.tag) == "si":
                            self._shared.append(_texts(e))
                            e.clear()
        return self._shared

    def dates(self) -> list[bool]:
        """Of each style whether it shows a date or a time."""
        if self._dates is None:
            own, styles = {}, []
            if "xl/styles.xml" in self.names:
                for e in ElementTree.fromstring(self.zip.read("xl/styles.xml")):
                    if _local(e.tag) == "numFmts":
                        own = {int(n.get("numFmtId")): re.sub(r"\[[^\]]*\]|\"[^\"]*\"|\\.", "", n.get("formatCode", "")).lower() for n in e}
                    elif _local(e.tag) == "cellXfs":
                        styles = [int(x.get("numFmtId", 0)) for x in e]
            self._dates = [bool(re.search("[ymdhs]", own[n])) and "general" not in own[n] if n in own else n in DATE_FORMATS for n in styles]
        return self._dates

    def raw_rows(self, sheet: str) -> Iterator[bytes]:
        """The XML of each row, in order, as the sheet streams by."""
        with self.zip.open(self.sheets[sheet]) as f:
            held, at = b"", 0
            while True:
                m = _ROW.search(held, at)
                end = -1
                if m:
                    close = b"" if m[1] else b"</" + m[0][1:].split(maxsplit=1)[0].rstrip(b">/") + b">"
                    end = m.end() if m[1] else held.find(close, m.end())
                    if end >= 0:
                        end += 0 if m[1] else len(close)
                        yield held[m.start() : end]
                        at = end
                        continue
                chunk = f.read(CHUNK)
                if not chunk:
                    return
                start = m.start() if m else max(at, held.rfind(b"<", at))
                held, at = held[start:] + chunk, 0

    def cells(self, row: bytes) -> list:
        """Values of a row by place: text, a number, a boolean, a datetime, or None."""
        out: list = []
        plain = re.sub(rb"(</?)\w+:", rb"\1", row)  # prefixes are declared further up
        for c in ElementTree.fromstring(re.sub(rb"(\s)\w+:(\w+=)", rb"\1\2", plain)):
            if c.tag != "c":
                continue
            at = _column(c.get("r")) if c.get("r") else len(out)
            out += [None] * (at - len(out))
            out.append(self._value(c))
        return out

    def _value(self, c: ElementTree.Element):
        kind = c.get("t", "n")
        if kind == "inlineStr":
            inline = c.find("is")
            return None if inline is None else _texts(inline)
        v = c.find("v")
        text = None if v is None else v.text
        if text is None:
            return "" if kind == "str" and v is not None else None
        if kind == "s":
            return self.shared()[int(text)]
        if kind == "b":
            return text.strip() in ("1", "true")
        if kind == "e":
            return None
        if kind in ("str", "d"):
            return _unescaped(text)
        number = int(text) if re.fullmatch(r"-?\d{1,18}", text) else float(text)
        style = int(c.get("s", 0))
        if style < len(self.dates()) and self.dates()[style]:
            return self.day_zero + datetime.timedelta(microseconds=round(number * 86_400_000) * 1000)
        return number if isinstance(number, int) else _Decimal(text)


class _Decimal(float):
    """A number with the digits it was written with, so that a decimal or a text gets just these."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _texts(e: ElementTree.Element) -> str:
    """Runs of text, without what tells how to pronounce it."""
    out = []
    for x in e:
        if _local(x.tag) == "t":
            out.append(x.text or "")
        elif _local(x.tag) == "r":
            out += [t.text or "" for t in x if _local(t.tag) == "t"]
    return _unescaped("".join(out))


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def converted(value, kind: DataType):
    """A cell's value as one of a type, or None where it is none."""
    if value is None:
        return None
    try:
        if isinstance(kind, StringType):
            if isinstance(value, bool):
                return "true" if value else "false"
            if isinstance(value, datetime.datetime):
                return value.date().isoformat() if value.time() == datetime.time() else value.isoformat(" ")
            if isinstance(value, _Decimal):
                return str(int(value)) if value.is_integer() and abs(value) < 1e15 else value.text
            return str(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).strip().lower())
        if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
            number = decimal.Decimal(value.text if isinstance(value, _Decimal) else value if isinstance(value, int) else str(value).strip())
            bits = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}[type(kind)]
            return int(number) if number == number.to_integral_value() and -(1 << bits - 1) <= number < 1 << bits - 1 else None
        if isinstance(kind, (FloatType, DoubleType)):
            return float(value) if isinstance(value, (int, float)) else float(str(value).strip())
        if isinstance(kind, DecimalType):
            exact = decimal.Decimal(value.text if isinstance(value, _Decimal) else str(value).strip())
            rounded = exact.quantize(decimal.Decimal(1).scaleb(-kind.scale), decimal.ROUND_HALF_UP, decimal.Context(prec=60))
            return rounded if len(rounded.as_tuple().digits) <= kind.precision else None
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            when = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value).strip())
            if isinstance(kind, DateType):
                return when.date()
            return when.replace(tzinfo=datetime.timezone.utc) if isinstance(kind, TimestampType) and when.tzinfo is None else when
    except (ValueError, TypeError, ArithmeticError):
        return None
    raise TypeError(f"{kind.simpleString()} can't be read from a workbook")


class Range(InputPartition):
    """Rows first to end - 1 of a sheet."""

    def __init__(self, file: str, sheet: str, first: int, end: int):
        self.file, self.sheet, self.first, self.end = file, sheet, first, end


def _chosen(book: Book, sheet: str | None) -> list[str]:
    if sheet == "*":
        return [*book.sheets]
    if sheet is None:
        return [*book.sheets][:1]
    if sheet not in book.sheets:
        raise ValueError(f"{book.path} has no sheet {sheet!r}, but {[*book.sheets]}")
    return [sheet]


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.header = options.get("header", "true").lower() != "false"

    def partitions(self) -> list[Range]:
        size = int(self.options.get("rowspartition", self.options.get("rowsPerPartition", 100_000)))
        out = []
        for file in matching(self.options["path"]):
            with Book(file) as book:
                for sheet in _chosen(book, self.options.get("sheet")):
                    rows = sum(1 for _ in book.raw_rows(sheet))
                    out += [Range(file, sheet, k, min(rows, k + size)) for k in range(int(self.header), max(rows, 1), size)]
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # no rows at all
            return
        named = {self.options.get("fileColumn"): partition.file.rpartition("/")[2], self.options.get("sheetColumn"): partition.sheet}
        fields = self.schema.fields
        with Book(partition.file) as book:
            places: list[int | None] | None = None
            if not self.header:
                own = [f for f in fields if f.name not in named]
                places = [None if f.name in named else own.index(f) for f in fields]
            for k, raw in enumerate(book.raw_rows(partition.sheet)):
                if k >= partition.end:
                    return
                if places is None:
                    titles = ["" if c is None else converted(c, StringType()).strip() for c in book.cells(raw)]
                    places = [titles.index(f.name) if f.name in titles else None for f in fields]
                    continue
                if k < partition.first:
                    continue
                cells = book.cells(raw)
                if any(c is not None for c in cells):
                    yield tuple(named[f.name] if f.name in named else converted(cells[p] if p is not None and p < len(cells) else None, f.dataType) for f, p in zip(fields, places))


# Writing


def _escaped(text: str) -> str:
    return escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text), {"\n": "&#10;"})


def cell(value, digits: int | None = None) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, float) and digits is not None and math.isfinite(value):
        value = round(value, digits)
    if isinstance(value, int) and abs(value) >= 10**15 or isinstance(value, float) and not math.isfinite(value):
        value = str(value)  # the format's numbers have 15 digits
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"<c><v>{value}</v></c>"
    if isinstance(value, datetime.datetime):
        plain = value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        days = (plain - DAY_ZERO) / datetime.timedelta(days=1)
        return f'<c s="2"><v>{days!r}</v></c>'
    if isinstance(value, datetime.date):
        return f'<c s="1"><v>{(value - DAY_ZERO.date()).days}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_escaped(str(value))}</t></is></c>'


def row_xml(values: Iterable, digits: int | None = None) -> bytes:
    return f"<row>{''.join(cell(v, digits) for v in values)}</row>".encode()


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite
        self.sheet = options.get("sheet") or "Sheet1"
        if not 0 < len(self.sheet) <= 31 or re.search(r"[\[\]:*?/\\]", self.sheet):
            raise ValueError(f"{self.sheet!r} can't be the name of a sheet")
        self.path = options["path"]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        fs, folder = _open(self.parts)
        fs.create_dir(folder, recursive=True)
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        name = f"{folder}/{number:08d}-{uuid.uuid4().hex}"
        digits = int(self.options["digits"]) if "digits" in self.options else None
        press, rows = zlib.compressobj(1), 0
        with fs.open_output_stream(name) as out:
            for r in iterator:
                out.write(press.compress(row_xml(r, digits) + b"\n"))
                rows += 1
            out.write(press.flush())
        return Part(number, name, rows)

    def commit(self, messages: list[Part]) -> None:
        fs, plain = _open(self.path)
        held = f"{plain}.new-{uuid.uuid4().hex}"
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        old = None
        if not self.overwrite and fs.get_file_info(plain).type == pafs.FileType.File:
            old = Book(self.path)
        try:
            with fs.open_output_stream(held) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
                self._assemble(z, fs, parts, old)
        finally:
            if old is not None:
                old.__exit__()
        fs.move(held, plain)
        self._drop(fs)

    def abort(self, messages: list[Part]) -> None:
        self._drop(_open(self.parts)[0])

    def _drop(self, fs: pafs.FileSystem) -> None:
        folder = _open(self.parts)[1]
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)

    def _assemble(self, z: zipfile.ZipFile, fs: pafs.FileSystem, parts: list[Part], old: Book | None) -> None:
        header = row_xml(f.name for f in self.schema.fields) if self.options.get("header", "true").lower() != "false" else b""
        sheets: list[str] = []
        if old is not None:
            for name in old.sheets:
                if name != self.sheet and not re.fullmatch(re.escape(self.sheet) + r" \d+", name):
                    sheets.append(name)
                    with z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as target:
                        _rewritten(old, name, target)
        lines = _lines(fs, parts)
        more, number = True, 1
        while more:
            sheets.append(self.sheet if number == 1 else f"{self.sheet} {number}")
            with z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as target:
                target.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{NAMESPACE}"><sheetData>'.encode() + header)
                n, more = int(bool(header)), False
                for line in lines:
                    target.write(line)
                    n += 1
                    if n == ROWS:
                        more = True
                        break
                target.write(b"</sheetData></worksheet>")
            number += 1
        for name, text in _frame(sheets).items():
            z.writestr(name, text)


def _lines(fs: pafs.FileSystem, parts: list[Part]) -> Iterator[bytes]:
    for part in parts:
        press, rest = zlib.decompressobj(), b""
        with fs.open_input_stream(part.path) as f:
            while chunk := f.read(CHUNK):
                *whole, rest = (rest + press.decompress(chunk)).split(b"\n")
                yield from whole
            *whole, rest = (rest + press.flush()).split(b"\n")
            yield from whole


def _rewritten(book: Book, sheet: str, target: io.RawIOBase) -> None:
    """A sheet of a workbook with its texts in place, so that it stands on its own."""
    target.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{NAMESPACE}"><sheetData>'.encode())
    for raw in book.raw_rows(sheet):
        target.write(f"<row>{''.join(_again(v) for v in book.cells(raw))}</row>".encode())
    target.write(b"</sheetData></worksheet>")


def _again(value) -> str:
    if isinstance(value, _Decimal):
        return f"<c><v>{value.text}</v></c>"
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return cell(value.date())
    return cell(value)


def _frame(sheets: list[str]) -> dict[str, str]:
    """The files of a workbook besides its sheets."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    numbers = range(1, len(sheets) + 1)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{CONTENT}.worksheet+xml"/>' for k in numbers)
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{CONTENT}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{CONTENT}.styles+xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{NAMESPACE}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(numbers, sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="rId{k}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        + f'<Relationship Id="rId{len(sheets) + 1}" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{NAMESPACE}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        files = matching(self.options["path"])
        if not files:
            raise ValueError(f"no workbook is at {self.options['path']}")
        with Book(files[0]) as book:
            first = next(book.raw_rows(_chosen(book, self.options.get("sheet"))[0]), None)
            cells = book.cells(first) if first is not None else []
        titles = [converted(c, StringType()).strip() for c in cells if c is not None] if self.options.get("header", "true").lower() != "false" else [f"_c{k}" for k in range(len(cells))]
        more = [self.options[o] for o in ("fileColumn", "sheetColumn") if self.options.get(o)]
        return StructType([StructField(n, StringType()) for n in dict.fromkeys([*filter(None, titles), *more])])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options) | {o: self.options[o] for o in ("fileColumn", "sheetColumn", "rowsPerPartition") if self.options.get(o)})

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, {k: v for k, v in dict(self.options).items()}, overwrite)
