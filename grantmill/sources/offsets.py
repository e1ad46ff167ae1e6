"""An index of raw archives: where each record lies, so that a few are read without the rest.

Building it takes one scan: files are cut into ranges of bytes, a task reads its range (and
on to the end of the record that begins in it), parses each record for its number, and
gives (number, file, start, length). The index is stored sorted by number, so the row groups'
least and greatest values are zone maps, with a Bloom filter over the numbers. A lookup by a
few numbers is a scan with these pushed down; by many, a join. What is found is then read by
seeking: a task opens each file once and reads just those bytes.

Files are opened by pyarrow's file systems (local, hdfs, s3, gs). Defined results: a number
that several records bear gives all of them, one that none bears nothing; records that can't
be parsed, and what stands before a file's first mark, aren't in the index; a record comes out
as a full scan gives it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import PARSERS, SGML_MARK, TEXT_MARK, XML_MARK
from .workbook import _open as open_path

#: Bytes of a range; how many are read at once; records, or bytes of them, that a task holds.
RANGE, STEP, ROWS, BYTES = 64 << 20, 1 << 20, 4096, 8 << 20
#: Numbers up to which a lookup names them in the scan.
FEW = 1000

_MARKS = {"xml": re.compile(re.escape(XML_MARK.encode())), "sgml": re.compile(re.escape(SGML_MARK.encode())), "text": re.compile(rb"(?:\A|(?<=\n))" + TEXT_MARK.encode() + rb"[ \t\r]*(?=\n|\Z)")}


def as_scanned(raw: bytes, kind: str) -> str:
    """A record's bytes as the scan of records gives it."""
    if kind == "text":
        lines = [x.rstrip() for x in raw.decode("utf-8", "ignore").split("\n")]
        return "\n".join([TEXT_MARK, *filter(None, lines[1:])])
    return re.sub(r"\s+\Z", "", raw.decode("utf-8", "replace"))


def _records(f, start: int, end: int, size: int, mark: re.Pattern) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that begin in a range."""
    lead = 64  # what a mark and what must stand before it can take
    begin = max(0, start - 1)
    f.seek(begin)
    held, at, found = b"", begin, -1
    read = begin
    while True:
        for m in mark.finditer(held):
            place = at + m.start()
            if place < start or place <= found or (m.end() > len(held) - lead and read < size) or (at and m.start() == 0 and mark is _MARKS["text"]):
                continue
            if found >= 0:
                yield found, held[found - at : place - at]
                found = -1
            if place >= end:
                return
            found = place
        if read >= size:
            if found >= 0:
                yield found, held[found - at :]
            return
        if found < 0 and read >= end + lead:
            return
        keep = found - at if found >= 0 else max(0, len(held) - lead)
        held, at = held[keep:], at + keep
        chunk = f.read(min(STEP, size - read))
        held, read = held + chunk, read + len(chunk)


def build_index(spark: SparkSession, paths: str | Sequence[str], kind: str, target: str, glob: str | None = None) -> DataFrame:
    """Write the index of all files below ``paths`` to target; the index (number, file, start, length)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths if isinstance(paths, str) else [*paths]).select("path", "length")
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long"))).alias("start"))
    mark, parse, step, most = _MARKS[kind], PARSERS[kind], RANGE, ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                fs, plain = open_path(path)
                with fs.open_input_file(plain) as f:
                    for place, raw in _records(f, start, min(start + step, size), size, mark):
                        try:
                            number = parse(as_scanned(raw, kind), False).get("bio_doc-number")
                        except Exception:  # a record that can't be parsed bears no number
                            continue
                        if number is not None:
                            rows.append((number, path, place, len(raw)))
                        if len(rows) >= most:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows)] or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["number", "file", "start", "length"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ranges.repartition(parts, "path", "start").mapInArrow(run, "number string, file string, start long, length long")
    written = found.repartitionByRange(parts, "number", "file", "start").sortWithinPartitions("number", "file", "start").write.mode("overwrite")
    written.option("parquet.bloom.filter.enabled#number", "true").parquet(target)
    return read_index(spark, target)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("number string, file string, start long, length long").parquet(target)


def find(index: DataFrame, numbers: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the index with these numbers; a DataFrame has them in its first column."""
    if isinstance(numbers, DataFrame):
        return index.join(numbers.select(F.col(numbers.columns[0]).cast("string").alias("number")).distinct(), "number", "left_semi")
    wanted = sorted({*map(str, numbers)})
    if len(wanted) > FEW:
        return find(index, index.sparkSession.createDataFrame([(n,) for n in wanted], "number string"))
    return index.where(F.col("number").isin(wanted))


def fetch(found: DataFrame, kind: str) -> DataFrame:
    """(number, file, record) of rows of an index; only the bytes of these records are read."""
    most, held = ROWS, BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        try:
            for batch in batches:
                records, size, begin = [], 0, 0
                for path, start, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    if path != name:
                        if f is not None:
                            f.close()
                        fs, plain = open_path(path)
                        name, f = path, fs.open_input_file(plain)
                    records.append(as_scanned(f.read_at(length, start), kind))
                    size += length
                    if len(records) >= most or size >= held:
                        yield batch_of(batch, begin, records)
                        begin, records, size = begin + len(records), [], 0
                yield batch_of(batch, begin, records)
        finally:
            if f is not None:
                f.close()

    def batch_of(batch: pa.RecordBatch, begin: int, records: list[str]) -> pa.RecordBatch:
        own = batch.slice(begin, len(records))
        return pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(records, pa.string())], names=["number", "file", "record"])

    ordered = found.select("number", "file", "start", "length").repartition("file", F.floor(F.col("start") / RANGE)).sortWithinPartitions("file", "start")
    return ordered.mapInArrow(run, "number string, file string, record string")
