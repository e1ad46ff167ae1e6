"""Tables by year that runs replace year by year, each run wholly or not at all.

A run writes its files into a folder of its own, which nobody reads, and then commits
one manifest: a small JSON file that names, for each year, the runs whose files hold it.
Manifests are numbered; a new one appears by a rename that fails if the number is
taken, so of two runs that commit at once one takes the next number, upon what the
other has committed. Readers take the newest manifest and its files only:

* a run that fails or is killed leaves files, but nothing visible (``clean`` removes them);
* a run replaces just the years that it has rows of, or adds to them;
* a reader keeps what it began with, for files never change;
* a run that says who it is (``writer``, a name and an ascending number) is committed
  once, however often it is tried: so each batch of a stream is added exactly once (``sink``);
* ``compact`` gathers a year's runs into one, unless another commit changes that year meanwhile.

The store must be one in which a rename onto an existing file fails as one step (HDFS, local
disks and the like do; plain object stores need a layer that does).

Defined results: rows with a null year make a year of their own; a run without rows
changes nothing but the years that it says it covers, which it empties; a log without
runs reads as an empty table of the given schema. The table's columns are those of
its newest run: older files give nulls for columns they lack.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times that a commit is tried against others that commit meanwhile.
TRIES = 100
#: Bytes of a year's files that a task of a compaction takes.
FILE = 64 << 20
_NULL_YEAR = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Manifest:
    """What the table is after a commit: of each year (as text) its runs, the columns, the last number of each writer."""

    version: int = -1
    years: dict[str, list[str]] = field(default_factory=dict)
    schema: str | None = None
    writers: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Others have committed without end, or have changed what was to be replaced as it stood."""


class YearLog:
    """A log at a path; ``year`` may be any column of numbers, options are those of the Parquet writer."""

    def __init__(self, spark: SparkSession, path: str, year: str = "year", **options: str):
        self.spark, self.path, self.year, self.options = spark, path.rstrip("/"), year, options
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file(self.path).getFileSystem(self._conf)

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._file(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    # Manifests

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version."""
        known = self.versions()
        if version is None:
            if not known:
                return Manifest()
            version = known[-1]
        elif version not in known:
            raise KeyError(f"version {version} is not among {known[:1]} to {known[-1:]}")
        stream = self._fs.open(self._file(self._log_file(version)))
        try:
            raw = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return Manifest(**json.loads(raw))

    def _log_file(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _publish(self, manifest: Manifest) -> bool:
        """Whether the manifest has got its number."""
        held = self._file(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        files = fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)  # without OVERWRITE it fails if there is such a file
        try:
            files.rename(held, self._file(self._log_file(manifest.version)), no_options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(held, False)
            return False

    # Runs

    def write(self, df: DataFrame, covers: Iterable[int] = (), writer: tuple[str, int] | None = None) -> Manifest:
        """Replace the years that df has rows of, and empty those of ``covers`` that it has none of; the manifest committed.

        writer: a name and a number; a number that is not above the name's last one was here before, and nothing happens.
        """
        if self._was_here(self.manifest(), writer):
            return self.manifest()
        run, years = self._files(df)
        gone = {str(y) for y in covers}
        return self._commit(lambda now: {y: r for y, r in now.items() if y not in gone} | dict.fromkeys(years, [run]), df.schema, writer)

    def append(self, df: DataFrame, writer: tuple[str, int] | None = None) -> Manifest:
        """Add df's rows to their years; writer as in ``write``."""
        if self._was_here(self.manifest(), writer):
            return self.manifest()
        run, years = self._files(df)
        return self._commit(lambda now: now | {y: [*now.get(y, []), run] for y in years}, df.schema, writer)

    def compact(self, most: int = 1) -> Manifest:
        """Write the years that more than ``most`` runs hold as one run; Conflict if one of them changes meanwhile.

        A year of any size: a task writes about FILE bytes, as the year's files are now.
        """
        before = self.manifest()
        many = {y: r for y, r in before.years.items() if len(r) > most}
        if not many:
            return before
        held = self._table(before, many)
        tasks = F.lit(1)
        for y, runs in many.items():
            size = sum(self._fs.getContentSummary(self._file(f"{self.path}/data/run={r}/{self.year}={y}")).getLength() for r in runs)
            if size > FILE:
                own = F.col(self.year).isNull() if y == _NULL_YEAR else F.col(self.year).cast("string") == y
                tasks = F.when(own, F.lit(-(-size // FILE))).otherwise(tasks)
        dealt = held.withColumn("_task", F.monotonically_increasing_id() % tasks)
        run, _ = self._files(dealt.repartition(self.year, "_task").drop("_task"))

        def replaced(now: dict[str, list[str]]) -> dict[str, list[str]]:
            if any(now.get(y) != r for y, r in many.items()):
                raise Conflict(f"{self.path}: {sorted(many)} changed while they were compacted")
            return now | dict.fromkeys(many, [run])

        return self._commit(replaced, held.schema, None)

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: adds each batch exactly once, whatever is tried again."""

        def batch(rows: DataFrame, number: int) -> None:
            self.append(rows, writer=(name, number))

        return batch

    @staticmethod
    def _was_here(now: Manifest, writer: tuple[str, int] | None) -> bool:
        return writer is not None and now.writers.get(writer[0], -1) >= writer[1]

    def _files(self, df: DataFrame) -> tuple[str, list[str]]:
        """A new run's name and years, its files written."""
        run = uuid.uuid4().hex
        folder = f"{self.path}/data/run={run}"
        df.write.options(**self.options).partitionBy(self.year).parquet(folder)
        return run, [n.partition("=")[2] for n in self._names(folder) if n.startswith(f"{self.year}=")]

    def _commit(self, change: Callable[[dict[str, list[str]]], dict[str, list[str]]], schema: StructType, writer: tuple[str, int] | None) -> Manifest:
        for _ in range(TRIES):
            last = self.manifest()
            if self._was_here(last, writer):
                return last
            new = Manifest(last.version + 1, change(last.years), schema.json(), last.writers | (dict([writer]) if writer else {}))
            if self._publish(new):
                return new
        raise Conflict(f"{self.path}: {TRIES} commits of others came first")

    # Reading

    def read(self, first: int | None = None, end: int | None = None, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The table, or its years first to end - 1; other years' files aren't even listed. version: as it was then."""
        now = self.manifest(version)
        known = StructType.fromJson(json.loads(now.schema)) if now.schema else schema
        if known is None:
            raise ValueError(f"{self.path} has no runs yet: say what columns it has")
        bounded = first is not None or end is not None

        def wanted(year: str) -> bool:
            if year == _NULL_YEAR:
                return not bounded
            return (first is None or int(year) >= first) and (end is None or int(year) < end)

        chosen = {y: r for y, r in now.years.items() if wanted(y)}
        return self._table(now, chosen) if chosen else self.spark.createDataFrame([], known)

    def _table(self, now: Manifest, years: dict[str, list[str]]) -> DataFrame:
        known = StructType.fromJson(json.loads(now.schema))
        folders = [f"{self.path}/data/run={run}/{self.year}={y}" for y, runs in sorted(years.items()) for run in runs]
        held = self.spark.read.schema(known).option("basePath", f"{self.path}/data").parquet(*folders)
        return held.select(*(F.col(f"`{c}`") for c in known.fieldNames()))

    def rows_by_year(self) -> DataFrame:
        """(year, count)."""
        return self.read().groupBy(self.year).agg(F.count(F.lit(1)).alias("count"))

    # Leftovers

    def clean(self, keep: int = 1, older_than: float = 7 * 86400) -> list[str]:
        """Delete manifests but the last ``keep``, and runs that none of these names; the runs deleted.

        Files of a run that is still writing look like those of one that has failed, so only
        folders that have not changed for ``older_than`` seconds go.
        """
        versions = self.versions()
        kept, gone = versions[-max(1, keep) :], versions[: -max(1, keep)]
        used = {run for v in kept for runs in self.manifest(v).years.values() for run in runs}
        for v in gone:
            self._fs.delete(self._file(self._log_file(v)), False)
        before = (time.time() - older_than) * 1000
        deleted = []
        data = self._file(f"{self.path}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            run = status.getPath().getName().partition("=")[2]
            if run not in used and status.getModificationTime() <= before:
                self._fs.delete(status.getPath(), True)
                deleted.append(run)
        return sorted(deleted)
