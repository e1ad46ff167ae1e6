"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

* *Memtables.* A scan task digests its rows, sorts them by digest and flushes them
  as one run of level 0.
* *Compaction.* Runs are merged FANOUT at a time into sorted runs of the next level,
  until one is left. A merged run has one entry for each digest: the row that stays
  and the number of rows. Partial aggregation sends at most one row for each digest,
  run and task, so a digest that a third of all rows share stays harmless.
* *Filters.* The last run has Bloom filters, of all its digests and of the repeated
  ones: bitmaps of a size that follows the number of digests, up to FILTER_BITS. A
  probe asks the filter first; only what passes meets the run.
* *Byte verification.* Rows whose digest the filter of repeated digests lets pass are
  compared byte by byte as ``min(text) = max(text)``, so unique texts are not
  shuffled (beyond about FILTER_BITS / 16 repeated digests the filter lets more and
  more of them pass). If texts with one digest differ, that digest's rows are grouped
  anew by digest and text.

Defined results: a null text counts as empty; a null doc_id loses to any other;
of equal texts with an equal doc_id one row stays; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that are merged into one of the next level.
FANOUT = 64
#: A bitmap of bitmap_construct_agg has so many bits.
BITMAP = 32768
#: Bits of a filter at most: 32 MB, which every executor holds.
FILTER_BITS = 1 << 28


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; ``lower`` does just that for texts of ASCII only, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class Filter:
    """A Bloom filter with one hash: a bit for each digest, in bitmaps that are broadcast."""

    def __init__(self, keys: DataFrame, n: int, scratch: Scratch, name: str):
        bits = min(FILTER_BITS, max(BITMAP, 1 << (16 * n).bit_length()))
        bit = F.pmod(F.xxhash64("digest"), F.lit(bits))
        self.slot, self.at = F.floor(bit / BITMAP).cast("long"), F.pmod(bit, F.lit(BITMAP))
        self.bitmaps = scratch.save(keys.select(self.slot.alias("slot"), self.at.alias("at")).groupBy("slot").agg(F.bitmap_construct_agg("at").alias("bitmap")), name)

    def may_hold(self, rows: DataFrame) -> DataFrame:
        """The rows whose column digest may be among the keys."""
        byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = (byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))"))) != 0
        filters = F.broadcast(self.bitmaps.select(F.col("slot").alias("_slot"), F.col("bitmap").alias("_bitmap")))
        return rows.withColumns({"_slot": self.slot, "_at": self.at}).join(filters, "_slot").where(is_set).drop("_slot", "_at", "_bitmap")


class MergeIndex:
    """An index over the normalised texts of a table with columns ``doc_id`` and ``text``.

    keep: "largest" or "smallest" doc_id of equal texts. digest: any digest of
    the normalised text; results do not depend on it. fanout: runs that one
    compaction merges.
    """

    def __init__(self, docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = sha256, fanout: int = FANOUT):
        self.keep, self.digest = keep, digest
        self.scratch = Scratch(docs.sparkSession, "exact-dedup")
        self.texts = self._digested(docs)
        self.rows = self._flush()
        self.entries, self.levels, self.n_entries, self.n_repeated = self._compact(fanout)
        self.repeated = self.entries.where("n > 1")
        self.colliding = self._verify()

    def _digested(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("digest", self.digest(F.col("norm")))

    def _flush(self) -> DataFrame:
        """Level 0: a sorted run of each scan task. ``seq`` numbers the rows, once for all."""
        own = [] if self.digest is sha256 else [sha256(F.col("norm")).alias("sha")]
        rows = self.texts.select("doc_id", "digest", F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().alias("run"), *own).sortWithinPartitions("digest")
        return self.scratch.save(rows, "level0")

    def _compact(self, fanout: int) -> tuple[DataFrame, int, int, int]:
        """The last run, how many levels it took, its entries and those of several rows."""
        best = F.max(F.struct("keep_id", -F.col("keep_seq"))) if self.keep == "largest" else F.min(F.struct(F.col("keep_id").isNull(), "keep_id", "keep_seq"))
        keep_id, seq = (F.col("best.keep_id"), -F.col("best.col2")) if self.keep == "largest" else (F.col("best.keep_id"), F.col("best.keep_seq"))
        level, now = 0, self.rows.select("run", "digest", F.col("doc_id").alias("keep_id"), F.col("seq").alias("keep_seq"), F.lit(1).cast("long").alias("n"))
        while True:
            merged = now.withColumn("run", F.floor(F.col("run") / fanout).cast("int")).groupBy("run", "digest").agg(best.alias("best"), F.sum("n").alias("n"))
            now = self.scratch.save(merged.select("run", "digest", keep_id.alias("keep_id"), seq.alias("keep_seq"), "n").sortWithinPartitions("run", "digest"), f"level{level + 1}")
            if level:
                self.scratch.drop(f"level{level}")
            level += 1
            last, n, repeated = now.agg(F.max("run"), F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()
            if not last:
                return now.drop("run"), level, n, repeated

    def _verify(self) -> DataFrame | None:
        """The digests that texts which differ share; None if there are none."""
        if not self.n_repeated:
            return None
        hits = Filter(self.repeated, self.n_repeated, self.scratch, "filter-repeated").may_hold(self.texts)
        spread = hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        bad = self.scratch.save(spread.where("low <> high").select("digest"), "colliding")
        return bad if bad.take(1) else None

    def probe(self, docs: DataFrame) -> DataFrame:
        """Of other documents those whose text the index has: doc_id, found_id (the row that stays there).

        The filter is asked first; what passes meets the run, and what meets it is
        compared byte by byte with the text of the index.
        """
        batch = Filter(self.entries, self.n_entries, self.scratch, f"filter-{uuid.uuid4().hex}").may_hold(self._digested(docs))
        met = batch.join(self.entries.select("digest"), "digest", "left_semi")
        rows = self.texts.select(F.col("doc_id").alias("_id"), F.col("norm").alias("_norm"), F.col("digest").alias("_digest")).join(F.broadcast(met.select("digest").distinct()) if self.n_entries <= BROADCAST_ROWS // 8 else met.select("digest").distinct(), F.col("_digest") == F.col("digest"), "left_semi")
        best = F.max("_id") if self.keep == "largest" else F.min("_id")
        held = rows.groupBy("_digest", "_norm").agg(best.alias("found_id"))
        return met.join(held, (F.col("digest") == F.col("_digest")) & (F.col("norm") == F.col("_norm"))).select("doc_id", "found_id")

    def classes(self) -> DataFrame:
        """A row for each document: doc_id, digest, keep_id, group_size, kept, sha, seq."""
        runs = self.rows if "sha" in self.rows.columns else self.rows.withColumn("sha", F.col("digest"))
        repeated = self.repeated
        if self.colliding is not None:
            runs, repeated = (x.join(self.colliding, "digest", "left_anti") for x in (runs, repeated))
        found = runs.join(repeated, "digest", "left")
        out = found.select(
            "doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"), (F.col("n").isNull() | (F.col("seq") == F.col("keep_seq"))).alias("kept"), "sha",
        )
        return out if self.colliding is None else out.unionByName(self._regrouped())

    def _regrouped(self) -> DataFrame:
        """Rows whose digest is shared by texts that differ, grouped by the texts themselves."""
        rows = self.texts.join(self.colliding, "digest")
        order = F.col("doc_id").desc_nulls_last() if self.keep == "largest" else F.col("doc_id").asc_nulls_last()
        group = Window.partitionBy("digest", "norm")
        best = F.max("doc_id") if self.keep == "largest" else F.min("doc_id")
        return rows.select(
            "doc_id", "digest", best.over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
            (F.row_number().over(group.orderBy(order)) == 1).alias("kept"), sha256(F.col("norm")).alias("sha"),
        )


def exact_groups(docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row for each document with the doc_id that stays for its text."""
    found = MergeIndex(docs, keep, digest).classes()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns; one row of each text."""
    index = MergeIndex(docs, keep)
    gone = index.scratch.save(index.classes().where("not kept").select("doc_id", "digest", "keep_id"), "gone")
    n, ties = gone.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").eqNullSafe(F.col("keep_id")))).first()
    if not n:
        return docs
    same = F.broadcast(gone.select("doc_id", "digest").distinct()) if n <= BROADCAST_ROWS // 8 else gone.select("doc_id", "digest").distinct()
    columns = [docs[c] for c in docs.columns]
    keyed = docs.withColumn("_digest", sha256(ascii_lower(F.coalesce("text", F.lit("")))))
    left = keyed.join(same, keyed["doc_id"].eqNullSafe(same["doc_id"]) & (keyed["_digest"] == same["digest"]), "left_anti")
    if not ties:
        return left.select(*columns)
    # repeated rows: the doc_id that stays is also one that goes; one row of each, combined map-side
    tied = gone.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct()
    again = keyed.join(tied, keyed["doc_id"].eqNullSafe(tied["doc_id"]) & (keyed["_digest"] == tied["digest"]), "left_semi")
    one = again.groupBy(F.col("doc_id").alias("_id"), "_digest").agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return left.select(*columns).unionByName(one.select("_row.*"))
