"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Labelled rows that a model is fitted on at most, those with the smallest hash.
MAX_TRAIN_ROWS = 12_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(labels: DataFrame, label: str, rows: int = MAX_TRAIN_ROWS, balanced: bool = False) -> DataFrame:
    """doc_id and y of at most ``rows`` labelled documents outside the held-out fold.

    Of repeated rows of a document the largest label counts; null labels and
    doc_ids don't. balanced: at most half of them of each label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    one = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("_order", F.xxhash64("doc_id"))
    if not balanced:
        return one.orderBy("_order", "doc_id").limit(rows).drop("_order")
    parts = [one.where(F.col("y") == y).orderBy("_order", "doc_id").limit(rows // 2) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("_order")


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = MAX_TRAIN_ROWS, balanced: bool = False) -> DataFrame:
    """The texts of these documents, with y; at most ``rows`` ids are broadcast."""
    chosen = training_rows(labels, label, rows, balanced)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def bounded(rows: DataFrame, most_bytes: int) -> DataFrame:
    """doc_id, text, y of a sample's rows, in order of their hash, as long as their whole texts stay within so many bytes.

    Rows that would go beyond are passed over. Only sizes, one of each row of the
    sample, are looked at on the driver.
    """
    held = Scratch(rows.sparkSession, "sample").save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    sizes = held.select("_row", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id").alias("order"), "doc_id").collect()
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["order"], r["doc_id"], r["_row"])):
        if total + r["size"] <= most_bytes:
            taken.append((r["_row"],))
            total += r["size"]
    if len(taken) == len(sizes):
        return held.drop("_row")
    chosen = rows.sparkSession.createDataFrame(taken, "_row long")
    return held.join(F.broadcast(chosen), "_row").drop("_row")
