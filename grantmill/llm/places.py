"""Positions of rows within groups that may be of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, while the number of blocks stays under MAX_BLOCKS.
BLOCK_ROWS = 1024
MAX_BLOCKS = 1 << 16


def positions(df: DataFrame, group: str, order: list[str], weight: str | None = None, name: str = "position") -> DataFrame:
    """df with the sum of ``weight`` (None: 1 for each row) over the rows of its group that come before.

    df must be a stored table, for it is read three times. Groups are split by a
    hash of ``order`` into blocks of about BLOCK_ROWS rows; only block sums
    (at most MAX_BLOCKS plus one for each group) are gathered and broadcast, and
    only within blocks are rows sorted. The number of groups must be bounded.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    all_rows = Window.partitionBy()
    sizes = sizes.withColumn("_blocks", F.ceil(F.col("_rows") / F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.sum("_rows").over(all_rows) / MAX_BLOCKS))))
    sizes = F.broadcast(sizes.select(F.col(group).alias("_group"), "_blocks"))
    dealt = df.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_block", F.pmod(F.xxhash64(*order), F.col("_blocks"))).drop("_blocks", "_group")
    sums = dealt.groupBy(group, "_block").agg(F.sum(one).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sums.select(F.col(group).alias("_group"), F.col("_block").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")))
    within = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_end", F.sum(one).over(within))
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of")))
    return joined.withColumn(name, F.col("_start") + F.col("_end") - one).drop("_block", "_of", "_group", "_start", "_end")
