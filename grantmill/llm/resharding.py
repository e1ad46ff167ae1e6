"""Resharding by minimum-cost flow.

Given what shard each row is in and capacities of the new shards, the cheapest
flow (moving a byte costs 1, leaving it where it is costs 0) says how many bytes
go from each old shard to each new one. Rows of an old shard stand in a fixed
order of hashed blocks; each flow takes a stretch of that order, so whole blocks
move and only the ends of a stretch split one. What row boundaries leave uneven
is then levelled by further small flows of small rows. Affected shards are then
rewritten: texts are shuffled once, to meet their places, and each task writes its
rows to the shards they belong to.

The flow has one node for each shard, so the driver's part does not depend on
the number of rows. Defined results: a null text has no bytes and counts 1 for
its end, as any row; a null source is a shard name like any other; rows that are
alike in every column are interchangeable; an empty table gives no rows; a caller's
columns shard, slot, old_shard and store_row are left out by ``report``; capacities that cannot hold all rows raise ValueError.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..sources.yearlog import YearLog
from .places import positions
from .store import Scratch

#: A column that tells the rows of a store apart.
KEY = "store_row"
#: Columns of a store without rows.
STORE = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField(KEY, LongType()), StructField("old_shard", IntegerType()), StructField("shard", IntegerType())])


def cheapest_flow(supply: dict[int, int], demand: dict[int, int]) -> dict[tuple[int, int], int]:
    """Units to send from each supply to each demand at least cost: 0 to the same number, else 1.

    Successive shortest paths with potentials over the bipartite network. The
    demand may exceed the supply; less is an error.
    """
    if sum(demand.values()) < sum(supply.values()):
        raise ValueError(f"{sum(supply.values())} units, places for {sum(demand.values())}")
    source, sink = "s", "t"
    arcs: dict = {}

    def arc(u, v, capacity, cost):
        arcs.setdefault(u, {})[v] = [capacity, cost]
        arcs.setdefault(v, {}).setdefault(u, [0, -cost])

    for o, n in supply.items():
        arc(source, ("o", o), n, 0)
        for s in demand:
            arc(("o", o), ("n", s), n, int(o != s))
    for s, n in demand.items():
        arc(("n", s), sink, n, 0)
    potential = dict.fromkeys(arcs, 0)
    left = sum(supply.values())
    while left > 0:
        best, back, heap, tick = {source: 0}, {}, [(0, 0, source)], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for v, (capacity, cost) in arcs[u].items():
                reduced = d + cost + potential[u] - potential[v]
                if capacity > 0 and reduced < best.get(v, 1 << 60):
                    best[v], back[v] = reduced, u
                    tick += 1
                    heapq.heappush(heap, (reduced, tick, v))
        far = max(best.values())
        for v in potential:
            potential[v] += best.get(v, far)
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        sent = min(left, *(arcs[u][v][0] for u, v in path))
        for u, v in path:
            arcs[u][v][0] -= sent
            arcs[v][u][0] += sent
        left -= sent
    return {(o, s): n for s in demand for o in supply if (n := arcs[("n", s)][("o", o)][0]) > 0}


def _stretches(flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard: (end, new shard) in order, what stays first."""
    out: dict[int, list[tuple[int, int]]] = {}
    for (o, s), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        end = out[o][-1][0] if o in out else 0
        out.setdefault(o, []).append((end + n, s))
    return out


def _totals(df: DataFrame, shard: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(shard).agg(F.sum("size")).collect()}


def level(rows: DataFrame, scratch: Scratch, capacities: dict[int, int] | None, shards: int) -> DataFrame:
    """rows (doc_id, size, text_crc32, old) with the new ``shard`` of each.

    capacities: bytes of each new shard, or None for equal ones. Rounds of levelling go on
    until no shard is too full, or until a round that moves any rows that fit makes the fullest no better.
    """
    order = ["doc_id", "text_crc32", "size"]
    sizes = _totals(rows, "old")
    total = sum(sizes.values())
    if not total:
        return rows.withColumn("shard", F.lit(0))
    if capacities is None:
        capacities = {s: total // shards + (s < total % shards) for s in range(shards)}
    if sum(capacities.values()) < total:
        raise ValueError(f"{total} bytes don't fit into {sum(capacities.values())}")
    stretches = _stretches(cheapest_flow(sizes, capacities))
    placed = positions(rows, "old", order, "size")
    shard: Column = F.lit(None).cast("int")
    for o, ends in stretches.items():
        own: Column = F.lit(ends[-1][1])
        for end, s in reversed(ends[:-1]):
            own = F.when(F.col("position") < end, F.lit(s)).otherwise(own)
        shard = F.when(F.col("old") == o, own).otherwise(shard)
    placed = scratch.save(placed.withColumn("shard", shard).drop("position"), "placed")
    last, part = None, 4  # rows of at most a quarter of what is too much, then of a half, then any that fit
    for k in itertools.count():
        now = _totals(placed, "shard")
        over = {s: now.get(s, 0) - c for s, c in capacities.items()}
        worst = max(over.values())
        if last is not None and worst >= last:
            part //= 2
        last = worst
        flow = cheapest_flow({s: n for s, n in over.items() if n > 0}, {s: -n for s, n in over.items() if n < 0}) if worst > 0 else {}
        while part and not placed.where(F.col("size") <= max(1, worst // part)).take(1):
            part //= 2
        if not flow or not part:
            break
        small = F.col("size") <= max(1, worst // part)
        ends = _stretches(flow)
        ranked = positions(scratch.save(placed.where(small & F.col("shard").isin(list(ends))), f"small{k}"), "shard", order, "size")
        to: Column = F.col("shard")
        for s, own_ends in ends.items():
            begin = 0
            for end, t in own_ends:  # only rows that lie wholly within the stretch
                to = F.when((F.col("shard") == s) & (F.col("position") >= begin) & (F.col("position") + F.col("size") <= end), F.lit(t)).otherwise(to)
                begin = end
        moved = ranked.withColumn("shard", to).drop("position")
        placed = scratch.save(placed.where(~(small & F.col("shard").isin(list(ends)))).unionByName(moved), f"level{k}")
        scratch.drop(f"small{k}", f"level{k - 1}" if k else "placed")
    return placed


def reshard(docs: DataFrame, shards: int = 16, old: Column | None = None, capacities: dict[int, int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old, shard and slot of each document.

    old: the shard (0 to shards - 1) a row is in now; by default rows lie by source.
    """
    scratch = Scratch(docs.sparkSession, "reshard")
    old = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(shards)) if old is None else old
    text = F.coalesce("text", F.lit(""))
    key = [KEY] if KEY in docs.columns else []
    rows = docs.select(*key, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.cast("int").alias("old"))
    placed = level(scratch.save(rows, "rows"), scratch, capacities, shards)
    return positions(placed, "shard", ["doc_id", "text_crc32", "size"], name="slot")


def report(docs: DataFrame) -> DataFrame:
    """The rows of a store by source after it is resharded, as its files hold them.

    The store is a log of generations (``sources.yearlog``, by shard instead of by year): its first run
    has the rows by source, its second the affected shards. That one is committed by one manifest, so
    a crash leaves the store as it was, and readers see the old shards or the new ones.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "store")
    source = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(16)).cast("int")
    kept = docs.drop("shard", "slot", KEY, "old_shard")  # the store's own columns
    log = YearLog(spark, scratch.path("files"), "shard", compression="zstd")
    log.write(kept.withColumns({KEY: F.monotonically_increasing_id(), "old_shard": source, "shard": source}))
    lying = log.read(schema=STORE)
    placed = scratch.save(reshard(lying, old=F.col("shard")), "places")
    affected = affected_shards(placed)
    if affected:
        log.write(_placed_rows(lying, placed, affected), covers=affected)
    held = log.read(schema=STORE)
    held = held if "slot" in held.columns else held.withColumn("slot", F.lit(None).cast("long"))
    text = F.coalesce("text", F.lit(""))
    found = held.select(KEY, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
    still = placed.where(~F.col("shard").isin(affected)).select(KEY, F.col("slot").alias("_slot"))  # their files have no slots
    if still.take(1):
        found = found.join(still, KEY, "left").withColumn("slot", F.coalesce("slot", "_slot")).drop("_slot")
    return found.drop(KEY)


def affected_shards(placed: DataFrame) -> list[int]:
    """The shards that rows enter or leave."""
    changed = placed.where("old <> shard")
    return sorted(r[0] for r in changed.select(F.col("old").alias("s")).union(changed.select("shard")).distinct().collect())


def _placed_rows(docs: DataFrame, placed: DataFrame, affected: list[int]) -> DataFrame:
    """The documents of the affected shards with shard and slot, each task's rows in slot order.

    Rows meet their places by KEY, which must be unique; where docs has none, those alike in doc_id, text
    and size are numbered. A shard is written by many tasks, each with some of its slots in order, so no
    task holds a whole shard.
    """
    place = placed.where(F.col("shard").isin(affected))
    if KEY in docs.columns:
        place = place.select(F.col(KEY).alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
        out = docs.join(place, F.col(KEY) == F.col("_key"))
    else:
        text = F.coalesce("text", F.lit(""))
        alike = Window.partitionBy("_id", "_crc", "_size").orderBy(F.lit(0))
        keyed = docs.withColumns({"_id": F.col("doc_id"), "_crc": F.crc32(text.cast("binary")), "_size": (F.octet_length(text) + 1).cast("long")}).withColumn("_nth", F.row_number().over(alike))
        place = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
        place = place.withColumn("_nth", F.row_number().over(alike)).where(F.col("_shard").isin(affected)).toDF("_i", "_c", "_s", "_shard", "_slot", "_n")
        same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_crc") == F.col("_c")) & (F.col("_size") == F.col("_s")) & (F.col("_nth") == F.col("_n"))
        out = keyed.join(place, same).drop("_id", "_crc", "_size", "_nth", "_i", "_c", "_s", "_n")
    out = out.drop("shard", "slot", "_key").withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    return out.sortWithinPartitions("shard", "slot")


def rewrite(docs: DataFrame, placed: DataFrame, target: str) -> list[int]:
    """Write the documents of every shard that rows enter or leave to target/shard=N, in slot order; those shards.

    For plain folders, which other programs may read: shards that nothing enters or leaves keep their
    files; the files of the others are replaced once all are written, so docs may lie in target itself,
    but one folder after another. Where that must not show, use a log, as ``report`` does. placed must be
    a stored table.
    """
    spark, affected = docs.sparkSession, affected_shards(placed)
    written = _placed_rows(docs, placed, affected).write.mode("overwrite")
    written.options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy("shard").parquet(target)
    jvm = spark.sparkContext._jvm
    for s in {*affected} - {r[0] for r in placed.select("shard").distinct().collect()}:  # emptied
        path = jvm.org.apache.hadoop.fs.Path(f"{target}/shard={s}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return affected
