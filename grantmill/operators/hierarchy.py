"""Category trees as tables: parents from a level sequence, ancestors, descendants, labels with a fallback."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import columns as C
from ..session import stored
from .relational import running_sum, union_all

#: Code and level of a class's root.
ROOT, ROOT_LEVEL = "root", -1


def unique_codes(rows: DataFrame, group: str = "cat_id", seq: str = "seq", code: str = "code") -> DataFrame:
    """Null codes become empty, dots go; a code used before becomes that of the row before (as it is now) with '_next'.

    So a run of repeated codes bears the code of the last new one, with '_next' for each of them.
    """
    plain = rows.withColumn(code, F.replace(F.coalesce(F.col(code), F.lit("")), F.lit("."), F.lit("")))
    again = plain.withColumn("_again", F.row_number().over(Window.partitionBy(group, code).orderBy(seq)) > 1)
    so_far = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    runs = again.withColumns({"_run": F.count_if(~F.col("_again")).over(so_far), "_code": F.last(F.when(~F.col("_again"), F.col(code)), ignorenulls=True).over(so_far)})
    n = F.row_number().over(Window.partitionBy(group, "_run").orderBy(seq)) - 1
    return runs.withColumn(code, F.concat("_code", F.repeat(F.lit("_next"), n))).drop("_again", "_run", "_code")


def with_parent(rows: DataFrame, group: str = "cat_id", seq: str = "seq", level: str = "level", code: str = "code") -> DataFrame:
    """parent_code: the nearest row before, in its group, with a lower level; null at the top, and where the level is null.

    A schedule may be of any length: rows are dealt by ranges of (group, seq). A first pass over each
    range finds the parents within it, with a stack of the rows that still can be parents, and leaves
    the stack of its last group: the range's summary. Rows at the head of a range, whose parent stands
    in a range before, ask the summaries, which are folded in order, group by group; so what is gathered
    has at most one row for each range and level. Rows of one seq stand by falling level, then by code, so none is the
    parent of another of them, and the result depends on the rows only.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    extra = StructType.fromDDL("parent_code string, _part int, _open boolean, _summary boolean")
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields), *extra.fields])
    names = rows.columns
    places = [names.index(c) for c in (group, seq, level, code)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, now, stack = None, None, []
        example = None
        for batch in batches:
            example = batch if example is None else example
            parents, opened = [], []
            for g, s, at, c in zip(*(batch.column(k).to_pylist() for k in places)):
                g = (g,)
                first = g if first is None else first
                if g != now:
                    now, stack = g, []
                if at is None:
                    parents.append(None)
                    opened.append(False)
                    continue
                while stack and stack[-1][1] >= at:
                    stack.pop()
                parents.append(stack[-1][2] if stack else None)
                opened.append(not stack and g == first)
                stack.append((s, at, c))
            yield finished(batch, parents, part, opened, False)
        if stack:
            own = {group: [now[0]] * len(stack), seq: [x[0] for x in stack], level: [x[1] for x in stack], code: [x[2] for x in stack]}
            columns = [pa.array(own.get(n, [None] * len(stack)), example.schema.field(n).type) for n in names]
            yield finished(pa.RecordBatch.from_arrays(columns, names=names), [None] * len(stack), part, [False] * len(stack), True)

    def finished(batch: pa.RecordBatch, parents: list, part: int, opened: list[bool], summary: bool) -> pa.RecordBatch:
        n = batch.num_rows
        more = [pa.array([None if p is None else str(p) for p in parents], pa.string()), pa.array([part] * n, pa.int32()), pa.array(opened, pa.bool_()), pa.array([summary] * n, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *extra.fieldNames()])

    dealt = rows.repartitionByRange(parts, group, seq).sortWithinPartitions(group, seq, F.col(level).desc(), code)
    held = stored(dealt.mapInArrow(run, schema), "parents")
    asked = [F.col(group).alias("_g"), "_part", F.col(level).cast("double").alias("_level")]
    summaries = held.where("_summary").select(*asked, F.col(code).cast("string").alias("_code"))
    questions = held.where("NOT _summary AND _open").select(*asked).distinct()

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        stack, out = [], []  # (level, code), levels ascending
        for part, own in frame.sort_values("_part").groupby("_part"):
            for at in own[own["_code"].isna() & own["_question"]]["_level"]:
                k = bisect.bisect_left(stack, at, key=lambda x: x[0])
                if k:
                    out.append((part, at, stack[k - 1][1]))
            ends = own[~own["_question"]].sort_values("_level")  # a stack's levels rise with seq
            if len(ends):
                lowest = ends["_level"].min()
                stack = [x for x in stack if x[0] < lowest] + [*zip(ends["_level"], ends["_code"])]
        found = pd.DataFrame(out, columns=["_part", "_level", "_parent"])
        found.insert(0, "_g", pd.Series([key[0]] * len(found), dtype=object))
        return found

    kind = held.schema[group].dataType.simpleString()
    both = summaries.withColumn("_question", F.lit(False)).unionByName(questions.withColumn("_question", F.lit(True)), allowMissingColumns=True)
    answers = stored(both.groupBy("_g").applyInPandas(fold, f"_g {kind}, _part int, _level double, _parent string"), "answers")
    rest = held.where("NOT _summary").drop("_summary")
    joined = rest.join(answers.withColumnRenamed("_part", "_of"), F.col("_open") & F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_of")) & (F.col(level).cast("double") == F.col("_level")), "left")
    return joined.withColumn("parent_code", F.coalesce("parent_code", "_parent")).select(*names, "parent_code")


def class_tree(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The closure of class schedules (cat_id, seq, code, level, name), each under a root that bears the class's title.

    classes: cat_id, cat_name; a class that it lacks has a root without a name. Codes are made unique.
    """
    unique = unique_codes(rows).select("cat_id", F.col("seq").cast("long").alias("seq"), F.col("level").cast("int").alias("level"), "code", "name")
    titles = rows.select("cat_id").distinct().join(classes.select("cat_id", "cat_name"), "cat_id", "left")
    roots = titles.select("cat_id", F.lit(-1).cast("long").alias("seq"), F.lit(ROOT_LEVEL).alias("level"), F.lit(ROOT).alias("code"), F.coalesce("cat_name", F.lit("")).alias("name"))
    return closure(with_parent(roots.unionByName(unique)))


def closure(nodes: DataFrame, group: str = "cat_id", code: str = "code", name: str = "name", parent: str = "parent_code") -> DataFrame:
    """nodes with ancestor_codes and ancestor_names, root first, the node last.

    One join for each level, each on the stored level before; nodes that no root
    reaches (a parent that is missing, or a circle) are left out.
    """
    base = stored(nodes.select(group, code, name, parent), "tree")
    layer = base.where(F.col(parent).isNull()).withColumns({"ancestor_codes": F.array(code), "ancestor_names": F.array(name)})
    layers = []
    while layer.take(1):
        layers.append(layer)
        up = layer.select(F.col(group).alias("_g"), F.col(code).alias("_c"), F.col("ancestor_codes").alias("_codes"), F.col("ancestor_names").alias("_names"))
        below = base.join(up, (F.col(group) == F.col("_g")) & (F.col(parent) == F.col("_c")))
        layer = stored(below.select(group, code, name, parent, F.concat("_codes", F.array(code)).alias("ancestor_codes"), F.concat("_names", F.array(name)).alias("ancestor_names")), "tree-level")
    return union_all(layers or [layer])


def descendants(tree: DataFrame, code: str) -> DataFrame:
    """Nodes of which the code is an ancestor, itself included; a root is no node."""
    return tree.where(F.array_contains("ancestor_codes", code) & (F.col("code") != ROOT))


def intervals(nodes: DataFrame, group: str = "cat_id", code: str = "code", parent: str = "parent_code", order: str | None = None) -> DataFrame:
    """(group, code, depth, first, last): each node's number in pre-order and the last number below it, from 0 in each group.

    A node lies below another if its ``first`` is within the other's first to last. Numbers come from
    pointer doubling: in round i a node's pointer leads 2^i nodes up, and sizes, depths and then places are
    summed along the pointers, so a tree of depth d takes log2(d) rounds of joins, each stored. Leaves, most of
    the nodes, stay out of these rounds: they are counted at their parents and placed at the end. Siblings
    stand by ``order`` (by default their code); their sizes are summed by ranges, so a node may have any
    number of children. Codes must be unique in a group; nodes that no root reaches are left out.
    """
    place = F.col(code if order is None else order)
    base = stored(nodes.select(F.col(group).alias("g"), F.col(code).alias("c"), F.col(parent).alias("p"), place.alias("o")), "nodes")
    children = base.where("p IS NOT NULL").groupBy(F.col("g").alias("_g"), F.col("p").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    counted = stored(base.join(children, F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")), "left").drop("_g", "_c"), "counted")
    inner, leaves = counted.where("n IS NOT NULL"), counted.where("n IS NULL")
    twigs = leaves.where("p IS NOT NULL").groupBy(F.col("g").alias("_h"), F.col("p").alias("_u")).agg(F.count(F.lit(1)).alias("leaves"))
    known = inner.select(F.col("g").alias("_g"), F.col("c").alias("_c"))
    linked = inner.join(known, F.col("g").eqNullSafe(F.col("_g")) & (F.col("p") == F.col("_c")), "left").join(twigs, F.col("g").eqNullSafe(F.col("_h")) & (F.col("c") == F.col("_u")), "left")
    one = F.col("_c").isNotNull().cast("long")
    state = stored(linked.select("g", "c", F.col("_c").alias("up"), (F.coalesce("leaves", F.lit(0)) + 1).alias("size"), one.alias("depth"), (F.col("p").isNotNull() & F.col("_c").isNull()).alias("lost")), "jump")
    jumps, n = [], state.count()
    while len(jumps) <= max(n, 1).bit_length() and state.where("up IS NOT NULL").take(1):
        jumps.append(state.select("g", "c", "up"))
        below = state.where("up IS NOT NULL").groupBy(F.col("g").alias("_g"), F.col("up").alias("_c")).agg(F.sum("size").alias("_more"))
        over = state.select(F.col("g").alias("_h"), F.col("c").alias("_u"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("lost").alias("_lost"))
        step = state.join(below, F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")), "left").join(over, F.col("g").eqNullSafe(F.col("_h")) & (F.col("up") == F.col("_u")), "left")
        size = F.col("size") + F.coalesce("_more", F.lit(0))
        state = stored(step.select("g", "c", F.col("_up").alias("up"), size.alias("size"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("lost") | F.coalesce("_lost", F.lit(False))).alias("lost")), "jump")
    whole = state.where("NOT lost AND up IS NULL").select(F.col("g").alias("_g"), F.col("c").alias("_c"), "size", "depth")  # a pointer that still leads up leads round a circle
    sized = inner.join(whole, F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c"))).select("g", "c", "p", "o", "size", "depth")
    single = leaves.select("g", "c", "p", "o", F.lit(1).cast("long").alias("size"), F.when(F.col("p").isNull(), 0).cast("long").alias("depth"))
    before = running_sum(sized.unionByName(single), ["g", "p"], ["o", "c"], "size", "before")
    numbered = stored(before.select("g", "c", "p", "size", "depth", (F.col("before") + F.col("p").isNotNull().cast("long")).alias("first")), "numbered")
    hangs = F.col("depth").isNull()  # a leaf below another node
    at = numbered.where(~hangs).select("g", "c", "size", "depth", "first")
    for jump in jumps:
        over = at.select(F.col("g").alias("_h"), F.col("c").alias("_u"), F.col("first").alias("_first"))
        led = jump.where("up IS NOT NULL").join(over, F.col("g").eqNullSafe(F.col("_h")) & (F.col("up") == F.col("_u"))).select(F.col("g").alias("_g"), F.col("c").alias("_c"), "_first")
        at = stored(at.join(led, F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")), "left").select("g", "c", "size", "depth", (F.col("first") + F.coalesce("_first", F.lit(0))).alias("first")), "places")
    over = at.select(F.col("g").alias("_h"), F.col("c").alias("_u"), F.col("first").alias("_first"), F.col("depth").alias("_depth"))
    hung = numbered.where(hangs).join(over, F.col("g").eqNullSafe(F.col("_h")) & (F.col("p") == F.col("_u")))
    at = at.unionByName(hung.select("g", "c", "size", (F.col("_depth") + 1).alias("depth"), (F.col("first") + F.col("_first")).alias("first")))
    return at.select(F.col("g").alias(group), F.col("c").alias(code), "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def below(labelled: DataFrame, tops: DataFrame, group: str = "cat_id", code: str = "code") -> DataFrame:
    """(group, top, code) of all nodes below each top (group, code), itself included; by intervals.

    An interval meets at most two blocks of the power of two next above its size, and each node stands in
    one block of each such size: so the condition on ranges is an equi-join whose candidates are
    at most about four times its rows.
    """
    own = labelled.join(tops.select(group, code).distinct(), [group, code], "left_semi")
    sized = stored(own.select(F.col(group).alias("_g"), F.col(code).alias("top"), F.col("first").alias("_from"), F.col("last").alias("_to"), F.length(F.bin(F.col("last") - F.col("first"))).cast("int").alias("bits")), "tops")
    used = sorted(r[0] for r in sized.select("bits").distinct().collect())  # 64 at most
    blocks = sized.select("*", F.explode(F.array_distinct(F.array(_block("_from", "bits"), _block("_to", "bits")))).alias("block"))
    placed = labelled.select(F.col(group), F.col(code), "first", F.explode(F.array(*(F.lit(b) for b in used)) if used else F.array().cast("array<int>")).alias("bits"))
    placed = placed.withColumn("block", _block("first", "bits"))
    met = placed.join(blocks, F.col(group).eqNullSafe(F.col("_g")) & (placed["bits"] == blocks["bits"]) & (placed["block"] == blocks["block"]))
    return met.where("first >= _from AND first <= _to").select(group, "top", code)


def _block(number: str, bits: str) -> Column:
    return F.call_function("shiftright", F.col(number), F.col(bits))


def label_codes(df: DataFrame, raw: str, tree: DataFrame, classes: DataFrame) -> DataFrame:
    """df with cat_name and status of a raw national code.

    The first reading of the code that the tree has gives the path of names; else
    the first reading whose class is known gives the class title, with status fail.
    Each distinct code is looked up once. classes: cat_id, cat_name.
    """
    codes = df.select(raw).where(F.col(raw).isNotNull() & (F.col(raw) != "[]")).distinct()
    tried = codes.select(raw, F.posexplode(C.uspc_candidates(raw)).alias("pos", "c")).select(raw, "pos", F.col("c.class").alias("cat_id"), F.col("c.subclass").alias("code"))
    paths = tree.select("cat_id", "code", F.concat_ws("||", "ancestor_names").alias("path"))
    found = tried.join(paths, ["cat_id", "code"], "left").join(classes.select("cat_id", "cat_name"), "cat_id", "left")
    rank = F.when(F.col("path").isNotNull(), 0).when(F.col("cat_name").isNotNull(), 1)
    best = found.where(rank.isNotNull()).groupBy(raw).agg(F.min_by(F.struct(F.coalesce("path", "cat_name").alias("label"), F.col("path").isNotNull().alias("ok")), F.struct(rank, "pos")).alias("b"))
    labelled = best.select(F.col(raw).alias("_raw"), F.col("b.label").alias("cat_name"), F.col("b.ok").alias("_ok"))
    out = df.join(labelled, F.col(raw) == F.col("_raw"), "left")
    return out.withColumn("status", F.when(F.coalesce("_ok", F.lit(False)), "success").otherwise("fail")).drop("_raw", "_ok")


def label_ipc(df: DataFrame, raw: str, tree: DataFrame) -> DataFrame:
    """df with ipc_label, the titles from root to node joined; tree: symbol, ancestor_titles."""
    named = tree.select(F.col("symbol").alias("_symbol"), F.concat_ws("||", "ancestor_titles").alias("ipc_label"))
    return df.join(named, C.ipc_code(raw) == F.col("_symbol"), "left").drop("_symbol")


def ipc_nodes(scheme: str) -> list[tuple[str, str | None, str | None]]:
    """(symbol, title, parent_symbol) of a scheme in XML, read once on the driver; titles of several parts joined by ';'."""
    from ..sources.records import Element, parse_tree

    out: list[tuple[str, str | None, str | None]] = []
    symbols = iter(re.findall(r"<ipcEntry\b[^>]*?\bsymbol\s*=\s*\"([^\"]*)\"", scheme, re.I))

    def walk(e: Element, parent: str | None) -> None:
        own = parent
        if e.tag == "ipcentry":
            own = next(symbols)
            body = next((c for c in e.children if isinstance(c, Element) and c.tag == "textbody"), None)
            parts = [] if body is None else body.find_all("titlepart")
            texts = [p.find("text") for p in parts]
            title = None if not texts or None in texts else ";".join(t.text().strip() for t in texts)
            out.append((own, title, parent))
        for c in e.children:
            if isinstance(c, Element):
                walk(c, own)

    walk(parse_tree(scheme), None)
    return out
