"""All pairs of names within an edit distance, found by signatures or by an index of positional q-grams.

Distance 1: a name's signatures are what is left without one of its characters, with that
character's place (one replaced) or beside the whole of the other name (one more or less).
Names that share one are within distance 1, so what the equi-join gives is the result, however
alike the names are.

Beyond, and for names of more than LONG characters, by q-grams: names are padded and cut into
overlapping grams of q characters. One edit changes at most q of them, so of two names within
distance k

* the lengths differ by at most k (length bound);
* of the k q + COUNT rarest grams of one of them, and all ties of the last, at least COUNT are
  among those of the other, at places that differ by at most k (prefix, position and count
  bound).

Only these rare grams are indexed. Candidates come from an equi-join on gram and place, one
side standing at each place within k; so a frequent gram is spread over places, and names
that share frequent grams only never meet. Those that meet COUNT times are verified, by
a distance that gives up beyond k. Pairs of names of at most (k - 1) q + COUNT characters may
share too few grams: they meet by an equi-join on what is left when up to k characters are
deleted.

Numbered names (``machine 1``, ``machine 2``, ...) have no rare grams. How often names would meet
is counted first; beyond MEETS times an index row on average, names are cut before their first
digit. Wherever a name is cut, the other can be cut, at most k places off, so that the
distances of both parts add up to that of the names. The different heads, few if names are
numbered, are joined by q-grams; for each pair of heads, tails meet by an equi-join on what
is left when as many characters are deleted as the heads have left over from k.

All of it is built-in expressions; no plan has a nested loop. Defined results: pairs of
different names, each once with a < b (two tables: a of the first, b of the second, equal
names with distance 0); null names are in no pair; the empty name counts as a name.
Distances are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Grams that must meet.
COUNT = 2
#: Characters up to which names have signatures; meetings an index row up to which q-grams are used; names a head must have on average to be joined by heads.
LONG, MEETS, SHARED = 200, 30, 4
_HEAD, _TAIL = "\u0001", "\u0002"


def grams(name: Column, q: int) -> Column:
    """Grams of a padded name, in order."""
    padded = F.concat(F.lit(_HEAD * (q - 1)), name, F.lit(_TAIL * (q - 1)))
    last = F.char_length(padded) - (q - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(padded, i, F.lit(q))))


def _prefixes(names: DataFrame, k: int, q: int) -> DataFrame:
    """(side, name, size, gram, pos) of each name's k q + COUNT rarest grams, and of ties of the last."""
    each = names.select("side", "name", F.posexplode(grams(F.col("name"), q)).alias("pos", "gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.struct("n", "gram").alias("rank"), "pos")
    own = each.join(counts, "gram").groupBy("side", "name").agg(F.array_sort(F.collect_list(entry)).alias("own"))  # as many as the name has
    last = F.coalesce(F.get("own", F.lit(k * q + COUNT - 1)), F.element_at("own", -1))["rank"]
    rare = F.filter("own", lambda x: x["rank"] <= last)
    return own.select("side", "name", F.char_length("name").alias("size"), F.explode(rare).alias("x")).select("side", "name", "size", F.col("x.rank.gram").alias("gram"), F.col("x.pos").alias("pos"))


def _deletions(name: Column, k: int) -> Column:
    """What is left of a name without up to k of its characters."""
    out = last = F.array(name)
    for _ in range(k):
        shorter = F.transform(last, lambda v: F.transform(F.filter(F.sequence(F.lit(0), F.char_length(v)), lambda i: i > 0), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1))))
        last = F.array_distinct(F.flatten(shorter))
        out = F.array_union(out, last)
    return out


def _sides(left: DataFrame, right: DataFrame | None, column: str) -> DataFrame:
    one = left.select(F.lit(0).alias("side"), F.col(column).cast("string").alias("name"))
    both = one if right is None else one.unionByName(right.select(F.lit(1).alias("side"), F.col(column).cast("string").alias("name")))
    return both.where(F.col("name").isNotNull()).distinct()


def _without_one(name: Column) -> Column:
    """What is left of a name without its first, second, ... character."""
    places = F.filter(F.sequence(F.lit(0), F.char_length(name)), lambda i: i > 0)
    return F.transform(places, lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))


def _one_edit(names: DataFrame, two: bool) -> DataFrame:
    """edit_join for distance 1: signatures (rest, at), at being the place of what was replaced, or what is whole: 0 ours, -1 theirs, -2 both.

    Merged, for a scan's size doesn't tell that of its exploded rows, and they would be broadcast.
    """
    name = F.col("name")
    replaced = F.transform(_without_one(name), lambda rest, i: F.struct(rest.alias("rest"), (i + 1).alias("at")))
    shorter = lambda at: F.transform(F.array_distinct(_without_one(name)), lambda rest: F.struct(rest.alias("rest"), F.lit(at).alias("at")))
    whole = lambda at: F.array(F.struct(name.alias("rest"), F.lit(at).alias("at")))
    signed = lambda side, own, *parts: names.where(F.col("side") == side).select(name.alias(own), F.explode(F.concat(*parts)).alias("x")).select(own, "x.rest", "x.at")
    if two:
        met = signed(0, "a", replaced, whole(0), shorter(-1), whole(-2)).hint("merge").join(signed(1, "b", replaced, shorter(0), whole(-1), whole(-2)), ["rest", "at"])
        return met.select("a", "b", F.when(F.col("at") == -2, 0).otherwise(1).cast("long").alias("distance"))
    met = signed(0, "a", replaced, whole(0)).hint("merge").join(signed(0, "b", replaced, shorter(0)), ["rest", "at"]).where((F.col("at") == 0) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).cast("long").alias("distance"))


def _order(two: bool) -> Column:
    return F.lit(True) if two else F.col("a") < F.col("b")


def _by_heads(names: DataFrame, k: int, two: bool, q: int) -> DataFrame | None:
    """edit_join for numbered names; None if heads are too many."""
    head = F.regexp_extract("name", r"^[^0-9]*", 0)
    ours = names.where("side = 0").select(F.col("name").alias("a"), head.alias("head"), F.substr("name", F.char_length(head) + 1).alias("tail"))
    heads = stored(ours.groupBy("head").agg(F.count(F.lit(1)).alias("n")), "heads")
    n, many = heads.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not n or n < SHARED * many:
        return None
    lengths = [r[0] for r in heads.select(F.char_length("head")).distinct().collect()]  # as many as the longest head has characters
    cuts = sorted({n + d for n in lengths for d in range(-k, k + 1) if n + d >= 0})
    cut = names.where(F.col("side") == int(two)).select(F.col("name").alias("b"), F.explode(F.array(*map(F.lit, cuts))).alias("cut")).where(F.col("cut") <= F.char_length("b"))
    theirs = cut.select("b", F.substr("b", F.lit(1), F.col("cut")).alias("other"), F.substr("b", F.col("cut") + 1).alias("tail"))
    pairs = edit_join(heads.select("head"), "head", k, theirs.select(F.col("other").alias("head")), q, cut=False)
    pairs = stored(pairs.select(F.col("a").alias("head"), F.col("b").alias("other"), (k - F.col("distance")).alias("left")), "head-pairs")

    def rests(tails: DataFrame) -> DataFrame:
        """Each row once for each rest of its tail; used: how many characters were deleted."""
        some = F.lit(None).cast("array<string>")
        for r in range(k, -1, -1):
            some = F.when(F.col("left") == r, _deletions(F.col("tail"), r)).otherwise(some)
        out = tails.withColumn("rest", F.explode(some)).withColumn("used", F.char_length("tail") - F.char_length("rest"))
        return out.drop("tail")

    most = pairs.groupBy("head").agg(F.max("left").alias("left"))
    one = rests(ours.join(most, "head")).select("a", "head", "rest", F.col("used").alias("used_a"))
    other = rests(theirs.join(pairs, "other")).select("b", "head", "rest", "left")
    met = one.hint("merge").join(other, ["head", "rest"]).where(_order(two) & (F.col("used_a") <= F.col("left"))).select("a", "b", F.levenshtein("a", "b", k).cast("long").alias("distance"))
    return met.where("distance >= 0").distinct()


def edit_join(left: DataFrame, column: str, k: int, right: DataFrame | None = None, q: int = 3, cut: bool = True) -> DataFrame:
    """(a, b, distance) of all pairs of names of one table, or of two, within edit distance k. cut: numbered names may be joined by their heads."""
    names = stored(_sides(left, right, column), "names")
    two = right is not None
    if k != 1:
        return _by_grams(names, k, two, q, cut)
    size = F.char_length("name")
    short = _one_edit(names.where(size <= LONG + k), two)
    if not names.where(size > LONG).take(1):
        return short
    return short.where(F.least(F.char_length("a"), F.char_length("b")) <= LONG).unionByName(_by_grams(names.where(size > LONG), k, two, q, False))


def _by_grams(names: DataFrame, k: int, two: bool, q: int, cut: bool) -> DataFrame:
    index = stored(_prefixes(names, k, q), "gram-index")
    near = F.explode(F.sequence(F.col("pos") - k, F.col("pos") + k)).alias("pos")
    if cut:
        counts = stored(index.groupBy("side", "gram", "pos").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
        mine = counts.where("side = 0").select("gram", "n", near)
        others = counts.where(F.col("side") == int(two)).select("gram", "pos", F.col("n").alias("m"))
        meets = mine.join(others, ["gram", "pos"]).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
        rows = counts.agg(F.sum("n")).first()[0] or 0
        found = _by_heads(names, k, two, q) if meets > MEETS * rows else None
        if found is not None:
            return found
    ours = index.where("side = 0").select(F.col("name").alias("a"), F.col("size").alias("size_a"), "gram", near)
    theirs = index.where(F.col("side") == int(two)).select(F.col("name").alias("b"), F.col("size").alias("size_b"), "gram", "pos")
    met = ours.join(theirs, ["gram", "pos"]).where(_order(two) & (F.abs(F.col("size_a") - F.col("size_b")) <= k)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COUNT)
    short = names.where(F.char_length("name") <= (k - 1) * q + COUNT).select("side", "name", F.explode(_deletions(F.col("name"), k)).alias("rest"))
    small = short.where("side = 0").select(F.col("name").alias("a"), "rest").join(short.where(F.col("side") == int(two)).select(F.col("name").alias("b"), "rest"), "rest")
    # Stored, for else the distance would be taken wherever two grams meet.
    candidates = stored(met.select("a", "b").unionByName(small.where(_order(two)).select("a", "b")).distinct(), "candidates")
    distance = F.levenshtein("a", "b", k).cast("long")
    return candidates.withColumn("distance", distance).where("distance >= 0")
