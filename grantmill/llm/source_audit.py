"""How far the sources of a language diverge from each other, and by which words.

* *Counting.* Each task counts occurrences and documents of a term in hash tables, which
  it flushes as rows when they hold MAX_COUNTED terms; those are summed by term, again
  map-side first. Neither a hot source nor a frequent term is a burden.
* *Wide term vectors.* Each kept term of a language becomes one row with an array of its
  counts, indexed by the language's sources in order; whole-number division makes the
  arrays of probabilities.
* *Pair contributions.* For each place of an array, a higher-order function sends the
  rest of the array to contributions; they are summed by (language, place, place), again
  map-side. No row of one term is ever joined with another, and no array is longer than
  the number of sources.
* *Ranks.* The telling terms of a group are cut to TOP before they are shuffled.

Probabilities are whole numbers of a billionth, and every division is one of whole numbers,
done in three steps of a thousand so that nothing overflows below 9 * 10^15 tokens of a
language (beyond, it raises).

Defined results: null text, lang and source count as empty; a document without terms still
makes its group occur; each row is a document, repeated ones too; where a language has no kept
terms all its pairs have value 0; ties of value go by the item's bytes; an empty table gives
no rows; texts of any length are read whole; further columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, Scratch

#: A term is a run of letters and of anything beyond ASCII, A to Z lower-cased; bytes of UTF-8 from 128 on are part of such a character.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Different terms of a group that a task counts before it sends them on.
MAX_COUNTED = 200_000
#: Documents of its language that a kept term is in at least.
LEAST_DOCUMENTS = 10
#: Ranks of telling terms.
TOP = 10


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), by long division with digits of a thousand."""
    below = total + kept * 2
    rest, whole = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + _div(rest, below)
        rest = rest % below
    return whole + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def rows(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            terms = pa.array([*n], pa.binary()).cast(pa.string())
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for x in (lang, source)]
            counts = [pa.array([*n.values()], pa.int64()), pa.array([in_docs[w] for w in n], pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, terms, *counts], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(2)[k].as_py().translate(_LETTERS).split()
                n, in_docs = held.setdefault((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                in_docs.update(set(words))
                size += len(n)
                if size >= MAX_COUNTED:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    counted = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """The tables that both parts of the report stand on; each is written once."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        self.scratch = scratch = Scratch(docs.sparkSession, "source-audit")
        occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        #: lang, source, place: every group, numbered within its language.
        self.groups = scratch.save(occurring.withColumn("place", place), "groups")
        n_groups = self.groups.count()
        self._small = F.broadcast if n_groups <= BROADCAST_ROWS else (lambda side: side)  # a row of a few bytes for each group
        counted = scratch.save(term_counts(docs), "counts")
        sizes = self._small(self.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")))
        entry = F.struct("place", "n")
        of_term = counted.join(self._small(self.groups), ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(entry)).alias("entries"))
        kept = of_term.where(F.col("docs") >= least).join(sizes, "lang")
        #: lang, term, counts: one array of all sources' counts for each kept term.
        self.counts = scratch.save(kept.select("lang", "term", _wide(F.col("entries"), F.col("sources")).alias("counts")), "vectors")
        totals = self.counts.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kept"))
        self.totals = scratch.save(totals, "totals")

    def vectors(self) -> DataFrame:
        """lang, term, counts, p (an array, by place), q (of the language)."""
        one = F.array_sort(F.collect_list(F.struct("place", "total")))
        of_lang = self.totals.groupBy("lang").agg(F.transform(one, lambda x: x["total"]).alias("group_totals"), F.sum("total").alias("lang_total"), F.max("kept").alias("kept"))
        joined = self.counts.join(self._small(of_lang), "lang")
        p = F.zip_with("counts", "group_totals", lambda n, total: probability(n, total, F.col("kept")))
        count = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, n: acc + n)
        return joined.select("lang", "term", "counts", p.alias("p"), probability(count, F.col("lang_total"), F.col("kept")).alias("q"))

    def pairs(self) -> DataFrame:
        """lang, source, item (the other source), value."""
        each = self.vectors().select("lang", F.posexplode("p").alias("place", "own"), "p")
        rest = F.transform(F.slice("p", F.col("place") + 2, F.size("p")), lambda other: divergence(F.col("own"), other))
        sums = each.select("lang", "place", F.posexplode(rest).alias("after", "f")).groupBy("lang", "place", "after").agg(F.sum("f").alias("value"))
        found = self.scratch.save(sums.select("lang", "place", (F.col("place") + F.col("after") + 1).alias("other"), "value"), "pairs")
        names = self.groups.select("lang", "source", "place")
        both = names.join(names.select("lang", F.col("source").alias("item"), F.col("place").alias("other")), "lang").where("place <> other")  # the rows of the result
        low, high = F.least("place", "other"), F.greatest("place", "other")
        known = both.select("lang", "source", "item", low.alias("place"), high.alias("other")).join(found, ["lang", "place", "other"], "left")
        return known.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item (a term that the group has more often than its language), value."""
        places = F.arrays_zip("counts", "p")
        each = self.vectors().select("lang", "term", "q", F.posexplode(places).alias("place", "x")).where("x.counts > 0 AND x.p > q")
        rows = each.select("lang", "place", F.col("term").alias("item"), divergence(F.col("x.p"), F.col("q")).alias("value"))
        return rows.join(self._small(self.groups), ["lang", "place"]).select("lang", "source", "item", "value")


def _wide(entries: Column, size: Column) -> Column:
    """Ascending (place, n) as an array of ``size`` counts."""
    end = F.struct(size.cast("int").alias("place"), F.lit(0).cast("long").alias("n"))
    marked = F.concat(entries, F.array(end))

    def part(x: Column, k: Column) -> Column:
        before = F.when(k == 0, -1).otherwise(F.get(marked, k - 1)["place"])
        return F.concat(F.array_repeat(F.lit(0).cast("long"), x["place"] - before - 1), F.array(x["n"]))

    return F.slice(F.flatten(F.transform(marked, part)), F.lit(1), size.cast("int"))


def report(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    audit = Audit(docs, least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = audit.pairs().withColumn("rank", rank)
    terms = audit.terms().withColumn("rank", rank).where(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
