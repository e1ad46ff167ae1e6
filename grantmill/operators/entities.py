"""Company names: cleaned by rules, compared in pairs, clustered, given a standard name."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .relational import unordered_pairs

#: Names that are clustered at once: the method holds a dense matrix of them.
MAX_CLUSTER_NAMES = 4_000


def normalise_names(df: DataFrame, column: str = "names") -> DataFrame:
    """names_v1: rules and legal forms; names_v2: without generic words too."""
    first = df.withColumn("names_v1", C.clean_name_with_fallback(column))
    return first.withColumn("names_v2", C.generic_free_name("names_v1"))


@lru_cache(20_000)
def _letters(text: str) -> Counter:
    return Counter(text)


@lru_cache(20_000)
def _words(text: str) -> frozenset[str]:
    return frozenset(text.lower().split())


def ratio(a: str, b: str, above: float = -1.0) -> float:
    """Twice the matching characters by all characters, in percent; 0 where it can't be ``above``, by lengths or letters."""
    if not a and not b:
        return 0.0
    a, b = sorted((a, b))  # so that the order of a pair does not matter
    total = len(a) + len(b)
    if 200 * min(len(a), len(b)) <= above * total or above > 0 and 200 * (_letters(a) & _letters(b)).total() <= above * total:
        return 0.0
    return 100 * SequenceMatcher(None, a, b, autojunk=False).ratio()


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer of its length."""
    short, long = sorted((a, b), key=lambda x: (len(x), x))
    if not short:
        return 0.0
    best = 0.0
    starts = dict.fromkeys(max(0, j - i) for i, j, _ in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks())
    for start in starts:
        best = max(best, ratio(short, long[start : start + len(short)], best))
        if best > 99.5:
            return 100.0
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared words, shared and own words of either."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    best = 0.0
    for p, q in [*([(both, one), (both, two)] if both else []), (one, two)]:
        best = max(best, ratio(p, q, best))
        if best >= 100:
            break
    return best


def similarity(a: str, b: str) -> float:
    """Harmonic mean of token-set and partial ratio, each a little above 0."""
    s, t = (round(r) + 1e-9 for r in (token_set_ratio(a, b), partial_ratio(a, b)))
    return 2 * s * t / (s + t)


def pair_similarity(names: DataFrame, column: str, block=None) -> DataFrame:
    """(a, b, sim) of all unordered pairs of distinct names; ``block`` as in unordered_pairs."""

    def run(frames):
        for frame in frames:
            frame["sim"] = [similarity(a, b) for a, b in zip(frame["a"], frame["b"])]
            yield frame

    return unordered_pairs(names, column, block).repartition("a", "b").mapInPandas(run, "a string, b string, sim double")


def affinity_propagation(s: np.ndarray, preference: float, damping: float = 0.5, rounds: int = 200, calm: int = 15) -> np.ndarray:
    """Cluster number of each point by passing responsibilities and availabilities; no noise is added."""
    n = len(s)
    if n == 1:
        return np.zeros(1, int)
    s = s.astype(float).copy()
    np.fill_diagonal(s, preference)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    every, last, same = np.arange(n), None, 0
    for _ in range(rounds):
        total = a + s
        first = total.argmax(axis=1)
        top = total[every, first].copy()
        total[every, first] = -np.inf
        new = s - top[:, None]
        new[every, first] = s[every, first] - total.max(axis=1)
        r = damping * r + (1 - damping) * new
        positive = np.maximum(r, 0)
        np.fill_diagonal(positive, r.diagonal())
        new = positive.sum(axis=0)[None, :] - positive
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
        exemplars = np.flatnonzero((a + r).diagonal() > 0)
        same = same + 1 if last is not None and np.array_equal(exemplars, last) else 0
        last = exemplars
        if same >= calm and len(exemplars):
            break
    if not len(last):
        return np.full(n, -1)
    nearest = s[:, last].argmax(axis=1)
    nearest[last] = np.arange(len(last))
    return nearest


def cluster_names(pairs: DataFrame, preference: float = 50.0) -> DataFrame:
    """(CompanyName, cluster). The list of names is one that a count threshold has cut; its size is checked."""
    size = pairs.select("a").union(pairs.select("b")).distinct().count()
    if size > MAX_CLUSTER_NAMES:
        raise ValueError(f"{size} names: cut the list by count or compare within blocks and cluster each")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*frame["a"], *frame["b"]})
        place = {x: k for k, x in enumerate(names)}
        s = np.full((len(names), len(names)), 0.0)
        i, j = frame["a"].map(place).to_numpy(), frame["b"].map(place).to_numpy()
        s[i, j] = s[j, i] = frame["sim"].to_numpy()
        np.fill_diagonal(s, 100.0)
        return pd.DataFrame({"CompanyName": names, "cluster": affinity_propagation(s, preference)})

    return pairs.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "CompanyName string, cluster int")


def longest_common(a: str, b: str) -> str:
    """The longest string that both hold; of several the one that comes first in a.

    a's substrings as an automaton, whose states know where they first end; b runs through it.
    """
    links, lengths, first, steps = [-1], [0], [-1], [{}]
    last = 0
    for i, ch in enumerate(a):
        new = len(links)
        links.append(0), lengths.append(lengths[last] + 1), first.append(i), steps.append({})
        p = last
        while p >= 0 and ch not in steps[p]:
            steps[p][ch] = new
            p = links[p]
        if p >= 0:
            q = steps[p][ch]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                links.append(links[q]), lengths.append(lengths[p] + 1), first.append(first[q]), steps.append(dict(steps[q]))
                links[q] = links[new] = len(links) - 1
                while p >= 0 and steps[p].get(ch) == q:
                    steps[p][ch] = len(links) - 1
                    p = links[p]
        last = new
    state, n, best, end = 0, 0, 0, 0
    for ch in b:
        while state and ch not in steps[state]:
            state = links[state]
            n = lengths[state]
        if ch in steps[state]:
            state, n = steps[state][ch], n + 1
            if n > best or n == best and first[state] < end:
                best, end = n, first[state]
        else:
            n = 0
    return a[end + 1 - best : end + 1] if best else ""


def standard_names(clusters: DataFrame) -> DataFrame:
    """(CompanyName, cluster, StandardName): what most pairs of names of the cluster share at longest, ties joined by ';'.

    Ties stand in the order of the pairs that show them first. A single name, or
    names that share nothing, give the first name.
    """

    @F.pandas_udf("string")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_common(x, y) for x, y in zip(a, b)])

    one, two = clusters.select("cluster", F.col("CompanyName").alias("a")), clusters.select("cluster", F.col("CompanyName").alias("b"))
    found = one.join(two, "cluster").where("a < b").withColumn("text", shared("a", "b")).where("text <> ''")
    counts = found.groupBy("cluster", F.btrim("text", F.lit(" \t\r\n")).alias("text")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b")).alias("seen"))
    most = counts.withColumn("most", F.max("n").over(Window.partitionBy("cluster"))).where("n = most")
    named = most.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "text"))), lambda x: x["text"]), ";").alias("_name"))
    firsts = clusters.groupBy("cluster").agg(F.min("CompanyName").alias("_first"))
    names = firsts.join(named, "cluster", "left").select("cluster", F.coalesce("_name", "_first").alias("StandardName"))
    return clusters.join(names, "cluster").select("CompanyName", "cluster", "StandardName")


def resolve(distribution: DataFrame, least: int = 20, preference: float = 50.0) -> DataFrame:
    """All steps: (names, count, names_v1, names_v2, cluster, StandardName); names rarer than ``least`` have no cluster."""
    named = normalise_names(distribution)
    pairs = pair_similarity(named.where(F.col("count") > least), "names_v2")
    clusters = standard_names(cluster_names(pairs, preference))
    return named.join(clusters, F.col("names_v2") == F.col("CompanyName"), "left").drop("CompanyName").orderBy(F.asc_nulls_last("cluster"), "names")
