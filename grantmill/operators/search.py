"""Keyword groups counted over the full text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import automaton

#: Keywords of a group up to which it is searched for as one expression.
MANY = 200

SECTIONS = ("abstract_paras", "claims_claims", "description_paras")


def search(df: DataFrame, groups: Mapping[str, Sequence[str]], sections: Sequence[str] = SECTIONS, blank: bool = False) -> DataFrame:
    """df with keys_hit_<group> (written form to count) and total_counts_<group>; all groups in one pass.

    The sections are glued once. Columns of earlier searches are replaced. A group of more than
    MANY keywords goes through an automaton instead of one alternation; the hits are the same.
    """
    base = df.drop("keys_hit", "total_counts", *(f"{p}_{g}" for g in groups for p in ("keys_hit", "total_counts")))
    found = base.withColumn("_text", C.glue_sections(*sections, blank=blank))
    for g, keys in groups.items():
        if len(keys) > MANY:
            found = automaton.find(found, "_text", keys, f"_hits_{g}")
            found = found.withColumn(f"_hits_{g}", automaton.surfaces(f"_hits_{g}", "_text"))
    few = {g: keys for g, keys in groups.items() if len(keys) <= MANY}
    found = found.withColumns({f"_hits_{g}": C.hits("_text", C.keyword_pattern(keys)) if keys else F.array().cast("array<string>") for g, keys in few.items()})
    out = {f"keys_hit_{g}": C.hit_counts(F.col(f"_hits_{g}")) for g in groups} | {f"total_counts_{g}": F.size(f"_hits_{g}") for g in groups}
    return found.withColumns(out).drop("_text", *(f"_hits_{g}" for g in groups))


def surface_counts(df: DataFrame, key: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """(key, surface, n) of every written form that is hit."""
    hits = df.select(key, F.explode(C.hits(text, C.keyword_pattern(keywords))).alias("surface"))
    return hits.groupBy(key, "surface").agg(F.count(F.lit(1)).alias("n"))


def group_keywords(long: DataFrame, clean: bool = False, compat: bool = False) -> dict[str, list[str]]:
    """(group, pos, keyword) as lists in order; keyword sheets are a few hundred rows."""
    out: dict[str, list[str]] = {}
    for group, keyword in long.orderBy("group", "pos").select("group", "keyword").collect():
        out.setdefault(group, []).append(keyword)
    return {g: C.clean_keywords(k, compat) for g, k in out.items()} if clean else out
