"""The stages from raw records to summary tables, each a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import concordance, hierarchy, relational, search
from ..sources import records

# Fixed value: the category that summaries leave out.
EXCLUDED = "Emission trading,  eg pollution credits"


def parse_year_files(spark: SparkSession, sources: Sequence[tuple[str, str, str | None]], compat: bool = False) -> DataFrame:
    """Records of all formats in one table. sources: (kind, path, mark of SGML files or None)."""
    frames = []
    for kind, path, mark in sources:
        raw = records.scan_text_records(spark, path, compat=compat) if kind == "text" else records.scan_records(spark, path, mark or records.XML_MARK)
        frames.append(records.parse_records(raw, kind, compat))
    return relational.union_all(frames)


def label(df: DataFrame, tree: DataFrame, classes: DataFrame, compiled: DataFrame, code: str = "bio_main-classification_national") -> DataFrame:
    """Category path and concordance topic of every record."""
    plain = df.withColumnRenamed(code, "_code")
    out = concordance.first_match(hierarchy.label_codes(plain, "_code", tree, classes), "_code", compiled)
    return out.withColumnRenamed("_code", code)


def search_stage(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    return search.search(relational.filter_taxonomy(df), groups)


def assignee_map(assignees: DataFrame, documents: DataFrame, countries: DataFrame, order: Sequence[str] = ("rf_id",)) -> DataFrame:
    """One assignment for each granted document, with its country cleaned."""
    joined = relational.join_with_indicator(assignees, documents, ["rf_id"]).drop("matched")
    granted = joined.where(F.col("grant_doc_num").isNotNull() & (F.col("grant_doc_num") != "nan"))
    one = relational.keep_first(granted.withColumn("_doc", C.normalise_doc_id("grant_doc_num")), "_doc", order)
    return one.join(countries, F.col("ee_country") == F.col("raw_country_name"), "left")


def attach_assignees(df: DataFrame, mapped: DataFrame) -> DataFrame:
    """Records with their assignment; countries corrected and assignee names filled from it."""
    mapped = mapped.select("_doc", "ee_name", "ee_country", "Country_Name_Fix", "2_Code_Fix", "3_Code_Fix")
    joined = df.withColumn("doc_id_map", C.normalise_doc_id("`bio_doc-number`")).join(mapped, F.col("doc_id_map") == F.col("_doc"), "left")
    return relational.override_country(joined).drop("_doc", "2_Code_Fix", "3_Code_Fix", "Country_Name_Fix")


def final_table(df: DataFrame, names: DataFrame, excluded: str = EXCLUDED) -> DataFrame:
    """Records with an application year, not of the excluded category, and final_ee_name.

    names: names (unique, checked) and Final_Names; a name that it lacks stays as it is.
    """
    dated = df.where(F.col("application_year").isNotNull())
    named = relational.join_many_to_one(dated, names.select("names", "Final_Names"), [("ee_name", "names")]).drop("names")
    final = named.withColumn("final_ee_name", F.coalesce("Final_Names", "bio_assignee_name")).drop("Final_Names")
    return relational.exclude_category(final, excluded)


COUNTRY_KEYS = ("application_year", "2_Code", "3_Code", "Country_Name")
COMPANY_KEYS = (*COUNTRY_KEYS, "final_ee_name")


def summaries(df: DataFrame, versions: Sequence[str], keys: Sequence[str] = COUNTRY_KEYS) -> DataFrame:
    """Counts and sums of hits by version, keys and whether there are hits: all versions in one scan."""
    totals = df.select(*(F.col(k) for k in keys), *(F.col(f"total_counts_{v}").cast("long").alias(v) for v in versions))
    long = totals.unpivot(list(keys), list(versions), "version", "total_counts").withColumn("count_binary", F.col("total_counts") > 0)
    return relational.count_and_sum(long, ["version", *keys, "count_binary"])


def summarise(df: DataFrame, keys: Sequence[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Counts and sums by keys after an optional step of the caller's."""
    return relational.count_and_sum(df if transform is None else df.transform(transform), keys)


def totals_by_country(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Records by application year and by grant year of each country, years 1976 to 2020; countries go by the grant's year."""
    named = relational.merge_country(relational.keep_small(df), countries).select("application_year", "year", "Country_Name", "`bio_doc-number`")
    sides = [relational.count_by(named.withColumn("year", F.col(c)), ["year", "Country_Name"], "`bio_doc-number`", f"sum_by_{n}_year") for c, n in (("application_year", "application"), ("year", "grant"))]
    return relational.join_one_to_one(*sides, ["year", "Country_Name"]).where("year > 1975 AND year < 2021")
