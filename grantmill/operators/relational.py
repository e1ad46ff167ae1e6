"""Projections, filters, joins, aggregations and reshaping on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored

# Projections and filters


def keep_simple(df: DataFrame, columns: Sequence[str], total: str) -> DataFrame:
    """Columns, the year of bio_date, whether there are hits, the total as ``total_counts``."""
    return df.select(*columns, C.process_year("bio_date").alias("year"), F.col(total).alias("total_counts"), (F.col(total) > 0).alias("count_binary"))


def keep_small(df: DataFrame, drop: Sequence[str] = ("abstract_paras", "description_paras", "claims_claims")) -> DataFrame:
    """Without texts, with year (of the grant), application_year and one country code."""
    return df.drop(*drop).withColumns({
        "year": C.process_year("bio_date"),
        "application_year": C.process_year("bio_application_date"),
        "bio_assignee_country": C.consolidate_country("bio_assignee_country", "bio_applicant_country", "bio_country"),
    })


def filter_taxonomy(df: DataFrame, column: str = "est_description") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def kept_and_total(df: DataFrame, key: str, column: str = "est_description") -> DataFrame:
    """For each key the rows with a label and all rows, in one aggregation."""
    return df.groupBy(key).agg(F.count(column).alias("kept"), F.count(F.lit(1)).alias("total"))


def without_national(df: DataFrame, national: str = "bio_main-classification_national", ipc: str = "bio_main-classification_ipc") -> DataFrame:
    """Records that have an IPC code but no national one."""
    return df.where(F.col(f"`{national}`").isNull() & F.col(f"`{ipc}`").isNotNull())


def exclude_category(df: DataFrame, text: str, column: str = "est_description") -> DataFrame:
    """Without rows whose category has the literal text; rows without a category stay."""
    return df.where(F.col(column).isNull() | ~F.contains(F.col(column), F.lit(text)))


def positive_with_totals(df: DataFrame, total: str = "total_counts") -> tuple[DataFrame, DataFrame]:
    """Rows with hits; one row of all rows and rows with hits."""
    return df.where(F.col(total) > 0), df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(total) > 0).alias("with_hits"))


# Joins


class NotUnique(ValueError):
    """The right side of a many-to-one join has a key twice."""


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    twice = df.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise NotUnique(f"{list(keys)} not unique: {twice[0].asDict()}")


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]] | Sequence[str], how: str = "left") -> DataFrame:
    """An equi-join that fails unless the right side's keys are unique; so the left side's row count stays."""
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    require_unique(right, [r for _, r in pairs])
    side = right.withColumnsRenamed({r: f"_{r}" for _, r in pairs})
    condition = [F.col(a) == F.col(f"_{b}") for a, b in pairs]
    out = left.join(side, condition, how)
    return out.drop(*(f"_{b}" for a, b in pairs if a == b)).withColumnsRenamed({f"_{b}": b for a, b in pairs if a != b})


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    require_unique(left, keys)
    require_unique(right, keys)
    return left.join(right, list(keys), "inner")


def join_with_indicator(left: DataFrame, right: DataFrame, condition: Column | list[str], name: str = "matched") -> DataFrame:
    """A left join that says of each row whether it has found a partner."""
    flagged = right.withColumn("_here", F.lit(True))
    return left.join(flagged, condition, "left").withColumn(name, F.coalesce("_here", F.lit(False))).drop("_here")


def indicator_counts(df: DataFrame, name: str = "matched") -> DataFrame:
    return df.groupBy(name).count()


def membership(df: DataFrame, keys: DataFrame, column: str, name: str = "is_member") -> DataFrame:
    """Whether the column's value is among the keys (one column of the same name)."""
    return join_with_indicator(df, keys.select(column).distinct(), [column], name)


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is wanted and not yet done."""
    return wanted.join(done, list(keys), "left_anti")


def merge_country(df: DataFrame, countries: DataFrame, code: str = "bio_assignee_country", year: str = "year", change: int = 1979) -> DataFrame:
    """Country names by code; before ``change`` by the old code, which is then 2_Code.

    countries: 2_Code, 2_Code_old, 3_Code, Country_Name.
    """
    sides = [countries.select(F.col(c).alias("_code"), F.lit(c == "2_Code_old").alias("_old"), F.col(c).alias("2_Code"), "3_Code", "Country_Name") for c in ("2_Code", "2_Code_old")]
    versions = sides[0].unionByName(sides[1])
    old = F.coalesce(F.col(year) < change, F.lit(False))
    return df.join(versions, (F.col(code) == F.col("_code")) & (old == F.col("_old")), "left").drop("_code", "_old")


def override_country(df: DataFrame) -> DataFrame:
    """The assignment's corrected country where it is known and the record has no assignee; the name filled alike."""
    known = (F.char_length("ee_country") > 1) & (F.col("ee_country") != "NOT PROVIDED") & F.col("Country_Name_Fix").isNotNull() & (F.col("Country_Name_Fix") != "nan")
    use = F.coalesce(known & F.col("bio_assignee_name").isNull(), F.lit(False))
    fixed = {c: F.when(use, F.col(f"{c}_Fix")).otherwise(F.col(c)) for c in ("Country_Name", "2_Code", "3_Code")}
    return df.withColumns(fixed | {"bio_assignee_name": F.coalesce("bio_assignee_name", "ee_name")})


def unordered_pairs(df: DataFrame, column: str, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """(a, b) with a < b of all distinct values; ``block`` restricts pairs to equal blocks and makes it an equi-join.

    Without a block the number of pairs is n (n - 1) / 2, so it is meant for lists that a count threshold has cut.
    """
    names = df.select(F.col(column).alias("a")).dropna().distinct()
    other = names.withColumnRenamed("a", "b")
    if block is None:
        return names.join(other, F.col("a") < F.col("b"))
    return names.withColumn("_k", block(F.col("a"))).join(other.withColumn("_k", block(F.col("b"))), "_k").where("a < b").drop("_k")


def bucket_join(df: DataFrame, year: str, buckets: Iterable[tuple[int, int]]) -> DataFrame:
    """The bucket (first, last) of each row's year, as a label; rows outside all buckets go. No join is needed."""
    label: Column = F.lit(None).cast("string")
    for a, b in buckets:
        label = F.when(F.col(year).between(a, b), F.lit(f"{a}-{b}")).otherwise(label)
    return df.withColumn("bucket", label).where(F.col("bucket").isNotNull())


# Aggregations


def count_by(df: DataFrame, keys: Sequence[str], counted: str, name: str = "count") -> DataFrame:
    """Non-null counts by keys; groups with a null key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(counted).alias(name))


def count_and_sum(df: DataFrame, keys: Sequence[str], value: str = "total_counts") -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(value).alias(f"{value}_count"), F.sum(value).alias(f"{value}_sum"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), F.asc(column))


def token_counts(df: DataFrame, column: str) -> DataFrame:
    words = df.select(F.explode(F.split(column, r"\s+")).alias("token")).where("token <> ''")
    return words.groupBy("token").count()


def lag_counts(df: DataFrame) -> DataFrame:
    """Records by application year and years until the grant."""
    years = df.select(C.process_year("bio_application_date").alias("application_year"), C.process_year("bio_date").alias("grant_year"), "bio_doc-number")
    return count_by(years.withColumn("gap", F.col("grant_year") - F.col("application_year")), ["application_year", "gap"], "bio_doc-number")


# Ranges of application years that lags are summarised by.
LAG_BUCKETS = [(1976, 1978), (1979, 1982), (1983, 1986), (1987, 1990), (1991, 1994), (1995, 1998), (1999, 2002), (2003, 2006), (2007, 2010), (2011, 2014), (2015, 2018), (2019, 2020)]


def lag_summary(lags: DataFrame, buckets: Sequence[tuple[int, int]] = LAG_BUCKETS, top: int = 7, longest: int = 35, since: int = 1975) -> DataFrame:
    """(bucket, gap, value): the share of each gap (longer ones as '>7'), then 'mean' and 'sd' of the gap, weighted."""
    used = lags.where((F.col("gap") >= 0) & (F.col("gap") < longest) & (F.col("application_year") > since))
    counts = bucket_join(used, "application_year", buckets).groupBy("bucket", "gap").agg(F.sum("count").alias("n"))
    own = counts.groupBy("bucket").agg(F.collect_list(F.struct(F.col("gap").cast("double").alias("gap"), F.col("n").cast("double").alias("n"))).alias("own"))  # no more than the longest gap

    def total(rows: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + value(x))

    def share(name: Column, n: Column) -> Column:
        return F.struct(name.alias("gap"), (n / total(F.col("own"), lambda x: x["n"])).alias("value"))

    short, long = F.filter("own", lambda x: x["gap"] <= top), F.filter("own", lambda x: x["gap"] > top)
    shares = F.concat(
        F.transform(short, lambda x: share(x["gap"].cast("int").cast("string"), x["n"])),
        F.when(F.size(long) > 0, F.array(share(F.lit(f">{top}"), total(long, lambda x: x["n"])))).otherwise(F.array().cast("array<struct<gap:string,value:double>>")),
    )
    all_n = total(F.col("own"), lambda x: x["n"])
    mean, square = total(F.col("own"), lambda x: x["gap"] * x["n"]) / all_n, total(F.col("own"), lambda x: x["gap"] * x["gap"] * x["n"]) / all_n
    moments = F.array(F.struct(F.lit("mean").alias("gap"), mean.alias("value")), F.struct(F.lit("sd").alias("gap"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("value")))
    return own.select("bucket", F.explode(F.concat(shares, moments)).alias("x")).select("bucket", "x.gap", "x.value")


def lag_table(summary: DataFrame, buckets: Sequence[tuple[int, int]] = LAG_BUCKETS) -> DataFrame:
    """One row for each gap, one column for each bucket, four digits."""
    wide = summary.groupBy("gap").pivot("bucket", [f"{a}-{b}" for a, b in buckets]).agg(F.round(F.first("value"), 4))
    return wide.orderBy("gap")


# Ordered operators


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; ``min_by`` combines map-side, so a frequent key stays cheap."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def first_where(df: DataFrame, condition: Column | str, order: Sequence[str]) -> DataFrame:
    """The first row, in the given order, for which the condition holds; none if there is none."""
    return df.where(condition).orderBy(*order).limit(1)


def forward_fill(df: DataFrame, columns: Sequence[str], order: str, partition: Sequence[str] = ()) -> DataFrame:
    """Each column's last value so far, column by column, in the order of a sequence number.

    Without a partition the rows go by ranges of the order, so no task has them all: each range is
    filled on its own, and what is still empty at its head gets the last values of the ranges before.
    """
    if partition:
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in columns})
    lasts = dealt.groupBy("_part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{k}") for k, c in enumerate(columns)))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = lasts.select("_part", *(F.last(f"_last_{k}", ignorenulls=True).over(before).alias(f"_head_{k}") for k in range(len(columns))))
    joined = filled.join(F.broadcast(heads), "_part", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_head_{k}")) for k, c in enumerate(columns)}).select(*df.columns)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows of the same keys (nulls alike) that come before; rows go by ranges.

    A key may have any number of rows: they lie in several ranges, and what each of these begins with comes
    from the ranges' sums, of which only a range's first and last key go on beyond it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *keys, *order).withColumns({"_part": F.spark_partition_id(), "_key": F.struct(*keys)}), "ranges")
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bounds = dealt.groupBy("_part").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    ends = dealt.join(F.broadcast(bounds), "_part").where(F.col("_key").eqNullSafe(F.col("_first")) | F.col("_key").eqNullSafe(F.col("_last")))  # a row for each range was broadcast
    sums = ends.groupBy("_part", "_key").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col("_part").alias("_of"), F.col("_key").alias("_with"), F.sum("_sum").over(earlier).alias("_carry")).where("_carry IS NOT NULL")
    summed = dealt.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = summed.join(F.broadcast(carried), (F.col("_part") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_with")), "left")  # two rows at most for each range
    return joined.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).select(*df.columns, name)


def file_level_year(df: DataFrame, file: str, order: str, date: str = "bio_date") -> DataFrame:
    """The year of each file's first date, on all rows of the file."""
    first = df.where(F.col(date).isNotNull()).groupBy(file).agg(F.min_by(date, order).alias("_date"))
    return df.join(first, file, "left").withColumn("year", C.process_year("_date")).drop("_date")


# Reshaping


def pivot_years(df: DataFrame, rows: Sequence[str], year: str, value: str, how: str = "sum", years: Sequence[int] | None = None) -> DataFrame:
    """Years as columns. how="avg" averages over dimensions that are not among the rows."""
    grouped = df.groupBy(*rows).pivot(year, list(years)) if years is not None else df.groupBy(*rows).pivot(year)
    return grouped.agg({"sum": F.sum, "avg": F.avg}[how](value))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "group", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames one after another by column name; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
