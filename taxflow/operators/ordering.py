"""Order-sensitive operators: latest rows, islands, sequences, sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``order``, nulls last; rows with a null key are left out.

    An aggregate, so partial maxima are taken before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))])
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    best = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("row_"))
    return best.select(*keys, "row_.*").select(*df.columns)


def latest_run(df: DataFrame, statuses: list[str], time: str, provider: str = "provider") -> DataFrame:
    wanted = df.where(F.col("status").isin(*statuses)).withColumn(provider, F.upper(provider))
    return latest_per_key(wanted, [provider], [time, "run_id"])


def resolve_period(periods: DataFrame, requested: str | None = None) -> DataFrame:
    """One row (competencia, period_id): the requested period, its id null if unknown; else the latest one."""
    if requested is None:
        return periods.orderBy(F.desc("year"), F.desc("month")).limit(1).select("competencia", "period_id")
    found = periods.where(F.col("competencia") == requested)
    return found.agg(F.lit(requested).alias("competencia"), F.min("period_id").alias("period_id"))


def period_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    if first > last:
        raise ValueError("the range is reversed")
    months = F.sequence(F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("period_start")).select(F.date_format("period_start", "yyyy-MM").alias("competencia"), "period_start")


def islands(df: DataFrame, part: list[str], order: list[str], key: Column | str, name: str = "island") -> DataFrame:
    """Adds the number, from 1, of the run of equal keys; a null key joins the run before it, leading ones get 0."""
    w = Window.partitionBy(*part).orderBy(*order)
    filled = df.withColumn("key_", F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = filled.withColumn("new_", (F.col("key_").isNotNull() & ~F.col("key_").eqNullSafe(F.lag("key_").over(w))).cast("int"))
    return changed.withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("key_", "new_")


def sequence_gaps(df: DataFrame, part: list[str], number: str, start: int = 1) -> DataFrame:
    """(part, n, first, last, contiguous): whether the numbers are start, start + 1, ... without repeats."""
    found = df.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("first"), F.max(number).alias("last"), F.count_distinct(number).alias("distinct_")
    )
    good = (F.col("first") == start) & (F.col("last") - F.col("first") + 1 == F.col("n")) & (F.col("distinct_") == F.col("n"))
    return found.select(*part, "n", "first", "last", good.alias("contiguous"))


def normalize_company_cnaes(companies: DataFrame) -> DataFrame:
    """(company_id, cnae, is_primary, position): valid codes of a company, each once, primary first."""
    from taxflow.functions import normalize as N

    every = F.concat(F.array(F.struct(F.col("cnae_principal").alias("raw"), F.lit(True).alias("primary"))), F.transform(F.coalesce("cnaes_secundarios", F.array().cast("array<string>")), lambda x: F.struct(x.alias("raw"), F.lit(False).alias("primary"))))
    rows = companies.select("company_id", F.explode(every).alias("e")).select("company_id", N.normalize_cnae(F.col("e.raw")).alias("cnae"), "e.primary").where("cnae IS NOT NULL")
    one = rows.groupBy("company_id", "cnae").agg(F.max("primary").alias("is_primary"))
    w = Window.partitionBy("company_id").orderBy(F.desc("is_primary"), "cnae")
    return one.withColumn("position", F.row_number().over(w))


def sort_newest(df: DataFrame, time: str, id_column: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(time), F.desc(id_column))


def sort_due(df: DataFrame, due: str, *then: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(due), *then)


def limit_capped(df: DataFrame, requested: int | None, default: int = 5, cap: int = 50) -> DataFrame:
    return df.limit(min(default if requested is None else requested, cap))


def sort_companies(df: DataFrame) -> DataFrame:
    return df.orderBy("name", "company_id")


def sort_periods(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("year"), F.desc("month"))


def sort_cnaes(df: DataFrame) -> DataFrame:
    """Active ones first, primary ones first, then by code."""
    return df.orderBy(F.desc("active"), F.desc("is_primary"), "cnae")


def limit_by_id(df: DataFrame, id_column: str, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("limit must be positive")
    return df.orderBy(id_column).limit(n)


def cnae_counts(companies: DataFrame) -> DataFrame:
    """(company_id, received, invalid): codes that a company names, blank ones left out, and how many aren't seven digits."""
    from taxflow.functions import normalize as N

    every = F.concat(F.array("cnae_principal"), F.coalesce("cnaes_secundarios", F.array().cast("array<string>")))
    named = F.filter(every, lambda x: N.trim_to_null(x).isNotNull())
    return companies.select("company_id", F.size(named).alias("received"), F.size(F.filter(named, lambda x: N.normalize_cnae(x).isNull())).alias("invalid"))
