"""Matching of feeds to the company master and between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_master(feed: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    """All feed rows with the master's columns, null where there is no match; Spark picks the join by size."""
    return feed.join(master, keys, "left")


def reconcile(feed: DataFrame, master: DataFrame, keys: list[str], active: str, id_column: str) -> DataFrame:
    """Adds company_id and match_status: one active candidate MATCHED, several AMBIGUOUS, none UNMATCHED."""
    one = master.groupBy(*keys).agg(F.count_if(F.col(active)).alias("n_"), F.min(F.when(F.col(active), F.col(id_column))).alias("id_"))
    both = feed.hint("merge").join(one, keys, "left")
    status = F.when(F.col("n_") == 1, "MATCHED").when(F.col("n_") > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    return both.select(*feed.columns, F.when(F.col("n_") == 1, F.col("id_")).alias("company_id"), status.alias("match_status"))


def inherit_by_root(feed: DataFrame, stored: DataFrame, root: list[str], value: str, trigger) -> DataFrame:
    """Adds inherited: rows where ``trigger`` holds take the value of their root if feed and stored rows have exactly one."""
    every = feed.select(*root, value).unionByName(stored.select(*root, value)).where(F.col(value).isNotNull())
    only = every.groupBy(*root).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_")).where("lo_ = hi_")
    both = feed.join(only.select(*root, "lo_"), root, "left")
    return both.select(*feed.columns, F.when(trigger, F.col("lo_")).alias("inherited"))


def find_conflicts(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that both sides map, to different values."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys).where("left_value <> right_value")


def missing_from_source(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(batch.select(*keys), keys, "left_anti")


def require_periods(periods: DataFrame, requested: DataFrame, key: str = "competencia") -> DataFrame:
    """Requested periods that don't exist; a job refuses the whole range unless this is empty."""
    return requested.join(periods.select(key), key, "left_anti")


def unique_active_cnaes(catalog: DataFrame, companies: DataFrame, org: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Distinct active codes of active companies; ``org``: of that tenant's, ``ids``: of these."""
    own = companies.where("active")
    own = own if org is None else own.where(F.col("organization_id") == org)
    own = own if ids is None else own.where(F.col("company_id").isin(*ids))
    return catalog.where("active").join(own.select("company_id"), "company_id", "left_semi").select("cnae").distinct()


def attach_task_company(tasks: DataFrame, snapshots: DataFrame, period: str, period_id) -> DataFrame:
    """Tasks with the lowest company snapshot of their CNPJ; the period's id only for tasks of that period."""
    one = snapshots.groupBy("cnpj").agg(F.min("snapshot_id").alias("snapshot_id"))
    both = tasks.join(one, "cnpj", "left")
    return both.withColumn("period_id", F.when(F.col("period") == F.lit(period), F.lit(period_id)))


def exact_search_result(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted CNAEs with FOUND, NOT_FOUND or AMBIGUOUS."""
    n = results.groupBy("cnae").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "cnae", "left").select("cnae", F.when(F.col("n") == 1, "FOUND").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND").alias("search_status"))


def set_diff(desired: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with op INSERT or DELETE where only one side has them."""
    a, b = desired.select(*keys).distinct(), existing.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("op", F.lit("INSERT")).unionByName(b.join(a, keys, "left_anti").withColumn("op", F.lit("DELETE")))
