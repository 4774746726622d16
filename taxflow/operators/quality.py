"""Row validation, quarantine, filters and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxflow.functions import normalize as N
from taxflow.operators.ordering import limit_by_id


def with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``errors``: the names of the rules whose condition is true, in the order given."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows with at least one error."""
    marked = with_errors(df, rules)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def check_context(df: DataFrame, pairs: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose returned values equal the requested ones, and the others; ``pairs``: returned -> requested."""
    same = F.lit(True)
    for returned, requested in pairs.items():
        same = same & F.col(returned).eqNullSafe(F.col(requested))
    return df.where(same), df.where(~same)


def split_not_found(df: DataFrame, message: str = "message") -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(F.contains(F.col(message), F.lit("404")), F.lit(False))
    return df.where(~hit), df.where(hit)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, a row for each; a null condition passes, as in SQL checks."""
    marked = with_errors(df, {name: ~c for name, c in rules.items()})
    return marked.select("*", F.explode("errors").alias("constraint")).drop("errors")


def scope(df: DataFrame, org, active: bool | None = True) -> DataFrame:
    out = df.where(F.col("organization_id") == F.lit(org))
    return out if active is None else out.where(F.col("active") == F.lit(active))


def search_companies(df: DataFrame, term: str, text_columns: list[str], id_column: str) -> DataFrame:
    """Rows that contain the term in a text column, any case, or its digits in the identifier.

    A term without digits matches every identifier that isn't null.
    """
    wanted = term.strip().lower()
    hit = F.coalesce(F.contains(N.digits(id_column), F.lit("".join(ch for ch in wanted if ch.isdigit()))), F.lit(False))
    for c in text_columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return df.where(hit)


def fiscal_only(df: DataFrame) -> DataFrame:
    return df.where((F.col("type") == "O") & ((F.col("mapping_status") == "MAPPED") | (F.col("department") == "FISCAL")))


def is_fresh(now: Column, version: str, force: bool = False) -> Column:
    good = (F.col("parse_status") == "PARSED") & (F.col("expires_at") > now) & (F.col("parser_version") == version)
    return F.coalesce(good, F.lit(False)) & F.lit(not force)


def countable_revenue(df: DataFrame) -> DataFrame:
    """Documents neither cancelled nor substituted; an empty substitute key counts as none."""
    return df.where(~F.coalesce(F.col("cancelled"), F.lit(False)) & (F.coalesce(F.col("substituted_by_key"), F.lit("")) == ""))


def select_candidates(df: DataFrame, company=None, limit: int | None = None) -> DataFrame:
    out = df.where("match_status = 'MATCHED'")
    if company is not None:
        out = out.where(F.col("company_id") == F.lit(company))
    return out if limit is None else limit_by_id(out, "company_id", limit)


def skipped_candidates(df: DataFrame) -> DataFrame:
    """(match_status, n) of the rows that aren't candidates."""
    return df.where("match_status <> 'MATCHED'").groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))


# Fixed value: a code that stands for none.
PLACEHOLDER_CNAES = ("0000000",)


def target_cnaes(found: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    """(position, cnae): the codes to classify, each once and without placeholders.

    ``explicit``: these, in their order; else the distinct codes of ``found`` (cnae) in theirs.
    """
    if explicit:
        spark = found.sparkSession
        rows = spark.createDataFrame([(i, c) for i, c in enumerate(explicit)], "position int, raw string").select("position", F.coalesce(N.normalize_identifier("raw"), "raw").alias("cnae"))
        rows = rows.groupBy("cnae").agg(F.min("position").alias("position"))
    else:
        rows = found.select("cnae").distinct().withColumn("position", F.lit(None).cast("int"))
    return rows.where(F.col("cnae").isNotNull() & ~F.col("cnae").isin(*PLACEHOLDER_CNAES)).select("position", "cnae").orderBy("position", "cnae")


def strip_diagnostics(c, dropped: tuple[str, ...] = ("contract",)) -> Column:
    """Error maps without the entries that only help at development."""
    return F.transform(N.col(c), lambda e: F.map_filter(e, lambda k, v: ~k.isin(*dropped)))


def primary_conflicts(catalog: DataFrame) -> DataFrame:
    """Companies with more than one active primary code."""
    return catalog.where("active AND is_primary").groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# Fixed rules of stored rows, as SQL conditions.
TABLE_RULES = {
    "company_cnae": {"cnae_seven_digits": "cnae RLIKE '^[0-9]{7}$'"},
    "fiscal_period": {"month_range": "month BETWEEN 1 AND 12"},
    "rule_cache": {"cnae_seven_digits": "cnae RLIKE '^[0-9]{7}$'", "parse_status_known": "parse_status IN ('PARSED', 'PARTIAL', 'FAILED')"},
}


def table_violations(df: DataFrame, table: str) -> DataFrame:
    return check_constraints(df, {name: F.expr(rule) for name, rule in TABLE_RULES[table].items()})


def check_pages(df: DataFrame, set_keys: list[str], page: str, key: str, size: int, total: str, max_pages: int = 100) -> DataFrame:
    """(set_keys, n_pages, n_rows, truncated): pages up to the first that is the last; truncated if one repeats or the limit is reached."""
    pages = df.groupBy(*set_keys, page).agg(
        F.count(F.lit(1)).alias("n_"), F.max(total).alias("total_"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "|"), 256).alias("sig_")
    )
    stop = F.when((F.col(page) + 1) * size >= F.col("total_"), F.col(page))
    ends = pages.groupBy(*set_keys).agg(F.min(stop).alias("end_"))
    used = pages.join(ends, set_keys).where((F.col(page) <= F.coalesce("end_", F.lit(2**31 - 1))) & (F.col(page) < max_pages))
    found = used.groupBy(*set_keys).agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n_").alias("n_rows"), F.count_distinct("sig_").alias("distinct_"), F.max(F.col("end_").isNotNull() & (F.col("end_") < max_pages)).alias("ended_")
    )
    return found.select(*set_keys, "n_pages", "n_rows", ((F.col("distinct_") < F.col("n_pages")) | ~F.col("ended_")).alias("truncated"))
