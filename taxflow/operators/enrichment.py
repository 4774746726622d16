"""Which codes a classification run refreshes, and the status of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxflow.functions import normalize as N
from taxflow.operators import quality

# Codes of a run unless it names a number, and at most; statuses of an item for each outcome of a search.
DEFAULT_LIMIT, MAX_LIMIT = 5, 50
OUTCOMES = {"SESSION": "SESSION_NOT_VALID", "TRANSPORT": "TRANSPORT_ERROR", "NOT_FOUND": "CNAE_NOT_FOUND", "AMBIGUOUS": "AMBIGUOUS_CNAE_RESULT"}


def targets(wanted: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """(cnae, position from 1): the codes that take part, each at its first place, digits alone where it has some; placeholders left out.

    A top-k by ``order``, so no more than MAX_LIMIT rows leave it.
    """
    digits = N.digits("cnae")
    code = F.when(digits != "", digits).otherwise(F.col("cnae"))
    first = wanted.select(code.alias("cnae"), F.col(order).alias("at_")).where(F.col("cnae").isNotNull() & ~F.col("cnae").isin(*quality.PLACEHOLDER_CNAES)).groupBy("cnae").agg(F.min("at_").alias("at_"))
    chosen = first.orderBy("at_", "cnae").limit(min(limit or DEFAULT_LIMIT, MAX_LIMIT))
    return chosen.select("cnae", F.row_number().over(Window.orderBy("at_", "cnae")).alias("position"))  # MAX_LIMIT rows at most


def enrichment_items(todo: DataFrame, cache: DataFrame, fetches: DataFrame, parsed: DataFrame, now: Column, version: str, force_refresh: bool = False, cache_only: bool = False) -> DataFrame:
    """(position, cnae, status) of the codes of a run (``targets``), in the order in which it meets them.

    ``cache``: cnae, content_hash, parse_status, parser_version, expires_at.  ``fetches``: cnae, outcome; a code without one is NOT_FOUND.  ``parsed``: cnae,
    content_hash of pages that could be read; a code that was found but has none is PARSE_ERROR.

    Only codes that are valid, not fresh, and not kept from fetching (``cache_only``) are fetched.  The first of them with a session error is
    SESSION_NOT_VALID, and all that would be fetched after it SESSION_EXPIRED, whatever their outcome.
    """
    fresh = cache.withColumn("fresh_", quality.is_fresh(now, version, force_refresh)).select("cnae", "content_hash", "parser_version", "fresh_", F.lit(True).alias("cached_"))
    few = F.broadcast(todo)  # MAX_LIMIT rows at most
    known = todo.join(fresh.join(few, "cnae", "left_semi").hint("merge"), "cnae", "left")
    known = known.join(fetches.join(few, "cnae", "left_semi").groupBy("cnae").agg(F.max("outcome").alias("outcome")).hint("merge"), "cnae", "left")
    known = known.join(parsed.join(few, "cnae", "left_semi").groupBy("cnae").agg(F.max("content_hash").alias("new_hash")).hint("merge"), "cnae", "left")
    cached = F.col("cached_").isNotNull()
    kept = F.when(~F.coalesce(F.col("cnae").rlike("^[0-9]{7}$"), F.lit(False)), "INVALID_CNAE").when(F.coalesce("fresh_", F.lit(False)), "SKIPPED_FRESH_CACHE")
    if cache_only:
        kept = kept.otherwise(F.when(cached & ~F.col("parser_version").eqNullSafe(F.lit(version)), "STALE_PARSER_VERSION").otherwise("SKIPPED_CACHE_ONLY"))
    known = known.withColumn("kept_", kept)
    outcome = F.when(F.col("kept_").isNull(), F.coalesce("outcome", F.lit("NOT_FOUND")))
    known = known.withColumn("outcome", outcome)
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((F.col("outcome") == "SESSION").cast("int")).over(before), F.lit(0)) == 1
    failed = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    written = F.when(F.col("new_hash").isNull(), "PARSE_ERROR").when(~cached, "CREATED").when(F.col("new_hash") == F.col("content_hash"), "UNCHANGED").otherwise("UPDATED")
    status = F.coalesce("kept_", F.when(stopped, "SESSION_EXPIRED"), F.try_element_at(failed, F.col("outcome")), written)
    return known.select("position", "cnae", status.alias("status"))
