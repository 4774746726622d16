"""Merges of batches into snapshot tables.

A merge is one full outer join on the natural key.  It returns the next version
of the table and the operation of each key; the caller writes the version to a
new path, since a table is never overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxflow.functions import classify as R
from taxflow.operators.ordering import latest_per_key


def last_of_batch(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch apply in order, so of a repeated key the last one counts."""
    return latest_per_key(batch, keys, order)


def merge_snapshot(target: DataFrame, batch: DataFrame, keys: list[str], tracked: list[str], now: Column, detect: bool = True, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next, ops).  ``target`` has keys, tracked, first_seen_at, last_seen_at; ``batch`` has keys, tracked, one row a key.

    A new key is CREATED; a key with a tracked value that differs, nulls equal,
    is UPDATED (always with ``detect=False``), else UNCHANGED.  last_seen_at
    moves for all three.  Keys that the batch lacks stay as they are and have no
    operation.  ``dry_run`` labels operations WOULD_CREATE and so on, and
    returns the table unchanged.  Rows with a null key must be quarantined before.
    """
    old = target.select(*keys, F.struct(*tracked).alias("old_"), "first_seen_at", "last_seen_at", F.lit(True).alias("was_"))
    new = batch.select(*keys, F.struct(*tracked).alias("new_"), F.lit(True).alias("is_"))
    both = old.join(new, keys, "full_outer")
    same = F.col("old_").eqNullSafe(F.col("new_")) if detect else F.lit(False)
    op = F.when(F.col("is_").isNull(), None).when(F.col("was_").isNull(), "CREATED").when(same, "UNCHANGED").otherwise("UPDATED")
    both = both.withColumn("op", op)
    seen = F.col("is_").isNotNull()
    after = both.select(
        *keys,
        *[F.when(seen, F.col(f"new_.{c}")).otherwise(F.col(f"old_.{c}")).alias(c) for c in tracked],
        F.when(F.col("was_").isNull(), now).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    would = F.when(F.col("op") == "CREATED", "WOULD_CREATE").when(F.col("op") == "UPDATED", "WOULD_UPDATE").otherwise("WOULD_REMAIN_UNCHANGED")
    ops = both.where("op IS NOT NULL").select(*keys, (would if dry_run else F.col("op")).alias("op"))
    return (target if dry_run else after), ops


def merge_counts(ops: DataFrame, *by: str) -> DataFrame:
    return ops.groupBy(*by, "op").agg(F.count(F.lit(1)).alias("n"))


def merge_cnae_catalog(companies: DataFrame, desired: DataFrame, catalog: DataFrame, now: Column, source: str = "ECONTROLE") -> tuple[DataFrame, DataFrame]:
    """(next, ops) of the activity catalog, for all companies at once.

    ``companies``: company_id, active.  ``desired``: company_id, cnae,
    is_primary.  ``catalog``: company_id, cnae, is_primary, source, active,
    first_seen_at, last_seen_at, deactivated_at.  Operations: CREATED,
    REACTIVATED, UPDATED, UNCHANGED, DEACTIVATED; an inactive company
    deactivates all of its rows.  Catalog rows of other companies stay.
    """
    keys = ["company_id", "cnae"]
    state = companies.select("company_id", F.col("active").alias("company_active_"))
    want = desired.join(state.where("company_active_"), "company_id", "left_semi").select(*keys, F.col("is_primary").alias("want_"), F.lit(True).alias("wanted_"))
    both = catalog.withColumn("was_", F.lit(True)).join(want.hint("merge"), keys, "full_outer").join(state, "company_id", "left")
    wanted, was, active = F.col("wanted_").isNotNull(), F.col("was_").isNotNull(), F.coalesce(F.col("active"), F.lit(False))
    same = F.col("is_primary").eqNullSafe(F.col("want_")) & F.col("source").eqNullSafe(F.lit(source))
    op = F.when(wanted & ~was, "CREATED").when(wanted & ~active, "REACTIVATED").when(wanted & same, "UNCHANGED").when(wanted, "UPDATED")
    both = both.withColumn("op", op.when(active & F.col("company_active_").isNotNull(), "DEACTIVATED"))
    gone = F.col("op") == "DEACTIVATED"
    after = both.select(
        *keys,
        F.when(wanted, F.col("want_")).when(gone, False).otherwise(F.col("is_primary")).alias("is_primary"),
        F.when(wanted, F.lit(source)).otherwise(F.col("source")).alias("source"),
        F.when(wanted, True).when(gone, False).otherwise(F.col("active")).alias("active"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(F.col("op").isNotNull(), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(wanted, None).when(gone, now).otherwise(F.col("deactivated_at")).alias("deactivated_at"),
    )
    return after, both.where("op IS NOT NULL").select(*keys, "op")


def merge_rule_cache(cache: DataFrame, batch: DataFrame, key: str, columns: list[str], now: Column, ttl_days: int = 180) -> tuple[DataFrame, DataFrame]:
    """(next, ops): an equal content_hash only renews the times; another one replaces all columns."""
    old = cache.select(key, F.struct("content_hash", *columns).alias("old_"), "retrieved_at", "expires_at")
    new = batch.select(key, F.struct("content_hash", *columns).alias("new_"))
    both = old.join(new, key, "full_outer")
    op = F.when(F.col("new_").isNull(), None).when(F.col("old_").isNull(), "CREATED").when(F.col("old_.content_hash").eqNullSafe(F.col("new_.content_hash")), "UNCHANGED").otherwise("UPDATED")
    both = both.withColumn("op", op)
    row = F.when(F.col("op").isin("CREATED", "UPDATED"), F.col("new_")).otherwise(F.col("old_"))
    seen = F.col("op").isNotNull()
    after = both.select(
        key, row.alias("row_"), F.when(seen, now).otherwise(F.col("retrieved_at")).alias("retrieved_at"), F.when(seen, now + F.expr(f"interval {int(ttl_days)} days")).otherwise(F.col("expires_at")).alias("expires_at")
    ).select(key, "row_.*", "retrieved_at", "expires_at")
    return after, both.where(seen).select(key, "op")


def delete_registry(target: DataFrame, events: DataFrame, now: Column, order: tuple[str, ...] = ("deleted_at",)) -> tuple[DataFrame, DataFrame]:
    """(next, ops) of soft deletes: an event means the company of its cnpj, and only where there is none that of its external id.

    ``target``: organization_id, cnpj, external_id, active, deleted_at, sync_status.  ``events``: organization_id, cnpj, external_id, deleted_at
    and the columns of ``order``; of several for one company the last counts.  Operations: DELETED, ALREADY_DELETED (it was inactive and
    in the deleted state before; its time moves), and one NOT_FOUND row for each event that no company fits.
    """
    events = events.select("organization_id", "cnpj", "external_id", "deleted_at", F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))]).alias("order_"))
    known = target.select("organization_id", "cnpj", F.lit(True).alias("known_"))
    by_cnpj = events.join(known.hint("merge"), ["organization_id", "cnpj"], "left")
    ids = target.where("external_id IS NOT NULL").groupBy("organization_id", "external_id").agg(F.min("cnpj").alias("own_"))
    rest = by_cnpj.where("known_ IS NULL").join(ids.hint("merge"), ["organization_id", "external_id"], "left")
    columns = ["organization_id", "cnpj", "external_id", "deleted_at", "order_", "own_"]
    both = by_cnpj.where("known_").withColumn("own_", F.col("cnpj")).select(*columns).unionByName(rest.select(*columns))
    last = both.where("own_ IS NOT NULL").groupBy("organization_id", F.col("own_").alias("cnpj")).agg(F.max_by(F.struct(F.coalesce("deleted_at", now).alias("at")), "order_").alias("hit_"))
    joined = target.join(last.hint("merge"), ["organization_id", "cnpj"], "left")
    hit = F.col("hit_").isNotNull()
    done = ~F.coalesce("active", F.lit(False)) & F.col("sync_status").eqNullSafe(F.lit(DELETED))
    changed = {"active": F.when(hit, False).otherwise(F.col("active")), "deleted_at": F.when(hit, F.col("hit_.at")).otherwise(F.col("deleted_at")), "sync_status": F.when(hit, DELETED).otherwise(F.col("sync_status"))}
    after = joined.select(*[changed[c].alias(c) if c in changed else c for c in target.columns])
    ops = joined.where(hit).select("organization_id", "cnpj", "external_id", F.when(done, "ALREADY_DELETED").otherwise("DELETED").alias("op"))
    missed = both.where("own_ IS NULL").select("organization_id", "cnpj", "external_id", F.lit("NOT_FOUND").alias("op"))
    return after, ops.unionByName(missed)


def merge_status(deliveries: DataFrame, statuses: DataFrame, now: Column, dry_run: bool = False, order: tuple[str, ...] = ("delivery_id",)) -> tuple[DataFrame, DataFrame]:
    """(next, ops) of obligation statuses from deliveries of type O that are MAPPED; the last by ``order`` counts.

    Confidence is 70 for a status that was concluded by hand and 100 for all others.  The department is that of the delivery where its
    name (``department_name``) is known, else the obligation's ``department_default``; without these columns it is ``department``.
    """
    keys = ["company_id", "period_id", "obligation_id"]
    named = {"department_name", "department_default"} <= set(deliveries.columns)
    # only what the result needs is sorted by key
    good = deliveries.where("type = 'O' AND mapping_status = 'MAPPED'").select(
        *keys,
        *[F.col(c).alias(f"order{i}_") for i, c in enumerate(order)],
        F.col("normalized_status").alias("status"),
        (R.map_department("department_name", F.col("department_default")) if named else F.col("department")).alias("department"),
        F.coalesce("finalized_at", F.col("delivered_on").cast("timestamp")).alias("delivered_at"),
    )
    batch = last_of_batch(good, keys, [f"order{i}_" for i in range(len(order))]).select(
        *keys, "status", "department", F.when(F.col("status") == "CONFERENCIA_MANUAL", 70).otherwise(100).cast("decimal(5,2)").alias("confidence"), "delivered_at"
    )
    return merge_snapshot(statuses, batch, keys, ["status", "department", "confidence", "delivered_at"], now, detect=False, dry_run=dry_run)


# Fixed values of registry rows and of alerts about regimes.
SYNCED, DELETED = "SYNCED", "DELETED_IN_SOURCE"
REGISTRY_STATE = ("active", "deleted_at", "sync_status")
REGIME_ALERT = {"code": "REGIME_DIVERGENCE", "title": "Divergencia de regime tributario", "severity": "MEDIUM", "department": "FISCAL"}


def upsert_registry(target: DataFrame, batch: DataFrame, fields: list[str], now: Column, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next, ops) of registry companies by tenant and cnpj; an upsert also activates, clears a deletion and sets the state to SYNCED.

    So a row whose fields are equal is UPDATED if any of these three differs.
    """
    forced = dict(zip(REGISTRY_STATE, (F.lit(True), F.lit(None).cast("timestamp"), F.lit(SYNCED))))
    rows = batch.select("organization_id", "cnpj", *fields, *[c.alias(n) for n, c in forced.items()])
    return merge_snapshot(target, rows, ["organization_id", "cnpj"], [*fields, *forced], now, dry_run=dry_run)


def merge_regime_alerts(conflicts: DataFrame, alerts: DataFrame, source: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next, ops) of alerts: one of the code a company, opened anew by each conflict; alerts without a conflict stay as they are.

    ``conflicts``: organization_id, company_id, left_value, right_value.  ``alerts``: organization_id, company_id, code,
    title, severity, department, message, source, status, first_seen_at, last_seen_at.
    """
    keys, fixed, told = ["organization_id", "company_id", "code"], ["title", "severity", "department"], ["message", "source", "status"]
    message = F.concat(F.lit("Regime diverge: "), F.col("left_value"), F.lit(" vs "), F.col("right_value"), F.lit("."))
    rows = conflicts.select("organization_id", "company_id", F.lit(REGIME_ALERT["code"]).alias("code"), F.struct(message.alias("message"), F.lit(source).alias("source"), F.lit("OPEN").alias("status")).alias("new_"))
    both = alerts.withColumn("was_", F.lit(True)).join(rows, keys, "full_outer")
    hit = F.col("new_").isNotNull()
    after = both.select(
        *keys, *[F.when(F.col("was_").isNull(), F.lit(REGIME_ALERT[c])).otherwise(F.col(c)).alias(c) for c in fixed], *[F.when(hit, F.col(f"new_.{c}")).otherwise(F.col(c)).alias(c) for c in told],
        F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(hit, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    op = F.when(F.col("was_").isNull(), "CREATED").when(F.col("status") == "OPEN", "UPDATED").otherwise("REOPENED")
    return after, both.where(hit).select(*keys, op.alias("op"))


def merge_activity_types(desired: DataFrame, existing: DataFrame, source: str, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(next, ops): pairs (company_id, activity_type) that the source hasn't yet are added; none is changed or deleted."""
    keys = ["company_id", "activity_type"]
    own = existing.where(F.col("source") == source).select(*keys).distinct().withColumn("was_", F.lit(True))
    both = desired.select(*keys).distinct().join(own, keys, "left")
    new = both.where("was_ IS NULL").select(*keys, F.lit(source).alias("source"), F.lit(confidence).cast(existing.schema["confidence"].dataType).alias("confidence"))
    return existing.select(*keys, "source", "confidence").unionByName(new), both.select(*keys, F.when(F.col("was_").isNull(), "CREATED").otherwise("UNCHANGED").alias("op"))


def merge_seed(target: DataFrame, seed: DataFrame, keys: list[str], tracked: list[str], now: Column, delete_rest: bool = False, id_column: str = "seed_id") -> tuple[DataFrame, DataFrame]:
    """(next, ops) of a catalog that data in the code define.  ``target``: id_column, keys, tracked, active.

    Keys may hold nulls, which equal each other.  A missing row is CREATED (its id is null), one that differs or is inactive UPDATED.
    Of target rows with equal keys the one of the least id stays and the others are DELETED; with ``delete_rest`` so are
    rows whose keys the seed doesn't have.
    """
    w = Window.partitionBy(*keys).orderBy(id_column)
    old = target.select(id_column, *keys, F.struct(*tracked).alias("old_"), "active", F.row_number().over(w).alias("nth_"))
    new = seed.select(*[F.col(k).alias(f"{k}_") for k in keys], F.struct(*tracked).alias("new_"))
    same_key = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    both = old.join(new.hint("merge"), same_key, "full_outer")
    is_, was = F.col("new_").isNotNull(), F.col("nth_").isNotNull()
    equal = F.col("old_").eqNullSafe(F.col("new_")) & F.coalesce(F.col("active"), F.lit(False))
    op = F.when(~was, "CREATED").when(is_ & (F.col("nth_") > 1), "DELETED").when(is_ & equal, "UNCHANGED").when(is_, "UPDATED")
    both = both.withColumn("op", op.when(F.lit(delete_rest), "DELETED"))
    row = F.when(is_, F.col("new_")).otherwise(F.col("old_"))
    named = [F.coalesce(F.col(k), F.col(f"{k}_")).alias(k) for k in keys]
    kept = both.where("op IS NULL OR op <> 'DELETED'").select(id_column, *named, row.alias("row_"), F.when(is_, True).otherwise(F.col("active")).alias("active"))
    return kept.select(id_column, *keys, "row_.*", "active"), both.where("op IS NOT NULL").select(id_column, *named, "op")


def sync_counters(received: DataFrame, ops: DataFrame, by: str) -> DataFrame:
    """Counters of a run, a row for each value of ``by`` (a direction, say): received, matched, unmatched, failures, skipped, created, updated, unchanged.

    ``received``: by, match_status, failed, skipped, a row an item; failed and skipped items count as neither matched nor unmatched.
    ``ops``: by, op, a row a key; dry runs count under the same names.
    """
    taken = ~F.coalesce("failed", F.lit(False)) & ~F.coalesce("skipped", F.lit(False))
    matched = F.col("match_status").eqNullSafe(F.lit("MATCHED"))
    got = received.groupBy(by).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(taken & matched).alias("matched"), F.count_if(taken & ~matched).alias("unmatched"), F.count_if("failed").alias("failures"), F.count_if("skipped").alias("skipped")
    )
    names = {"created": ("CREATED", "WOULD_CREATE"), "updated": ("UPDATED", "WOULD_UPDATE"), "unchanged": ("UNCHANGED", "WOULD_REMAIN_UNCHANGED")}
    done = ops.groupBy(by).agg(*[F.count_if(F.col("op").isin(*of)).alias(n) for n, of in names.items()])
    counters = ["received", "matched", "unmatched", "failures", "skipped", *names]
    return got.join(done.hint("merge"), by, "full_outer").select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])
