"""Sync jobs: landed feeds to the next version of the snapshot tables.

A job builds frames and writes nothing: it returns a dict with ``after`` (the next
version of its table), ``ops`` (one row a key), ``rejected`` (rows with errors) and
``counts``.  The caller writes ``after`` to a new path and appends the counts to the
ledger.  With ``dry_run`` the table stays as it is and operations are WOULD_*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxflow.functions import classify as R
from taxflow.functions import normalize as N
from taxflow.operators import enrichment, match, merge, ordering, payroll, quality, rule_pages
from taxflow.plans import views
from taxflow.sources import assessments, feeds
from taxflow.staging import small_side, staged

Frames = dict[str, DataFrame]
SCOPES = ("ALL", "DIFAL", "DOCUMENTS", "TASKS")


def resolve_tenant(orgs: DataFrame, slug: str | None = None) -> int:
    """Id of the active tenant with the slug, or of the only active one; ValueError if there is none or a choice."""
    found = orgs.where("active").where(F.col("slug") == slug) if slug else orgs.where("active")
    ids = [r.organization_id for r in found.select("organization_id").limit(2).collect()]
    if len(ids) != 1:
        raise ValueError("no active tenant" if not ids else "more than one active tenant: give its slug")
    return ids[0]


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0).drop("order_")


def _numbered(df: DataFrame) -> DataFrame:
    """Input rows with their place ``order_``: that of files, blocks and items where they are known, else that of the rows as they are read."""
    own = feeds.place(df)
    return df.withColumn("order_", own[0] if own else F.monotonically_increasing_id())


def _snapshot(target: DataFrame, rows: DataFrame, keys: list[str], now: Column, dry_run: bool, rejected: DataFrame) -> Frames:
    """Of rows with equal keys the last by ``order_``, the place in the input, counts; columns of the target decide what is tracked."""
    tracked = [c for c in target.columns if c not in (*keys, "first_seen_at", "last_seen_at")]
    batch = merge.last_of_batch(rows.select(*keys, *tracked, "order_"), keys, ["order_"]).drop("order_")
    after, ops = merge.merge_snapshot(target, batch, keys, tracked, now, dry_run=dry_run)
    return {"after": after, "ops": ops, "rejected": rejected, "counts": merge.merge_counts(ops)}


def run_registry_sync(spark: SparkSession, path: str, target: DataFrame, org: int, now: Column, dry_run: bool = False) -> Frames:
    """Registry companies of a tenant, merged on the CNPJ by the registry's own rule (``upsert_registry``)."""
    good, bad = _split(feeds.map_registry_company(feeds.read_company_feed(spark, path)))
    keys = ["organization_id", "cnpj"]
    fields = [c for c in target.columns if c not in (*keys, *merge.REGISTRY_STATE, "first_seen_at", "last_seen_at")]
    rows = good.withColumn("organization_id", F.lit(org).cast("long")).select(*keys, *fields, "order_")
    after, ops = merge.upsert_registry(target, merge.last_of_batch(rows, keys, ["order_"]).drop("order_"), fields, now, dry_run)
    return {"after": after, "ops": ops, "rejected": bad, "counts": merge.merge_counts(ops)}


def run_catalog_backfill(companies: DataFrame, catalog: DataFrame, now: Column, only_active: bool = False, limit: int | None = None) -> Frames:
    """Activity catalog from the codes stored with the companies; ``limit``: the first so many by id."""
    chosen = companies.where("active") if only_active else companies
    chosen = chosen if limit is None else ordering.limit_by_id(chosen, "company_id", limit)
    after, ops = merge.merge_cnae_catalog(chosen.select("company_id", "active"), ordering.normalize_company_cnaes(chosen), catalog, now)
    return {"after": after, "ops": ops, "rejected": ops.limit(0), "counts": merge.merge_counts(ops), "summary": views.catalog_summary(chosen, ops)}


def run_delivery_sync(
    spark: SparkSession, path: str, companies: DataFrame, periods: DataFrame, obligations: DataFrame, statuses: DataFrame, now: Column,
    first: str, last: str | None = None, only_active: bool = True, fiscal_only: bool = False, dry_run: bool = False, identifier: str | None = None, stop_on_error: bool = False,
) -> Frames:
    """Deliveries of one period, or of a range in one plan keyed by period; counts are per period.

    ``companies``: company_id, cnpj, active.  ``periods``: period_id, competencia.  ``obligations``: obligation_id, code, and
    department_default if departments of unknown names are to become it.
    Of items with equal keys the last in the order of files, blocks and items counts.
    ``statuses``: the table that ``merge_status`` keeps.
    """
    feed = feeds.read_delivery_feed(spark, path, identifier).where(F.col("period").between(first, last or first))
    failed = feed.where("error_message IS NOT NULL")
    if stop_on_error:  # nothing of the first period with an error, nor of later ones
        stop = failed.agg(F.min("period")).first()[0]
        feed = feed.where(F.col("period") < stop) if stop else feed
    rows, bad = _split(feeds.map_delivery(feed.where("error_message IS NULL")))
    rejected = failed.select("period", "external_company_id", "cnpj", "error_message").unionByName(
        bad.select("period", "external_company_id", "cnpj", F.concat(F.lit("missing "), F.array_join("errors", ", ")).alias("error_message"))
    )
    own = companies.where("active") if only_active else companies
    rows = rows.hint("merge").join(own.select("cnpj", "company_id"), "cnpj").join(small_side(periods.select("period_id", F.col("competencia").alias("period"))), "period")
    rows = R.map_obligation(rows, "name", obligations).withColumnRenamed("external_delivery_id", "delivery_id")
    rows = quality.fiscal_only(rows) if fiscal_only else rows
    after, ops = merge.merge_status(rows, statuses, now, dry_run, order=("order_",))
    return {"after": after, "ops": ops, "deliveries": rows, "rejected": rejected, "counts": merge.merge_counts(ops, "period_id")}


def run_assessment_companies(spark: SparkSession, path: str, master: DataFrame, target: DataFrame, org: int, now: Column, dry_run: bool = False) -> Frames:
    """Assessment companies with their match in the master; ``missing`` has stored ones that the feed lacks."""
    items, failures = feeds.assessment_company_items(feeds.read_bodies(spark, path))
    good, bad = _split(assessments.map_assessment_company(items))
    matched = match.reconcile(good, master, ["cnpj"], "active", "company_id").withColumn("organization_id", F.lit(org).cast("long"))
    keys = ["organization_id", "external_id"]
    return _snapshot(target, matched, keys, now, dry_run, bad) | {"missing": match.missing_from_source(target, matched, keys), "failures": failures}


def run_assessments(replies: DataFrame, target: DataFrame, org: int, now: Column, dry_run: bool = False) -> Frames:
    """``replies``: body, requested_cnpj, requested_period.  A reply about another company or period is rejected."""
    good, bad = _split(assessments.map_assessment(_numbered(replies), keep=("order_",)))
    return _snapshot(target, good.withColumn("organization_id", F.lit(org).cast("long")), ["organization_id", "assessment_id"], now, dry_run, bad)


def run_operational(landed: Frames, targets: Frames, org: int, now: Column, scope: str = "ALL", dry_run: bool = False) -> dict[str, Frames]:
    """Frames by branch.  ``landed``: DIFAL (body, requested_cnpj, requested_period), ENTRADA, SAIDA and TASKS (item)."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    tenant = F.lit(org).cast("long")
    out: dict[str, Frames] = {}
    if scope in ("ALL", "DIFAL"):
        good, bad = _split(assessments.map_difal(_numbered(landed["DIFAL"])))
        out["DIFAL"] = _snapshot(targets["DIFAL"], good.withColumn("organization_id", tenant), ["organization_id", "requested_cnpj", "requested_period"], now, dry_run, bad)
    if scope in ("ALL", "DOCUMENTS"):
        both = assessments.map_document(_numbered(landed["ENTRADA"]), "ENTRADA").unionByName(assessments.map_document(_numbered(landed["SAIDA"]), "SAIDA"))
        good, bad = _split(both)
        out["DOCUMENTS"] = _snapshot(targets["DOCUMENTS"], good.withColumn("organization_id", tenant), ["organization_id", "direction", "source_document_key"], now, dry_run, bad)
    if scope in ("ALL", "TASKS"):
        good, bad = _split(assessments.map_task(_numbered(landed["TASKS"])))
        out["TASKS"] = _snapshot(targets["TASKS"], good.withColumn("organization_id", tenant), ["organization_id", "source_task_key"], now, dry_run, bad)
    return out


def run_enrichment(
    pages: DataFrame, wanted: DataFrame, cache: DataFrame, columns: list[str], now: Column, force_refresh: bool = False, fetches: DataFrame | None = None, limit: int | None = None, cache_only: bool = False
) -> Frames:
    """Rules of the wanted codes (cnae, in their order by ``position`` if given): fresh cache rows stay, the others are read from landed pages.

    ``items`` has one row with the status of each code that takes part (``enrichment_items``), ``summary`` their counts.  ``fetches``: cnae,
    outcome (SESSION, TRANSPORT, FOUND, NOT_FOUND, AMBIGUOUS) of the search for a code; without it codes with landed pages are FOUND.
    A page that can't be read leaves the cache as it is.  ``missing`` has the wanted codes that neither the cache nor the pages hold.
    """
    order = "position" if "position" in wanted.columns else "cnae"
    rules = staged(rule_pages.attach_activity(rule_pages.normalized_rules(staged(rule_pages.page_texts(pages), "rule-pages"))), "rules")
    found = ordering.latest_per_key(rules.where("parse_status = 'PARSED'"), ["cnae"], ["page_key"])
    fetches = found.select("cnae", F.lit("FOUND").alias("outcome")) if fetches is None else fetches
    todo = enrichment.targets(wanted, order, limit)
    items = enrichment.enrichment_items(todo, cache, fetches, found.select("cnae", "content_hash"), now, rule_pages.PARSER_VERSION, force_refresh, cache_only)
    items = staged(items, "enrichment-items")
    due = items.where(F.col("status").isin("CREATED", "UPDATED", "UNCHANGED")).select("cnae")
    batch = found.join(due.hint("merge"), "cnae", "left_semi").select("cnae", "content_hash", *columns)
    after, ops = merge.merge_rule_cache(cache, batch, "cnae", columns, now)
    missing = todo.join(found.hint("merge"), "cnae", "left_anti").join(cache, "cnae", "left_anti").select("cnae")
    return {"after": after, "ops": ops, "items": items, "summary": views.enrichment_summary(items), "missing": missing, "rejected": rules.where("parse_status <> 'PARSED'"), "counts": merge.merge_counts(ops)}


def read_report_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts landed as JSON lines (file, page_no, text)."""
    return spark.read.schema("file string, page_no int, text string").json(path)


def run_payroll_report(spark: SparkSession, path: str) -> Frames:
    return payroll.parse_report(read_report_pages(spark, path))


def run_payroll_import(pages: DataFrame, hashes: DataFrame, imported: DataFrame, master: DataFrame, org: int) -> Frames:
    """Companies of files that weren't imported before, matched by CNPJ; evidence rows are for MATCHED ones alone.

    ``hashes``: file, sha256.  ``imported``: organization_id, sha256.
    """
    done = imported.where(F.col("organization_id") == org).select("sha256")
    new = hashes.join(done, "sha256", "left_anti").select("file", "sha256")
    found = payroll.parse_report(pages.join(new, "file", "left_semi"))["companies"].join(new, "file")
    matched = match.reconcile(found, master, ["cnpj"], "active", "company_id").withColumn("organization_id", F.lit(org).cast("long"))
    evidence = matched.where("match_status = 'MATCHED'").select("organization_id", "company_id", "sha256", F.col("file").alias("file_name"), F.col("assessment").alias("competencia"), F.col("gross").alias("amount"))
    return {"companies": matched, "evidence": evidence, "imported": new.select(F.lit(org).cast("long").alias("organization_id"), "sha256").distinct()}
