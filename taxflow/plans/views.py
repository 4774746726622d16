"""Read views: dashboard, cockpit, health and the joined lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxflow.functions import classify as R
from taxflow.functions import normalize as N
from taxflow.operators.ordering import cnae_counts, latest_per_key
from taxflow.operators.quality import is_fresh


def cockpit(
    companies: DataFrame, statuses: DataFrame, alerts: DataFrame, company: int | None = None, status: str | None = None, department: str | None = None, source: str | None = None, snapshots: DataFrame | None = None
) -> DataFrame:
    """Each active company with its counts, overall status and the department (and last_source, where there is one) of its lowest status row.

    ``companies``: organization_id, company_id, name, active.  ``statuses``:
    company_id, status_id, status, department, and last_source if wanted.
    ``alerts``: company_id.  Both are counted before they are joined.  A filter
    on status, department or source cuts the status rows that are counted; one
    on status also drops companies without such a row, unless the status is the
    overall one that follows for them.  ``company`` cuts all three.
    ``snapshots`` as for ``company_summary``: adds regime_label.
    """
    for name, value in (("status", status), ("department", department), ("last_source", source)):
        statuses = statuses if value is None else statuses.where(F.col(name) == value)
    if company is not None:
        companies, statuses, alerts = (df.where(F.col("company_id") == company) for df in (companies, statuses, alerts))
    first = [c for c in ("department", "last_source") if c in statuses.columns]
    s = statuses.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_obligations"), F.count_if(R.is_delivered("status")).alias("n_delivered"), *[F.min_by(c, "status_id").alias(c) for c in first]
    )
    a = alerts.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_divergences"))
    both = companies.where("active").join(s, "company_id", "left").join(a, "company_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_obligations", "n_delivered", "n_divergences")]
    label = []
    if snapshots is not None:
        both = both.join(_latest_regime(snapshots), "company_id", "left")
        label = [N.display_regime("regime_canonical", "regime_mapping_status").alias("regime_label")]
    both = both.select("organization_id", "company_id", "name", *first, *label, *zero).withColumn("n_pending", F.col("n_obligations") - F.col("n_delivered"))
    both = both.withColumn("overall_status", R.overall_status("n_obligations", "n_delivered", "n_divergences"))
    return both if status is None else both.where((F.col("n_obligations") > 0) | (F.col("overall_status") == status))


def _latest_regime(snapshots: DataFrame) -> DataFrame:
    return latest_per_key(snapshots.select("company_id", "updated_at", "snapshot_id", "regime_canonical", "regime_mapping_status"), ["company_id"], ["updated_at", "snapshot_id"])


def dashboard_totals(statuses: DataFrame) -> DataFrame:
    """(organization_id, kind, value, total): numbers by department and by status."""
    rows = statuses.select("organization_id", F.explode(F.array(F.struct(F.lit("department").alias("kind"), F.col("department").alias("value")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")))).alias("e"))
    return rows.groupBy("organization_id", "e.kind", "e.value").agg(F.count(F.lit(1)).alias("total"))


def dashboard(companies: DataFrame, statuses: DataFrame, alerts: DataFrame, evidences: DataFrame, installments: DataFrame) -> DataFrame:
    """KPIs of each tenant; statuses of inactive companies count, companies must be active."""

    def counted(df, name, *more):
        return df.groupBy("organization_id").agg(F.count(F.lit(1)).alias(name), *more)

    out = counted(companies.where("active"), "companies_total")
    parts = [counted(statuses, "obligations_total", F.count_if(R.is_delivered(F.upper("status"))).alias("delivered_total")), counted(alerts, "divergences_total"), counted(evidences, "evidences_total"), counted(installments, "installments_total")]
    for part in parts:
        out = out.join(part, "organization_id", "left")
    names = ["companies_total", "obligations_total", "delivered_total", "divergences_total", "evidences_total", "installments_total"]
    out = out.select("organization_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.withColumn("pending_total", F.col("obligations_total") - F.col("delivered_total"))


def _only(rows: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def deliveries_view(statuses: DataFrame, companies: DataFrame, obligations: DataFrame, org: int | None = None, period: int | None = None, company: int | None = None) -> DataFrame:
    """Statuses with the company of the same tenant and the obligation; rows without either are left out."""
    rows = _only(statuses, organization_id=org, period_id=period, company_id=company)
    named = companies.select("organization_id", "company_id", F.col("name").alias("company_name"))
    return rows.join(named, ["organization_id", "company_id"]).join(obligations.select("obligation_id", "code", F.col("name").alias("obligation_name")), "obligation_id")


def optional_company_view(rows: DataFrame, companies: DataFrame, inner: bool = False, org: int | None = None, period: int | None = None, company: int | None = None) -> DataFrame:
    """Rows with the name of their company; evidences and divergences keep rows without one, instalments (``inner``) don't."""
    rows = _only(rows, organization_id=org, period_id=period, company_id=company)
    return rows.join(companies.select("organization_id", "company_id", F.col("name").alias("company_name")), ["organization_id", "company_id"], "inner" if inner else "left")


def evidences_view(evidences: DataFrame, companies: DataFrame, **only) -> DataFrame:
    return optional_company_view(evidences, companies, **only)


def divergences_view(alerts: DataFrame, companies: DataFrame, **only) -> DataFrame:
    return optional_company_view(alerts, companies, **only)


def installments_view(installments: DataFrame, companies: DataFrame, **only) -> DataFrame:
    return optional_company_view(installments, companies, inner=True, **only)


def attach_snapshot(items: DataFrame, snapshots: DataFrame, key: str = "external_company_id") -> DataFrame:
    """Items with snapshot_id and company_id of the snapshot that has their external id; both null where none has."""
    return items.join(snapshots.select(key, "snapshot_id", "company_id"), key, "left")


def company_summary(companies: DataFrame, statuses: DataFrame, obligations: DataFrame, alerts: DataFrame, evidences: DataFrame, installments: DataFrame, snapshots: DataFrame, shown: int | None = None) -> DataFrame:
    """KPIs, labels, previews and sorted obligations of each active company, for one period.

    ``companies``: organization_id, company_id, name, active, state_registration, city, state.  ``statuses``: company_id,
    status_id, obligation_id, status, department, source, due_date, delivered_at.  ``alerts``, ``evidences``,
    ``installments``: company_id.  ``snapshots``: company_id, updated_at, snapshot_id, regime_canonical,
    regime_mapping_status; the latest counts.  All are of the period already, and grouped before they are joined.
    ``shown``: the first so many obligations of a company, all of which are counted; None lists all of them, in one row a company.
    The previews of evidences and divergences are their numbers.
    """
    rows = attach_obligation(statuses, obligations)
    # in order of due date, nulls last, then of id
    row = F.struct(F.col("due_date").isNull().alias("no_date"), "due_date", "status_id", "code", F.col("name").alias("obligation"), "status", "department", "source", "delivered_at")
    first = rows
    if shown is not None:  # cut before the shuffle already
        place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.asc_nulls_last("due_date"), "status_id"))
        first = rows.withColumn("place_", place).where(F.col("place_") <= shown)
    out = companies.where("active").select(
        "organization_id", "company_id", "name", N.display_state_registration("state_registration").alias("state_registration"), N.display_place("city", "state").alias("place")
    )
    counted = lambda df, name, *more: df.groupBy("company_id").agg(F.count(F.lit(1)).alias(name), *more)
    parts = [
        counted(rows, "obligations_total", F.count_if(R.is_delivered("status")).alias("delivered_total")),
        first.groupBy("company_id").agg(F.array_sort(F.collect_list(row)).alias("rows_")),
        counted(alerts, "divergences_total"), counted(evidences, "evidences_total"), counted(installments, "installments_total"),
        _latest_regime(snapshots),
    ]
    for part in parts:
        out = out.join(part, "company_id", "left")
    totals = ["obligations_total", "delivered_total", "divergences_total", "evidences_total", "installments_total"]
    listed = F.transform("rows_", lambda x: F.struct(*[x[c].alias(c) for c in ("code", "obligation", "status", "department", "source", "due_date", "delivered_at")]))
    out = out.select(
        "organization_id", "company_id", "name", "state_registration", "place", N.display_regime("regime_canonical", "regime_mapping_status").alias("regime_label"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in totals], F.coalesce(listed, F.array().cast(shown_type(statuses))).alias("obligations"),
    )
    return out.withColumns({"pending_total": F.col("obligations_total") - F.col("delivered_total"), "evidences_preview": F.col("evidences_total"), "divergences_preview": F.col("divergences_total")})


def shown_type(statuses: DataFrame) -> str:
    kind = lambda c: statuses.schema[c].dataType.simpleString()
    return f"array<struct<code:string,obligation:string,status:{kind('status')},department:{kind('department')},source:{kind('source')},due_date:{kind('due_date')},delivered_at:{kind('delivered_at')}>>"


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """One row: active items, distinct codes and distinct companies of the active ones."""
    return catalog.where("active").agg(F.count(F.lit(1)).alias("active_items"), F.count_distinct("cnae").alias("unique_cnaes"), F.count_distinct("company_id").alias("companies"))


def cache_health(cache: DataFrame, now: Column, version: str) -> DataFrame:
    """One row: items, expired ones, ones of another parser version, and the last refresh."""
    return cache.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("expires_at") < now).alias("expired_items"), F.count_if(F.col("parser_version") != version).alias("outdated_items"), F.max("retrieved_at").alias("last_refresh")
    )


def snapshot_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(organization_id, kind, n) of snapshot tables by their kind."""
    parts = [df.groupBy("organization_id").agg(F.count(F.lit(1)).alias("n")).select("organization_id", F.lit(kind).alias("kind"), "n") for kind, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def catalog_summary(companies: DataFrame, ops: DataFrame) -> DataFrame:
    """One row over a catalog run: companies, codes received, valid and invalid, and operations by kind.

    ``companies``: company_id, cnae_principal, cnaes_secundarios.  ``ops``: op.
    """
    got = cnae_counts(companies).agg(F.count(F.lit(1)).alias("companies"), F.coalesce(F.sum("received"), F.lit(0)).alias("cnaes_received"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("cnaes_invalid"))
    kinds = ("CREATED", "UPDATED", "REACTIVATED", "DEACTIVATED", "UNCHANGED")
    done = ops.agg(*[F.count_if(F.col("op") == k).alias(k.lower()) for k in kinds])
    # both sides are one row by construction
    both = got.withColumn("one_", F.lit(1)).join(F.broadcast(done.withColumn("one_", F.lit(1))), "one_").drop("one_")
    return both.withColumn("cnaes_valid", F.col("cnaes_received") - F.col("cnaes_invalid"))


def enrichment_summary(items: DataFrame) -> DataFrame:
    """One row over the items (status) of a classification run; PARTIAL if a session or the transport failed."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    broken = of("SESSION_NOT_VALID", "SESSION_EXPIRED", "TRANSPORT_ERROR")
    return items.agg(
        F.when(broken > 0, "PARTIAL").otherwise("SUCCESS").alias("status"), F.count(F.lit(1)).alias("processed"), of("SKIPPED_FRESH_CACHE").alias("fresh_cache"), of("SKIPPED_CACHE_ONLY").alias("cache_only"),
        of("CREATED").alias("created"), of("UPDATED").alias("updated"), of("UNCHANGED").alias("unchanged"), of("INVALID_CNAE", "TRANSPORT_ERROR", "SESSION_NOT_VALID").alias("errors"),
    )


def company_activity_types(catalog: DataFrame, cache: DataFrame) -> DataFrame:
    """(company_id, activity_type): classes of the descriptions of a company's active codes, each once."""
    classes = cache.select("cnae", F.explode(R.classify_activity("description")).alias("activity_type"))
    return catalog.where("active").select("company_id", "cnae").hint("merge").join(classes, "cnae").select("company_id", "activity_type").distinct()


def report_summary(reports: DataFrame, companies: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row a file: pages, companies, competences, warnings of the file and of companies by code, and companies by signal."""
    signals = ["has_payroll", *[c for c in companies.columns if f"{c}_codes" in companies.columns]]
    by_signal = companies.groupBy("file").agg(*[F.count_if(s).alias(s.removeprefix("has_")) for s in signals])
    codes = warnings.groupBy("file", F.when(F.col("group_no").isNull(), "file").otherwise("company").alias("of"), "code").agg(F.count(F.lit(1)).alias("n"))
    sorted_map = lambda of: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("of") == of, F.struct("code", "n")))))
    by_code = codes.groupBy("file").agg(sorted_map("file").alias("warning_codes"), sorted_map("company").alias("company_warning_codes"))
    out = reports.select("file", "n_pages", "n_companies", "payrolls", "assessments").join(by_signal, "file", "left").join(by_code, "file", "left")
    none = F.create_map().cast("map<string,bigint>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("warning_codes", "company_warning_codes")} | {(n := s.removeprefix("has_")): F.coalesce(n, F.lit(0)) for s in signals})


def attach_obligation(statuses: DataFrame, obligations: DataFrame) -> DataFrame:
    both = statuses.join(obligations.select("obligation_id", "code", "name"), "obligation_id", "left")
    return both.withColumn("code", F.coalesce("code", F.concat(F.lit("OBR-"), F.col("obligation_id")))).withColumn("name", F.coalesce("name", F.lit("Obrigacao")))


def integration_health(providers: DataFrame, runs: DataFrame, now: Column, stale_minutes: int = 15) -> DataFrame:
    """(provider, last_status, last_finished_at, active_run, stale): latest terminal run and latest RUNNING one."""
    runs = runs.withColumn("provider", F.upper("provider"))
    done = latest_per_key(runs.where("status <> 'RUNNING'"), ["provider"], ["finished_at", "run_id"])
    live = latest_per_key(runs.where("status = 'RUNNING'"), ["provider"], ["started_at", "run_id"])
    out = providers.hint("merge").join(done.select("provider", F.col("status").alias("last_status"), F.col("finished_at").alias("last_finished_at")), "provider", "left")
    out = out.join(live.select("provider", F.col("run_id").alias("active_run"), "started_at"), "provider", "left")
    old = F.col("started_at") < now - F.expr(f"interval {int(stale_minutes)} minutes")
    return out.select("provider", "last_status", "last_finished_at", "active_run", F.coalesce(old, F.lit(False)).alias("stale"))


# The sources of runs, in the order in which they are shown.
PROVIDERS = ("ECONTROLE", "ACESSORIAS", "SITTAX", "DOMINIO", "ECONET", "WATCHER_G")


def provider_health(spark: SparkSession, runs: DataFrame, now: Column, stale_minutes: int = 15) -> DataFrame:
    """``integration_health`` of the six providers, in their order (``position``); one without runs has nulls."""
    six = spark.createDataFrame(list(enumerate(PROVIDERS)), "position int, provider string")
    health = integration_health(six.select("provider"), runs, now, stale_minutes)
    return health.join(F.broadcast(six), "provider").orderBy("position")


def join_fresh_cache(company_cnaes: DataFrame, cache: DataFrame, now: Column, version: str) -> DataFrame:
    """A company's codes with their cache row; one that isn't parsed, is expired or of another version counts as missing."""
    return company_cnaes.join(cache.where(is_fresh(now, version)), "cnae", "left")


def factor_r_potential(company_cnaes: DataFrame, cache: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Of each company the positive, negative and missing CNAEs, sorted, its status, and annex of the first positive.

    ``company_cnaes``: company_id, cnae (active ones).  ``cache``: cnae,
    factor_r (three-valued, fresh entries), annex_default; further columns annex_conditional and factor_r_threshold are
    those of the first positive too.  ``companies`` (company_id): those without a code are UNKNOWN.
    """
    both = company_cnaes.join(cache, "cnae", "left")
    if companies is not None:
        both = companies.select("company_id").join(both, "company_id", "left")
    more = [c for c in ("annex_conditional", "factor_r_threshold") if c in cache.columns]
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("cnae"))))
    found = both.groupBy("company_id").agg(
        F.count("cnae").alias("cnaes_total"),
        pick(F.col("factor_r")).alias("positive_cnaes"),
        pick(~F.col("factor_r")).alias("negative_cnaes"),
        pick(F.col("factor_r").isNull()).alias("missing_cnaes"),
        *[F.min_by(c, F.when(F.col("factor_r"), F.col("cnae"))).alias(c) for c in ("annex_default", *more)],
    )
    status = F.when(F.size("positive_cnaes") > 0, "APPLICABLE").when(F.size("missing_cnaes") > 0, "PARTIAL").otherwise("NOT_APPLICABLE")
    status = F.when(F.col("cnaes_total") == 0, "UNKNOWN").otherwise(status)
    return found.withColumn("status", status).withColumns({c: F.when(F.size("positive_cnaes") > 0, F.col(c)) for c in ("annex_default", *more)})


def merge_range_summary(periods: DataFrame, counters: list[str], names: str, key: str) -> DataFrame:
    """Counters added over the periods of a key, and its maps of names added by name."""
    sums = periods.groupBy(key).agg(*[F.sum(c).alias(c) for c in counters])
    flat = periods.select(key, F.explode(names).alias("name_", "n_")).groupBy(key, "name_").agg(F.sum("n_").alias("n_"))
    maps = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name_", "n_"))).alias("e_"))
    return sums.hint("merge").join(maps.select(key, F.map_from_entries("e_").alias(names)), key, "left")


def range_status(periods: DataFrame, key: str, order: str = "period", stop_on_error: bool = False) -> DataFrame:
    """The state of each range (``key``) after its periods were run in their order: how many were processed, succeeded, partly or failed, and its status.

    ``periods``: key, order, status (SUCCESS, PARTIAL or FAILED), failures.  With ``stop_on_error`` a range ends with its first period that isn't a success,
    and later ones don't count.  FAILED if none succeeded even partly and one failed; PARTIAL if one failed or did so partly, or anything failed in one.
    A range has few periods, so one task may hold it.
    """
    if stop_on_error:
        before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        periods = periods.withColumn("bad_", F.coalesce(F.max((F.col("status") != "SUCCESS").cast("int")).over(before), F.lit(0))).where("bad_ = 0")
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    out = periods.groupBy(key).agg(
        F.count(F.lit(1)).alias("periods_processed"), of("SUCCESS").alias("periods_success"), of("PARTIAL").alias("periods_partial"), (F.count(F.lit(1)) - of("SUCCESS", "PARTIAL")).alias("periods_failed"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.max(order).alias("last_period"),
    )
    none = (F.col("periods_failed") > 0) & (F.col("periods_success") + F.col("periods_partial") == 0)
    some = (F.col("periods_failed") > 0) | (F.col("periods_partial") > 0) | (F.col("failures") > 0)
    return out.withColumn("status", F.when(none, "FAILED").when(some, "PARTIAL").otherwise("SUCCESS"))
