"""Queries over the driver's tables, one for each operator family, with equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxflow.functions import classify as R
from taxflow.functions import normalize as N
from taxflow.operators import match, merge, ordering, payroll, quality, rule_pages
from taxflow.plans import views
from taxflow.sources import assessments
from taxflow.staging import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _companies(spark, sf_dir) -> DataFrame:
    """Customers as companies; the tenant is the region of their nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("organization_id"))
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey")
    return c.select("organization_id", F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"), "c_nationkey")


def _statuses(spark, sf_dir) -> DataFrame:
    """Orders as obligation statuses; F is delivered."""
    status = F.when(F.col("o_orderstatus") == "F", "ENTREGUE").otherwise("PENDENTE")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("status_id"), status.alias("status"), F.col("o_orderpriority").alias("department"))


def _alerts(spark, sf_dir) -> DataFrame:
    """Returned order lines as alerts of the order's company."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return li.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company_id")), "o_orderkey").select("company_id")


@query("""
WITH s AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS d, arg_min(o_orderpriority, o_orderkey) AS department FROM orders GROUP BY 1),
a AS (SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1),
b AS (SELECT CAST(n_regionkey AS BIGINT) AS organization_id, c_custkey AS company_id, c_name AS name, s.department, coalesce(s.n, 0) AS n_obligations,
             coalesce(s.d, 0) AS n_delivered, coalesce(a.n, 0) AS n_divergences
      FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON s.k = c_custkey LEFT JOIN a ON a.k = c_custkey WHERE c_acctbal > 0)
SELECT *, n_obligations - n_delivered AS n_pending, CASE WHEN n_divergences > 0 THEN 'COM_DIVERGENCIA' WHEN n_obligations = 0 THEN 'SEM_DADOS' WHEN n_delivered >= n_obligations THEN 'ENTREGUE' ELSE 'PENDENTE' END AS overall_status FROM b
""")
def cockpit(spark, sf_dir):
    return views.cockpit(_companies(spark, sf_dir), _statuses(spark, sf_dir), _alerts(spark, sf_dir))


@query("""
WITH s AS (SELECT CAST(n_regionkey AS BIGINT) AS organization_id, o_orderpriority AS department, CASE WHEN o_orderstatus = 'F' THEN 'ENTREGUE' ELSE 'PENDENTE' END AS status
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT organization_id, 'department' AS kind, department AS value, count(*) AS total FROM s GROUP BY ALL
UNION ALL SELECT organization_id, 'status', status, count(*) FROM s GROUP BY ALL
""")
def dashboard_totals(spark, sf_dir):
    tenant = _companies(spark, sf_dir).select("company_id", "organization_id")
    return views.dashboard_totals(_statuses(spark, sf_dir).join(tenant, "company_id"))


@query("""
WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS organization_id, c_custkey AS k, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT organization_id, o_orderkey, o_orderstatus, o_totalprice FROM orders JOIN c ON o_custkey = k),
l AS (SELECT organization_id, l_quantity, l_returnflag FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT *, obligations_total - delivered_total AS pending_total FROM (
SELECT organization_id, count(*) FILTER (WHERE c_acctbal > 0) AS companies_total,
  coalesce((SELECT count(*) FROM o WHERE o.organization_id = c.organization_id), 0) AS obligations_total,
  coalesce((SELECT count(*) FROM o WHERE o.organization_id = c.organization_id AND o_orderstatus = 'F'), 0) AS delivered_total,
  coalesce((SELECT count(*) FROM l WHERE l.organization_id = c.organization_id AND l_returnflag = 'R' AND l_quantity > 45), 0) AS divergences_total,
  coalesce((SELECT count(*) FROM l WHERE l.organization_id = c.organization_id AND l_returnflag = 'A'), 0) AS evidences_total,
  coalesce((SELECT count(*) FROM o WHERE o.organization_id = c.organization_id AND o_totalprice > 200000), 0) AS installments_total
FROM c GROUP BY organization_id)
""")
def dashboard(spark, sf_dir):
    companies = _companies(spark, sf_dir)
    tenant = companies.select("company_id", "organization_id")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "company_id").join(tenant, "company_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity").join(orders.select("o_orderkey", "organization_id"), "o_orderkey")
    return views.dashboard(
        companies,
        _statuses(spark, sf_dir).join(tenant, "company_id"),
        lines.where("l_returnflag = 'R' AND l_quantity > 45"),
        lines.where("l_returnflag = 'A'"),
        orders.where("o_totalprice > 200000"),
    )


@query("""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return ordering.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""
WITH r AS (SELECT upper(event_type) AS provider, event_id AS run_id, ts, CASE WHEN value < 20 THEN 'RUNNING' WHEN value < 40 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events),
d AS (SELECT provider, status AS last_status, ts AS last_finished_at FROM r WHERE status <> 'RUNNING' QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, run_id DESC) = 1),
l AS (SELECT provider, run_id AS active_run, ts FROM r WHERE status = 'RUNNING' QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, run_id DESC) = 1)
SELECT provider, last_status, last_finished_at, active_run, coalesce(l.ts < (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE, false) AS stale
FROM (SELECT DISTINCT provider FROM r) LEFT JOIN d USING (provider) LEFT JOIN l USING (provider)
""")
def latest_run_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 20, "RUNNING").when(F.col("value") < 40, "FAILED").otherwise("SUCCESS")
    runs = e.select(F.col("event_type").alias("provider"), F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"))
    now = e.agg(F.max("ts")).first()[0]
    return views.integration_health(runs.select(F.upper("provider").alias("provider")).distinct(), runs, F.lit(now))


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS competencia, count(*) AS n, sum(o_totalprice) AS amount FROM orders GROUP BY 1)
SELECT competencia, n, round(amount, 2) AS amount, CAST(competencia || '-01' AS DATE) AS first_day, last_day(CAST(competencia || '-01' AS DATE)) AS last_day,
       competencia = (SELECT max(competencia) FROM m) AS is_current FROM m
""")
def resolve_period(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("competencia"), F.col("o_totalprice"))
    m = o.groupBy("competencia").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    periods = m.select("competencia", F.left("competencia", F.lit(4)).cast("int").alias("year"), F.right("competencia", F.lit(2)).cast("int").alias("month"), F.lit(None).cast("long").alias("period_id"))
    now = ordering.resolve_period(periods).select("competencia", F.lit(True).alias("now_"))
    b = N.period_bounds("competencia")
    return m.join(now, "competencia", "left").select("competencia", "n", "amount", b["first_day"].alias("first_day"), b["last_day"].alias("last_day"), F.coalesce("now_", F.lit(False)).alias("is_current"))


@query("""
WITH p AS (SELECT strftime(d, '%Y-%m') AS competencia FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS d)),
h AS (SELECT DISTINCT o_custkey AS grp, strftime(o_orderdate, '%Y-%m') AS competencia FROM orders)
SELECT competencia, count(h.grp) AS groups_present FROM p LEFT JOIN h USING (competencia) GROUP BY 1
""")
def period_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lo, hi = o.agg(F.date_format(F.min("o_orderdate"), "yyyy-MM"), F.date_format(F.max("o_orderdate"), "yyyy-MM")).first()
    have = o.select(F.col("o_custkey").alias("grp"), F.date_format("o_orderdate", "yyyy-MM").alias("competencia")).distinct()
    return ordering.period_range(spark, lo, hi).select("competencia").hint("merge").join(have, "competencia", "left").groupBy("competencia").agg(F.count("grp").alias("groups_present"))


@query("""
SELECT strftime(l_shipdate, '%Y-%m') AS payroll, strftime(l_shipdate + INTERVAL 1 MONTH, '%Y-%m') AS assessment, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY ALL
""")
def next_month_assessment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "MM/yyyy").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    c = N.payroll_to_assessment("m")
    return li.select(c["payroll"].alias("payroll"), c["assessment"].alias("assessment"), "n", "quantity")


@query("""
WITH m AS (SELECT c_nationkey AS k, c_acctbal > 9000 AS active, c_custkey FROM customer), g AS (SELECT k, count(*) FILTER (WHERE active) AS n, min(c_custkey) FILTER (WHERE active) AS id FROM m GROUP BY 1)
SELECT s_suppkey, s_nationkey % 40 AS nation, CASE WHEN g.n = 1 THEN g.id END AS company_id, CASE WHEN g.n = 1 THEN 'MATCHED' WHEN g.n > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS match_status
FROM supplier LEFT JOIN g ON g.k = s_nationkey
""")
def reconcile_match(spark, sf_dir):
    feed = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    master = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 9000).alias("active"), "c_custkey")
    return match.reconcile(feed, master, ["nation"], "active", "c_custkey").select("s_suppkey", "nation", "company_id", "match_status")


@query("""
WITH p AS (SELECT p_partkey, p_brand || '/' || p_size AS root, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS class FROM part),
g AS (SELECT root, min(class) AS c FROM p WHERE class IS NOT NULL GROUP BY root HAVING count(DISTINCT class) = 1)
SELECT p_partkey, root, class, CASE WHEN class IS NULL THEN g.c END AS inherited FROM p LEFT JOIN g USING (root)
""")
def root_inheritance(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("root"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("class"))
    return match.inherit_by_root(p, p.limit(0), ["root"], "class", F.col("class").isNull())


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def missing_from_source(spark, sf_dir):
    batch = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return match.missing_from_source(table(spark, sf_dir, "customer").select("c_custkey"), batch, ["c_custkey"])


@query("""
WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
SELECT CASE WHEN t.o_orderkey IS NULL THEN 'CREATED' WHEN t.o_totalprice IS DISTINCT FROM b.o_totalprice OR t.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'UPDATED' ELSE 'UNCHANGED' END AS op, count(*) AS n
FROM b LEFT JOIN t USING (o_orderkey) GROUP BY 1
""")
def merge_snapshot_ops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    target = o.where("o_orderkey % 2 = 0").withColumns({"first_seen_at": F.lit("2026-01-01").cast("timestamp"), "last_seen_at": F.lit("2026-01-01").cast("timestamp")})
    batch = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return merge.merge_counts(merge.merge_snapshot(target, batch, ["o_orderkey"], ["o_totalprice", "o_orderstatus"], F.lit("2026-02-01").cast("timestamp"))[1])


@query("""
WITH x AS (SELECT o_custkey AS company_id, l_partkey % 50 AS cnae, min(l_linenumber) AS ln, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
d AS (SELECT company_id, cnae, ln = 1 AS is_primary FROM x JOIN customer ON c_custkey = company_id WHERE (company_id + cnae) % 3 <> 0 AND c_acctbal > 0),
c AS (SELECT company_id, cnae, ln <= 2 AS is_primary, q < 45 AS active FROM x WHERE (company_id + cnae) % 4 <> 0)
SELECT op, count(*) AS n FROM (
  SELECT CASE WHEN d.company_id IS NOT NULL AND c.company_id IS NULL THEN 'CREATED' WHEN d.company_id IS NOT NULL AND NOT c.active THEN 'REACTIVATED'
    WHEN d.company_id IS NOT NULL AND c.is_primary = d.is_primary THEN 'UNCHANGED' WHEN d.company_id IS NOT NULL THEN 'UPDATED' WHEN c.active THEN 'DEACTIVATED' END AS op
  FROM d FULL JOIN c ON d.company_id = c.company_id AND d.cnae = c.cnae) WHERE op IS NOT NULL GROUP BY 1
""")
def merge_catalog_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("company_id"))
    x = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").groupBy("company_id", (F.col("l_partkey") % 50).alias("cnae")).agg(F.min("l_linenumber").alias("ln"), F.max("l_quantity").alias("q"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), (F.col("c_acctbal") > 0).alias("active"))
    desired = x.where("(company_id + cnae) % 3 <> 0").select("company_id", "cnae", (F.col("ln") == 1).alias("is_primary"))
    then = F.lit("2026-01-01").cast("timestamp")
    catalog = x.where("(company_id + cnae) % 4 <> 0").select(
        "company_id", "cnae", (F.col("ln") <= 2).alias("is_primary"), F.lit("ECONTROLE").alias("source"), (F.col("q") < 45).alias("active"), then.alias("first_seen_at"), then.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("deactivated_at")
    )
    return merge.merge_counts(merge.merge_cnae_catalog(companies, desired, catalog, F.lit("2026-02-01").cast("timestamp"))[1])


@query("""
WITH a AS (SELECT p_partkey, sha256(p_name || '|' || p_type) AS h FROM part WHERE p_partkey % 4 <> 0),
b AS (SELECT p_partkey, sha256(p_name || '|' || CASE WHEN p_size > 40 THEN 'X' ELSE p_type END) AS h, p_size FROM part WHERE p_partkey % 3 <> 0)
SELECT CASE WHEN a.h IS NULL THEN 'CREATED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'UPDATED' END AS op, count(*) AS n, sum(CAST(p_size AS BIGINT)) AS size FROM b LEFT JOIN a USING (p_partkey) GROUP BY 1
""")
def merge_hash_ttl(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    then = F.lit("2026-01-01").cast("timestamp")
    cache = p.where("p_partkey % 4 <> 0").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("content_hash"), F.col("p_size").cast("long").alias("size"), then.alias("retrieved_at"), then.alias("expires_at"))
    new_type = F.when(F.col("p_size") > 40, "X").otherwise(F.col("p_type"))
    batch = p.where("p_partkey % 3 <> 0").select("p_partkey", F.sha2(F.concat_ws("|", F.col("p_name"), new_type), 256).alias("content_hash"), F.col("p_size").cast("long").alias("size"))
    after, ops = merge.merge_rule_cache(cache, batch, "p_partkey", ["size"], F.lit("2026-02-01").cast("timestamp"))
    return ops.join(after, "p_partkey").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("""
WITH d AS (SELECT l_orderkey, l_partkey % 5 AS obligation_id, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS done, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT obligation_id, CASE WHEN done = 1 AND n % 2 = 0 THEN 'CONFIRMADO_API' WHEN done = 1 THEN 'CONFERENCIA_MANUAL' ELSE 'PENDENTE' END AS status FROM d)
SELECT obligation_id, status, CAST(CASE status WHEN 'CONFERENCIA_MANUAL' THEN 70 ELSE 100 END AS DOUBLE) AS confidence, CASE obligation_id WHEN 0 THEN 'FISCAL' WHEN 1 THEN 'DP' WHEN 2 THEN 'FISCAL' ELSE 'CONTABIL' END AS department, count(*) AS n FROM s GROUP BY ALL
""")
def overwrite_status(spark, sf_dir):
    """Deliveries of each order and obligation, two of each: the item that comes later in its page counts, though its number as text is smaller."""
    d = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", (F.col("l_partkey") % 5).alias("obligation_id")).agg(F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("done"), F.count(F.lit(1)).alias("n"))
    d = d.withColumn("item_no", F.explode(F.array(F.lit(10), F.lit(9))))
    late = F.col("item_no") == 10
    label = F.when(F.col("n") % 2 == 0, "Ent. antecipada").otherwise("Pendente")
    done = F.when(late & (F.col("done") == 1), F.lit("2026-01-01").cast("date"))
    label = F.when(F.col("done") == 1, label).otherwise(F.lit("Atrasada!"))
    b = F.col("obligation_id")
    rows = d.select(
        F.col("l_orderkey").alias("company_id"), F.lit(1).alias("period_id"), "obligation_id", "item_no", F.lit("O").alias("type"), F.lit("MAPPED").alias("mapping_status"),
        R.delivery_status(F.lit(None).cast("timestamp"), done, label).alias("normalized_status"), F.when(b == 0, "Fiscal").when(b == 1, "Depto_ Pessoal").when(b == 3, "Outro").alias("department_name"),
        F.when(b == 1, "DP").when(b == 2, "FISCAL").otherwise("CONTABIL").alias("department_default"), F.lit(None).cast("timestamp").alias("finalized_at"), done.alias("delivered_on"),
    )
    empty = merge_target(rows)
    after, _ = merge.merge_status(rows, empty, F.lit("2026-02-01").cast("timestamp"), order=("item_no",))
    return after.groupBy("obligation_id", "status", F.col("confidence").cast("double").alias("confidence"), "department").agg(F.count(F.lit(1)).alias("n"))


def merge_target(rows: DataFrame) -> DataFrame:
    """An empty status table with the columns that ``merge_status`` tracks."""
    now = F.lit(None).cast("timestamp")
    return rows.limit(0).select(
        "company_id", "period_id", "obligation_id", F.col("normalized_status").alias("status"), F.col("department_default").alias("department"), F.lit(None).cast("decimal(5,2)").alias("confidence"), now.alias("delivered_at"), now.alias("first_seen_at"), now.alias("last_seen_at")
    )


@query("""
WITH c AS (SELECT c_nationkey AS nation, CASE WHEN sum(CAST(round(c_acctbal * 100) AS BIGINT)) > 450000 * count(*) THEN 'LUCRO_REAL' ELSE 'SIMPLES_NACIONAL' END AS v FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS nation, CASE WHEN sum(CAST(round(s_acctbal * 100) AS BIGINT)) > 450000 * count(*) THEN 'LUCRO_REAL' ELSE 'SIMPLES_NACIONAL' END AS v FROM supplier GROUP BY 1)
SELECT nation, c.v AS left_value, s.v AS right_value FROM c JOIN s USING (nation) WHERE c.v <> s.v
""")
def regime_conflict(spark, sf_dir):
    def side(name, key, value):
        cents = F.sum(F.round(F.col(value) * 100).cast("long"))
        label = F.when(cents > 450000 * F.count(F.lit(1)), "Lucro Real").otherwise("Símples Nacional")
        return table(spark, sf_dir, name).groupBy(F.col(key).alias("nation")).agg(label.alias("label")).select("nation", R.resolve_regime("label")["canonical"].alias("v"))

    return match.find_conflicts(side("customer", "c_nationkey", "c_acctbal"), side("supplier", "s_nationkey", "s_acctbal"), ["nation"], "v")


_MAPPED_SQL = """
WITH m AS (SELECT o_orderkey, o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 'DAS' WHEN '2' THEN 'ICMS' WHEN '3' THEN 'DIFAL' END AS code FROM orders),
r AS (SELECT o_orderkey, o_orderpriority, code AS obligation_code, CASE code WHEN 'DAS' THEN 'MAPPED' WHEN 'ICMS' THEN 'AMBIGUOUS' ELSE 'UNMAPPED' END AS mapping_status FROM m)
"""


def _mapped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.regexp_replace("o_orderpriority", "-", "_").alias("name"))
    ids = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("obligation_id"), F.when(F.col("r_regionkey") == 0, "DAS").when(F.col("r_regionkey") < 3, "ICMS").otherwise(F.col("r_name")).alias("code"))
    names = {"1 URGENT": "DAS", "2 HIGH": "ICMS", "3 MEDIUM": "DIFAL"}
    return R.map_obligation(o.withColumn("name", F.regexp_replace("name", "^(.)_", "$1 ")), "name", ids, names)


@query(_MAPPED_SQL + "SELECT o_orderpriority, obligation_code, mapping_status, count(*) AS n FROM r GROUP BY ALL")
def map_alias(spark, sf_dir):
    return _mapped(spark, sf_dir).groupBy("o_orderpriority", "obligation_code", "mapping_status").agg(F.count(F.lit(1)).alias("n"))


@query(_MAPPED_SQL + "SELECT o_orderpriority AS name, count(*) AS n, count(DISTINCT o_custkey) AS companies FROM r JOIN orders USING (o_orderkey, o_orderpriority) WHERE mapping_status = 'UNMAPPED' GROUP BY 1")
def unknown_names(spark, sf_dir):
    return R.unknown_names(_mapped(spark, sf_dir), "o_orderpriority", "o_custkey")


_WORDS = {"A_THE": ("the", "of the"), "B_DE": ("de", "del"), "C_UND": ("und", "der die"), "D_LA": ("la", "le")}


@query(r"""
WITH d AS (SELECT doc_id, lang, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents),
k AS (SELECT doc_id, lang, unnest(list_filter([CASE WHEN regexp_matches(s, '\b(?:the|of the)\b') THEN 'A_THE' END, CASE WHEN regexp_matches(s, '\b(?:de|del)\b') THEN 'B_DE' END,
  CASE WHEN regexp_matches(s, '\b(?:und|der die)\b') THEN 'C_UND' END, CASE WHEN regexp_matches(s, '\b(?:la|le)\b') THEN 'D_LA' END], lambda x: x IS NOT NULL)) AS class FROM d)
SELECT lang, class, count(*) AS n FROM k GROUP BY ALL
""")
def classify_keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(R.classify_words("text", _WORDS)).alias("class"))
    return d.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS code, CASE p_partkey % 6 WHEN 0 THEN 'Férias ' WHEN 1 THEN 'Pró-Labore ' WHEN 2 THEN 'I.N.S.S. ' WHEN 3 THEN 'Horas Extras ' WHEN 4 THEN 'Rescisão ' ELSE 'Vale ' END AS w, p_partkey % 6 AS m FROM part)
SELECT signal, count(*) AS n FROM (SELECT unnest(list_filter([
  CASE WHEN m IN (0, 2, 3, 4) OR (m = 5 AND (code IN ('37') OR CAST(code AS INT) BETWEEN 1 AND 20)) THEN 'has_employee' END,
  CASE WHEN code IN ('23', '32', '35') THEN 'has_fgts' END, CASE WHEN m = 2 THEN 'has_inss' END, CASE WHEN m = 1 THEN 'has_pro_labore' END,
  CASE WHEN m = 4 THEN 'has_termination' END, CASE WHEN m = 0 THEN 'has_vacation' END], lambda x: x IS NOT NULL)) AS signal FROM p) GROUP BY 1
""")
def rubric_signals(spark, sf_dir):
    m = F.col("p_partkey") % 6
    name = F.when(m == 0, "Férias ").when(m == 1, "Pró-Labore ").when(m == 2, "I.N.S.S. ").when(m == 3, "Horas Extras ").when(m == 4, "Rescisão ").otherwise("Vale ")
    p = table(spark, sf_dir, "part").select(F.explode(R.rubric_signals("p_size", name)).alias("signal"))
    return p.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH x AS (SELECT DISTINCT o_custkey AS company_id, lpad(CAST(l_partkey % 97 AS VARCHAR), 7, '0') AS cnae, l_partkey % 97 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT company_id, cnae, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS f, CASE k % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'V' WHEN 2 THEN 'III' END AS annex FROM x),
g AS (SELECT company_id, count(*) AS cnaes_total, coalesce(list_sort(list(cnae) FILTER (WHERE f)), []) AS positive_cnaes, coalesce(list_sort(list(cnae) FILTER (WHERE NOT f)), []) AS negative_cnaes,
  coalesce(list_sort(list(cnae) FILTER (WHERE f IS NULL)), []) AS missing_cnaes, arg_min(annex, cnae) FILTER (WHERE f) AS annex_default FROM r GROUP BY 1)
SELECT *, CASE WHEN len(positive_cnaes) > 0 THEN 'APPLICABLE' WHEN len(missing_cnaes) > 0 THEN 'PARTIAL' ELSE 'NOT_APPLICABLE' END AS status FROM g
""")
def factor_r_potential(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("company_id"))
    k = F.col("l_partkey") % 97
    x = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("company_id", F.lpad(k.cast("string"), 7, "0").alias("cnae")).distinct()
    c = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("k")).distinct()
    annex = F.when(F.col("k") % 4 < 2, "V").when(F.col("k") % 4 == 2, "III")
    conditional = F.when(F.col("k") % 4 == 0, "III")
    none = F.lit(None)
    cache = c.select(F.lpad(F.col("k").cast("string"), 7, "0").alias("cnae"), R.factor_r_applicable(none.cast("boolean"), none.cast("boolean"), none.cast("string"), annex, conditional).alias("factor_r"), annex.alias("annex_default"))
    return views.factor_r_potential(x, cache)


@query("""
WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = 'N' OR l_linenumber % 2 = 0) AS calculated FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(calculated, 0) ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS declared, CAST(coalesce(calculated, 0) AS BIGINT) AS calculated,
  o_orderkey % 2 = 1 AND CAST(round(o_totalprice * 100) AS BIGINT) <> coalesce(calculated, 0) AS mismatch FROM orders JOIN l ON l_orderkey = o_orderkey
""")
def section_reconcile(spark, sf_dir):
    """Orders as sections whose total lines hold their own sum or another one; starred lines don't count."""
    li = table(spark, sf_dir, "lineitem")
    starred = (F.col("l_returnflag") != "N") & (F.col("l_linenumber") % 2 != 0)
    place = [F.lit("f").alias("file"), F.col("l_orderkey").alias("group_no"), F.lit(0).alias("block_no"), F.lit(0).alias("section_no"), F.lit("EARNINGS").alias("section")]
    rows = li.select(*place, starred.alias("starred"), F.round("l_extendedprice", 2).cast("decimal(14,2)").alias("calculated"))
    own = rows.groupBy(F.col("group_no").alias("o_orderkey")).agg(F.coalesce(F.sum(F.when(~F.col("starred"), F.col("calculated"))), F.lit(0)).alias("own"))
    declared = F.when(F.col("o_orderkey") % 2 == 0, F.col("own")).otherwise(F.round("o_totalprice", 2)).cast("decimal(14,2)")
    totals = table(spark, sf_dir, "orders").join(own, "o_orderkey").select(F.lit("f").alias("file"), F.col("o_orderkey").alias("group_no"), *place[2:], F.lit(1).alias("page_no"), F.lit(1).alias("line_no"), F.lit("SECTION").alias("kind"), declared.alias("value"))
    found = payroll.section_totals(rows, totals)
    cents = lambda c: (F.col(c) * 100).cast("long").alias(c)
    return found.select(F.col("group_no").alias("o_orderkey"), cents("declared"), cents("calculated"), (F.size("warnings") > 0).alias("mismatch"))


@query("""
WITH k AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 5 <> 0 THEN role END AS key FROM conversations),
f AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS filled FROM k),
n AS (SELECT *, CASE WHEN filled IS NOT NULL AND filled IS DISTINCT FROM lag(filled) OVER (PARTITION BY conv_id ORDER BY turn, role) THEN 1 ELSE 0 END AS new FROM f)
SELECT conv_id, turn, role, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n
""")
def group_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.length("text") % 5 != 0, F.col("role")).alias("key"))
    return ordering.islands(c, ["conv_id"], ["turn", "role"], "key").drop("key")


@query("""
SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last, min(turn) = 0 AND max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1
""")
def sequence_check(spark, sf_dir):
    return ordering.sequence_gaps(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", start=0)


@query("SELECT o_orderkey, left(sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 32) AS source_key FROM orders")
def surrogate_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.surrogate_key([F.lit("")], ["o_custkey", "o_orderstatus", "o_orderpriority"]).alias("source_key"))


@query("""
WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS b FROM customer),
d1 AS (SELECT *, list_sum(list_transform(generate_series(1, 12), lambda i: CAST(b[i] AS INT) * [5,4,3,2,9,8,7,6,5,4,3,2][i])) % 11 AS r FROM a),
d2 AS (SELECT c_custkey, b, b || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS c FROM d1),
d3 AS (SELECT *, list_sum(list_transform(generate_series(1, 13), lambda i: CAST(c[i] AS INT) * [6,5,4,3,2,9,8,7,6,5,4,3,2][i])) % 11 AS r FROM d2),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN b || '00' ELSE c || CASE WHEN r < 2 THEN 0 ELSE 11 - r END END AS cnpj, c || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS good FROM d3)
SELECT c_custkey, cnpj, CASE WHEN cnpj = good AND cnpj <> repeat(left(cnpj, 1), 14) THEN 'VALID' ELSE 'INVALID' END AS status, left(cnpj, 8) AS root,
  cnpj[1:2] || '.' || cnpj[3:5] || '.' || cnpj[6:8] || '/' || cnpj[9:12] || '-' || cnpj[13:14] AS masked FROM n
""")
def cnpj_check_digits(spark, sf_dir):
    base = F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "0")
    first = N.check_digit(F.col("b"), N.CNPJ_FIRST).cast("string")
    c = table(spark, sf_dir, "customer").select("c_custkey", base.alias("b")).select("c_custkey", "b", F.concat("b", first).alias("c"))
    full = F.concat("c", N.check_digit(F.col("c"), N.CNPJ_SECOND).cast("string"))
    c = c.select("c_custkey", N.format_cnpj(F.when(F.col("c_custkey") % 3 == 0, F.concat("b", F.lit("00"))).otherwise(full)).alias("masked"))
    return c.select("c_custkey", N.normalize_cnpj("masked").alias("cnpj"), N.validate_cnpj("masked")["status"].alias("status"), N.cnpj_root("masked").alias("root"), "masked")


@query("SELECT l_returnflag, l_linenumber, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY ALL")
def decimal_normalise(spark, sf_dir):
    text = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", (N.parse_brl_strict(text) * 100).cast("long").alias("a"), (N.parse_decimal_mixed(text) * 100).cast("long").alias("b"))
    return li.groupBy("l_returnflag", "l_linenumber").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("a"))).alias("cents"), F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, user_id % 3 = 0 AS more, count(*) OVER (PARTITION BY user_id) AS total FROM events),
u AS (SELECT * FROM e WHERE i // 25 < 100)
SELECT grp, count(DISTINCT i // 25) AS n_pages, count(*) AS n_rows, min(total) > 2500 OR bool_or(more) AS truncated FROM u GROUP BY 1
""")
def page_integrity(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("grp")
    # a set is a user; of every third the total tells of a page that never came
    more = F.when(F.col("grp") % 3 == 0, 25).otherwise(0)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), "event_id")
    e = e.select("grp", "event_id", F.floor((F.row_number().over(w.orderBy("event_id")) - 1) / 25).alias("page"), (F.count(F.lit(1)).over(w) + more).alias("total"))
    return quality.check_pages(e, ["grp"], "page", "event_id", 25, "total")


@query(r"""
WITH t AS (SELECT *, lower(strip_accents(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'))) AS t FROM pages)
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)">', 1) AS lang,
  CASE WHEN trim(coalesce(t, '')) = '' THEN 'EMPTY' WHEN contains(t, 'captcha') THEN 'CAPTCHA' WHEN contains(t, 'login') OR contains(t, 'senha') OR contains(t, 'entrar') THEN 'LOGIN' WHEN contains(t, 'about') THEN 'OK' ELSE 'MARKER_MISSING' END AS gate FROM t
""")
def html_fields(spark, sf_dir):
    """Fields of pages, and the gate that the jobs put before rule pages."""
    p = table(spark, sf_dir, "pages").select(F.struct("page_id", "html").alias("page_key"), F.lit("page").alias("kind"), "html")
    p = rule_pages.page_texts(p, {"page": ("about",)})
    of = lambda pattern: F.regexp_extract("page_key.html", pattern, 1)
    return p.select("page_key.page_id", of("<title>([^<]*)</title>").alias("title"), of('<html lang="([a-z]+)">').alias("lang"), "gate")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000012') OR contains(CAST(c_custkey AS VARCHAR), '00000012')")
def search_companies(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return quality.search_companies(c, "R#00000012", ["c_name"], "c_custkey")


@query("""
WITH m AS (SELECT o_orderpriority AS grp, strftime(o_orderdate, '%Y-%m') AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL)
SELECT grp, CAST(sum(n) AS BIGINT) AS received, CAST(sum(n) FILTER (WHERE s = 'F') AS BIGINT) AS delivered, CAST(sum(n) FILTER (WHERE s = 'O') AS BIGINT) AS open_n, CAST(sum(n) FILTER (WHERE s = 'P') AS BIGINT) AS partial_n FROM m GROUP BY 1
""")
def range_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.date_format("o_orderdate", "yyyy-MM").alias("p"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    per = o.groupBy("grp", "p").agg(F.sum("n").alias("received"), F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("names"))
    s = views.merge_range_summary(per, ["received"], "names", "grp")
    return s.select("grp", "received", *[F.try_element_at("names", F.lit(k)).alias(v) for k, v in (("F", "delivered"), ("O", "open_n"), ("P", "partial_n"))])


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS competencia, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 0 GROUP BY 1
""")
def countable_revenue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cancelled", F.col("o_orderstatus") == "P").withColumn("substituted_by_key", F.when(F.col("o_orderkey") % 11 == 0, "x").when(F.col("o_orderkey") % 11 == 1, ""))
    return quality.countable_revenue(o).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("competencia")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("""
SELECT event_id, CASE WHEN length(CAST(user_id AS VARCHAR)) <= 2 THEN repeat('*', length(CAST(user_id AS VARCHAR))) ELSE left(CAST(user_id AS VARCHAR), 1) || repeat('*', length(CAST(user_id AS VARCHAR)) - 2) || right(CAST(user_id AS VARCHAR), 1) END AS masked_user,
  regexp_replace(props, '[0-9]', '#', 'g') AS message FROM events
""")
def redact_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.mask_value(F.col("user_id").cast("string"), 1, 1).alias("masked_user"), N.sanitize_message("props").alias("message"))


@query("""
SELECT 'Resumo_' || strftime(o_orderdate, '%m-%Y') || '_' || o_custkey || '.pdf' AS file, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS company_code, strftime(o_orderdate, '%Y-%m') AS payroll, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m') AS assessment,
  count(*) AS n_rubrics, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag <> 'R') AS gross_cents, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = 'R') AS informational_cents,
  CASE WHEN o_orderkey % 7 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate
""")
def payroll_companies(spark, sf_dir):
    found = payroll.parse_report(report_pages(spark, sf_dir))["companies"]
    cents = lambda c: (F.col(c) * 100).cast("long")
    return found.select("file", "company_code", "payroll", "assessment", "n_rubrics", cents("gross").alias("gross_cents"), cents("informational").alias("informational_cents"), "confidence")


def report_pages(spark, sf_dir) -> DataFrame:
    """Order lines written as report pages (one an order; returned lines are informational), a file a month and customer, and read back."""
    money = lambda c: F.translate(F.format_number(F.col(c).cast("double"), 2), ",.", ".,")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").alias("info"), F.round("l_extendedprice", 2).cast("decimal(14,2)").alias("v"), (F.col("l_partkey") % 1000 + 1000).cast("int").alias("code"))
    # Numbers are dealt out, not text; an order's lines lie far apart in the table, so lists made before that would hold about one each.
    li = li.repartition("o_orderkey").withColumn("line", F.concat_ws(" ", F.lit("RUBRICA"), F.col("code").cast("string"), F.lit("1"), F.lit("10:30"), money("v")))
    order = Window.partitionBy("o_orderkey").orderBy("line")
    w = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = li.select(
        "o_orderkey", F.row_number().over(order).alias("n"),
        *[F.collect_list(F.when(F.col("info") == i, F.col("line"))).over(w).alias(n) for n, i in (("paid", False), ("info", True))],
        *[F.sum(F.when(F.col("info") == i, F.col("v"))).over(w).alias(n) for n, i in (("paid_total", False), ("info_total", True))],
    ).where("n = 1").drop("n").withColumns({c: F.array_join(c, "\n") for c in ("paid", "info")})
    code = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    total = lambda head, body, s: F.when(F.col(s).isNotNull(), F.concat(F.lit(f"{head}\n"), body, F.lit("\n"), money(s), F.lit("Total:")))
    text = F.concat_ws(
        "\n", F.lit("1/1Página:"), F.lit("RESUMO DA FOLHA"), F.concat(F.lit("Empresa: "), code, F.lit(" - X")), F.lit("CNPJ: 11.222.333/0001-81 Emissão: 01/01/2026"),
        F.concat(F.lit("Competência: "), F.date_format("o_orderdate", "MM/yyyy")), F.lit("Folha Mensal"), total("PROVENTOS", F.col("paid"), "paid_total"), total("INFORMATIVA", F.col("info"), "info_total"),
        F.when(F.col("o_orderkey") % 7 != 0, F.lit("1,00Líquido Geral:")),
    )
    file = F.concat(F.lit("Resumo_"), F.date_format("o_orderdate", "MM-yyyy"), F.lit("_"), F.col("o_custkey").cast("string"), F.lit(".pdf"))
    # Both sides of the join are tables of the same growth; it is left to the sort-merge join.
    return o.join(part.hint("merge"), "o_orderkey").select(file.alias("file"), F.col("o_orderkey").alias("page_no"), text.alias("text"))


@query("""
WITH p AS (SELECT p_partkey, ['III', 'IV', 'V', ''][1 + p_size % 4] AS annex, p_partkey % 3 AS k, p_type FROM part)
SELECT p_partkey, CASE WHEN k = 2 THEN 'PROHIBITED' WHEN annex = '' AND k = 1 THEN 'UNKNOWN' ELSE 'ALLOWED' END AS status,
  CASE WHEN k = 2 THEN NULL WHEN k = 0 THEN 'V' WHEN annex = '' THEN NULL ELSE annex END AS annex_default, CASE WHEN k = 0 THEN 'III' END AS annex_conditional,
  CASE WHEN k = 2 THEN false WHEN k = 0 THEN true WHEN annex IN ('III', 'IV') THEN false END AS factor_r,
  CASE WHEN k = 0 THEN 28.0 END AS factor_r_threshold, CASE WHEN k = 1 THEN [p_type] ELSE [] END AS unmapped FROM p
""")
def rule_pages_simples(spark, sf_dir):
    """Parts written as tax and obligation pages and read back."""
    k = F.col("p_partkey") % 3
    annex = F.get(F.array(*map(F.lit, ("III", "IV", "V", ""))), F.col("p_size") % 4)
    rule = F.lit('<p>Anexo V.</p><p>Sujeito ao Fator "r".</p><p>Anexo III quando o Fator r for igual ou superior a 28,00%.</p>')
    body = F.when(k == 0, rule).when(k == 2, F.lit("<p>Atividade impedida ao Simples Nacional</p>")).otherwise(F.concat(F.lit("<p>Anexo "), annex, F.lit("</p>")))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat(F.lit("<html><body><b>Simples&nbsp;Nacional</b>"), body, F.lit("</body></html>")).alias("html"), k.alias("k"))
    row = lambda c: F.concat(F.lit('<tr><td width="90%"><p>'), c, F.lit("</p></td><td>-</td></tr>"))
    listed = F.concat(F.lit('Simples Nacional<table class="tabelaResultados"><tr><td>Obrigacao</td></tr>'), row(F.when(F.col("k") == 1, F.col("p_type")).otherwise("EFD-Reinf")), F.lit("</table>"))
    key = F.col("p_partkey").alias("page_key")
    tax = rule_pages.simples_rules(rule_pages.page_texts(p.select(key, F.lit("simples").alias("kind"), "html")))
    owed = rule_pages.obligations_simples(rule_pages.page_texts(p.select(key, F.lit("obligations_simples").alias("kind"), listed.alias("html"))))
    out = tax.hint("merge").join(owed.select("page_key", "unmapped").hint("merge"), "page_key")
    return out.select(F.col("page_key").alias("p_partkey"), "status", "annex_default", "annex_conditional", "factor_r", F.col("factor_r_threshold").cast("double").alias("factor_r_threshold"), "unmapped")


@query("""
SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE left(sha256(concat_ws('|', 'SAIDA', strftime(o_orderdate, '%Y-%m'), CAST(o_custkey AS VARCHAR), '', '', o_orderstatus, '')), 32) END AS source_document_key,
  strftime(o_orderdate, '%Y-%m') AS period, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS status, ['5102', o_orderpriority] AS cfops, o_orderkey % 3 = 0 AS has_xml FROM orders
""")
def map_documents(spark, sf_dir):
    """Orders written as landed documents, with and without an id."""
    item = F.struct(
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("id"), F.col("o_custkey").alias("numero"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "MM/yyyy").alias("data_competencia"),
        F.concat(F.lit("5102, "), F.col("o_orderpriority")).alias("cfops"), F.round("o_totalprice", 2).cast("decimal(14,2)").alias("valor_total"), (F.col("o_orderkey") % 3 == 0).alias("tem_xml"),
    )
    rows = assessments.map_document(table(spark, sf_dir, "orders").select(F.to_json(item).alias("item")), "SAIDA")
    return rows.select("source_document_key", "period", (F.col("total_amount") * 100).cast("long").alias("cents"), "status", "cfops", "has_xml")


@query("""
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS p, o_totalprice, lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS cnpj, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, 'apuracao:' || cnpj || ':' || p AS assessment_id, CASE WHEN k = 1 THEN lpad('7', 14, '0') ELSE cnpj END AS confirmed_cnpj, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, k = 0 AS has_payroll,
  list_filter([CASE WHEN k = 3 THEN 'rejected' END, CASE WHEN k = 1 AND cnpj <> lpad('7', 14, '0') THEN 'company' END, CASE WHEN k = 2 THEN 'period' END], lambda x: x IS NOT NULL) AS errors FROM o
""")
def map_assessments(spark, sf_dir):
    """Orders written as replies for a company and period; some are about another one or rejected."""
    k, cnpj, month = F.col("o_orderkey") % 5, F.lpad(F.col("o_custkey").cast("string"), 14, "0"), F.date_format("o_orderdate", "MM/yyyy")
    data = F.struct(
        F.when(k == 1, F.lpad(F.lit("7"), 14, "0")).alias("empresaCnpj"), F.when(k == 2, "01/1901").otherwise(month).alias("periodoFiscal"), F.round("o_totalprice", 2).cast("decimal(14,2)").alias("valorDas"),
        F.array(F.struct(cnpj.alias("cnpj"), (k == 0).alias("empresaTemFolha"))).alias("empresasApuracao"), F.when(k == 1, False).alias("folhaDePagamentos"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", cnpj.alias("requested_cnpj"), F.date_format("o_orderdate", "yyyy-MM").alias("requested_period"), F.to_json(F.struct((k != 3).alias("ok"), data.alias("data"))).alias("body"))
    rows = assessments.map_assessment(o, keep=("o_orderkey",))
    return rows.select("o_orderkey", "assessment_id", "confirmed_cnpj", (F.col("das_amount") * 100).cast("long").alias("cents"), F.col("company_has_payroll").alias("has_payroll"), "errors")
