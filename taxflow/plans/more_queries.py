"""Further queries over the driver's tables: feeds, quarantine, lists, summaries, seeds and sorts, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxflow.functions import classify as R
from taxflow.functions import normalize as N
from taxflow.operators import enrichment, match, merge, ordering, payroll, quality, rule_pages
from taxflow.plans import catalogs, views
from taxflow.plans.queries import _companies, query, report_pages, table
from taxflow.sources import assessments, feeds
from taxflow.staging import dealt, staged
from taxflow.streaming import streams


def _then():
    return F.lit("2026-01-01").cast("timestamp")


def _now():
    return F.lit("2026-02-01").cast("timestamp")


@query("""
WITH o AS (SELECT *, o_orderkey % 7 AS k, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0] ELSE [0, 1] END) AS nth FROM orders WHERE o_orderkey % 7 <> 0)
SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(o_custkey AS VARCHAR) AS external_company_id, lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS cnpj, CASE WHEN k <> 3 THEN CAST(o_orderkey * 2 + nth AS VARCHAR) END AS external_delivery_id, '77' AS external_item_id,
  CASE WHEN nth = 0 THEN 'DAS' ELSE 'GPS' END AS name, CASE WHEN k = 1 THEN 'T' ELSE 'O' END AS type, CAST(o_orderdate AS DATE) AS due_date, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS delivered_on,
  CASE WHEN o_orderstatus = 'F' AND k = 2 THEN 'CONFERENCIA_MANUAL' WHEN o_orderstatus = 'F' THEN 'CONFIRMADO_API' WHEN k = 2 THEN 'PENDENTE' ELSE 'CONFERENCIA_MANUAL' END AS normalized_status,
  CASE k WHEN 3 THEN 'FISCAL' WHEN 4 THEN 'DP' ELSE 'COMPARTILHADO' END AS department, CASE k WHEN 5 THEN 'READ' WHEN 6 THEN 'UNREAD' END AS guide_read_status, CASE WHEN k = 5 THEN true WHEN k = 6 THEN false END AS has_penalty,
  CASE WHEN k = 3 THEN ['external_delivery_id'] ELSE [] END AS missing
FROM o
""")
def map_deliveries(spark, sf_dir):
    """Orders written as pages of a delivery feed, a block an order with one item or a list of two, and some error pages."""
    k, day = F.col("o_orderkey") % 7, F.date_format("o_orderdate", "yyyy-MM-dd")

    def item(nth):
        config = F.struct(
            F.when(k != 3, (F.col("o_orderkey") * 2 + nth).cast("string")).alias("EntID"), F.lit("77").alias("ID"), F.when(k == 1, "T").otherwise("o").alias("Tipo"),
            F.when(k == 3, "Fiscal").when(k == 4, "Departamento Pessoal").otherwise("Contabil").alias("DptoNome"),
        )
        return F.to_json(F.struct(
            F.lit("DAS" if nth == 0 else "GPS").alias("Nome"), day.alias("EntDtPrazo"), F.when(F.col("o_orderstatus") == "F", day).otherwise("0000-00-00").alias("EntDtEntrega"), F.when(k == 2, "Pendente").otherwise("Ent. antecipada").alias("Status"),
            F.when(k == 5, "Lida").when(k == 6, "Não").alias("EntGuiaLida"), F.when(k == 5, "s").when(k == 6, "N").alias("EntMulta"), config.alias("Config"),
        ))

    items = F.when(F.col("o_orderkey") % 2 == 0, item(0)).otherwise(F.concat(F.lit("["), item(0), F.lit(","), item(1), F.lit("]")))
    block = F.concat(F.lit('{"ID": "'), F.col("o_custkey").cast("string"), F.lit('", "Identificador": "'), F.lpad(F.col("o_custkey").cast("string"), 14, "0"), F.lit('", "Razao": "X", "Entregas": '), items, F.lit("}"))
    body = F.when(k == 0, '{"Erro": "limit"}').otherwise(block)
    rows = feeds.delivery_items(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), body.alias("body")))
    found = feeds.map_delivery(rows.where("error_message IS NULL"))
    return found.select(
        "period", "external_company_id", "cnpj", "external_delivery_id", "external_item_id", "name", "type", "due_date", "delivered_on", "normalized_status", "department", "guide_read_status", "has_penalty", F.col("errors").alias("missing")
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS external_company_id, ['SIMPLES_NACIONAL', 'LUCRO_REAL', 'MEI', NULL, NULL][1 + c_custkey % 5] AS regime_canonical,
  CASE c_custkey % 5 WHEN 3 THEN 'UNMAPPED' WHEN 4 THEN 'MISSING' ELSE 'MAPPED' END AS regime_mapping_status, CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 5 = 2 THEN 6 END AS regime_code,
  CASE WHEN c_custkey % 5 = 0 THEN ['external_company_id'] ELSE [] END AS errors,
  CASE c_custkey % 5 WHEN 0 THEN 'Simples Nacional' WHEN 1 THEN 'Lucro Real' WHEN 2 THEN 'MEI' WHEN 3 THEN 'Regime nao mapeado' ELSE 'Aguardando regime' END AS regime_label FROM customer
""")
def map_feed_companies(spark, sf_dir):
    """Customers written as companies of a feed with codes, labels and no regime."""
    k = F.col("c_custkey") % 5
    regime = F.when(k == 0, "1").when(k == 1, "Lucro Real - Serviços").when(k == 2, "6").when(k == 3, "Outro")
    item = F.to_json(F.struct(F.when(k != 0, F.col("c_custkey")).alias("ID"), F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("Identificador"), F.col("c_name").alias("Razao"), regime.alias("Regime")))
    rows = feeds.map_feed_company(table(spark, sf_dir, "customer").select(item.alias("item")))
    return rows.select(
        F.col("cnpj").cast("long").alias("c_custkey"), "external_company_id", "regime_canonical", "regime_mapping_status", "regime_code", "errors", N.display_regime("regime_canonical", "regime_mapping_status").alias("regime_label")
    )


@query("""
WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 10 <> 3) AS items, sum(o_orderkey) FILTER (WHERE o_orderkey % 10 <> 3) AS keys FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 'sucesso' WHEN o_custkey % 4 = 1 THEN 'lista' END AS reason, CASE WHEN o_custkey % 4 > 1 THEN items END AS items, CASE WHEN o_custkey % 4 > 1 THEN CAST(keys AS BIGINT) END AS keys,
  CASE WHEN o_custkey % 4 > 1 AND items > 0 THEN CAST(n AS INTEGER) END AS total FROM p JOIN i USING (o_custkey)
""")
def list_pages(spark, sf_dir):
    """Orders written as one page a customer; some pages failed, and some entries are no objects."""
    entry = F.when(F.col("o_orderkey") % 10 == 3, '"x"').otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("id"))))
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), ",").alias("e"), F.count(F.lit(1)).alias("n"))
    k, n = F.col("o_custkey") % 4, F.col("n").cast("string")
    body = F.concat(F.lit('{"sucesso": '), F.when(k == 0, "false").otherwise("true"), F.lit(', "total": '), n, F.when(k == 1, '}').otherwise(F.concat(F.lit(', "lista": ['), F.col("e"), F.lit("]}"))))
    pages = listed.select("o_custkey", body.alias("body"))
    items, failures = feeds.list_pages(pages, keep=("o_custkey",))
    sums = items.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("items"), F.sum(F.get_json_object("item", "$.id").cast("long")).alias("keys"), F.max("total").alias("total"))
    out = listed.select("o_custkey").join(failures, "o_custkey", "left").join(sums.hint("merge"), "o_custkey", "left")
    return out.select("o_custkey", "reason", F.when(F.col("reason").isNull(), F.coalesce("items", F.lit(0))).alias("items"), "keys", "total")


@query("""
WITH c AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_custkey % 9 = 2) AS bad FROM customer GROUP BY 1)
SELECT c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE n - bad END AS items, CASE WHEN c_nationkey % 3 = 0 THEN n ELSE bad END AS failures FROM c
""")
def assessment_company_pages(spark, sf_dir):
    """Customers written as one page a nation, with failed pages and entries that are no objects."""
    entry = F.when(F.col("c_custkey") % 9 == 2, "7").otherwise(F.to_json(F.struct(F.col("c_custkey").alias("id"))))
    pages = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(entry), ",").alias("e"))
    body = F.concat(F.lit('{"sucesso": '), (F.col("c_nationkey") % 3 != 0).cast("string"), F.lit(', "empresas": ['), F.col("e"), F.lit("]}"))
    items, failures = feeds.assessment_company_items(pages.select("c_nationkey", body.alias("body")), keep=("c_nationkey",))
    both = items.select("c_nationkey", F.lit(1).alias("i"), F.lit(0).alias("f")).unionByName(failures.select("c_nationkey", F.lit(0).alias("i"), F.lit(1).alias("f")))
    return both.groupBy("c_nationkey").agg(F.sum("i").alias("items"), F.sum("f").alias("failures"))


@query("SELECT page_id, sha256(nfc_normalize(html)) AS digest, page_id % 3 AS kind FROM pages")
def decode_html(spark, sf_dir):
    """Pages as bytes: UTF-8 with and without a header, and, where they fit, Latin-1 named in the header."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", (F.col("page_id") % 3).alias("kind"))
    fits = (F.col("kind") == 2) & ~F.col("html").rlike("[^\\x00-\\x{FF}]")
    p = p.select("page_id", "kind", F.when(fits, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8")).alias("content"), F.when(fits, "text/html; charset=ISO-8859-1").when(F.col("kind") == 1, "text/html; charset=utf-8").alias("content_type"))
    return p.select("page_id", F.sha2(feeds.decode_html("content", "content_type"), 256).alias("digest"), "kind")


@query("""
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%m-%Y') AS m, o_orderdate, o_orderkey % 3 AS k, o_orderpriority AS body FROM orders)
SELECT CASE k WHEN 0 THEN 'Resumo_' || m || '_' || o_orderkey || '.pdf' WHEN 1 THEN 'Resumo_' || m || '_a_' || strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%m-%Y') || '_' || o_orderkey || '.pdf' ELSE 'x' || o_orderkey || '.pdf' END AS path,
  CAST(length(body) AS BIGINT) AS size, sha256(body) AS sha256, CASE WHEN k < 2 THEN strftime(o_orderdate, '%Y-%m') END AS competencia, CASE WHEN k = 1 THEN strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m') END AS range_end,
  CASE k WHEN 0 THEN strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') WHEN 1 THEN strftime(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, '%Y-%m') END AS target_competencia, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_pages FROM o
""")
def file_manifest(spark, sf_dir):
    """Orders as files named after months and ranges of months; their lines are pages."""
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    m, later = F.date_format("o_orderdate", "MM-yyyy"), F.date_format(F.add_months(F.trunc("o_orderdate", "month"), 2), "MM-yyyy")
    path = F.when(k == 0, F.concat(F.lit("Resumo_"), m, F.lit("_"), key, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("Resumo_"), m, F.lit("_a_"), later, F.lit("_"), key, F.lit(".pdf"))).otherwise(F.concat(F.lit("x"), key, F.lit(".pdf")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), F.encode("o_orderpriority", "UTF-8").alias("content"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    counts = o.join(lines, "o_orderkey", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_pages"))
    return feeds.manifest(o.select("path", "content"), counts)


@query("""
WITH r AS (SELECT event_id AS run_id, event_type AS provider, value, user_id % 4 AS failures FROM events)
SELECT run_id, provider, CASE WHEN value < 20 THEN 'RUNNING' WHEN floor(value) = 50 THEN 'FAILED' WHEN failures > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN value >= 20 THEN failures END AS failures FROM r
""")
def run_ledger(spark, sf_dir):
    """Events as runs: each has a RUNNING row, those that ended a second one with counts and the status that follows from them."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("provider"), "value", "ts", (F.col("user_id") % 4).alias("failures"))
    none = F.lit(None)
    begun = e.select("run_id", "provider", F.lit("RUNNING").alias("status"), none.cast("long").alias("failures"), F.col("ts").alias("started_at"), none.cast("timestamp").alias("finished_at"))
    received = F.when(F.floor("value") == 50, 0).otherwise(9)
    done = e.where("value >= 20").select("run_id", "provider", R.run_status(received, F.col("failures"), F.lit(0)).alias("status"), F.col("failures").cast("long").alias("failures"), F.col("ts").cast("timestamp").alias("started_at"), F.col("ts").cast("timestamp").alias("finished_at"))
    return feeds.last_runs(begun.withColumn("started_at", F.col("started_at").cast("timestamp")).unionByName(done)).select("run_id", "provider", "status", "failures")


@query("""
SELECT event_type, CAST(user_id AS VARCHAR) AS actor_id, 'user' AS actor_type, NULL AS resource_type, count(*) AS n, sum(CAST(json_extract_string(m, '$.event_id') AS BIGINT)) AS ids
FROM (SELECT *, json_object('event_id', event_id) AS m FROM events) WHERE value IS NOT NULL GROUP BY ALL
""")
def audit_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").cast("string").alias("message"), F.lit("user").alias("actor_type"), F.col("user_id").alias("actor_id"), "event_id")
    rows = feeds.audit_rows(e, ["event_id"])
    return rows.groupBy("event_type", "actor_id", "actor_type", "resource_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("event_metadata", "$.event_id").cast("long")).alias("ids"))


@query("""
SELECT event_id, repeat('{"a":', CAST(event_id % 8 AS INT)) || '{"user":' || user_id || ',"Token":"<REDACTED>","note":"} \\" {","list":[{"secret":"<REDACTED>"},"<REDACTED_JWT>",1.5,null],"senha":"<REDACTED>"}' || repeat('}', CAST(event_id % 8 AS INT)) AS body, 'KEPT' AS body_status, '<REDACTED>' AS cookie, 'v' || user_id AS other FROM events
""")
def http_log(spark, sf_dir):
    """Events as captured messages with secrets one to eight levels deep, braces and quotes inside of texts, and an escaped key."""
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    user, depth = F.col("user_id").cast("string"), (F.col("event_id") % 8).cast("int")
    secret = F.concat(F.lit(', "Token":{"a":"}","b":[{"c":"'), user, F.lit('"}]}, "note":"} \\" {", "list":[{"secret":'), user, F.lit(f'}},"{token}", 1.5, null], "sen\\u0068a":"x \\" }}"}}'))
    body = F.concat(F.repeat(F.lit('{"a": '), depth), F.lit('{"user":'), user, secret, F.repeat(F.lit("}"), depth))
    headers = F.create_map(F.lit("Set-Cookie"), user, F.lit("X-Other"), F.concat(F.lit("v"), user))
    found = feeds.sanitize_http_log(table(spark, sf_dir, "events").select("event_id", headers.alias("headers"), body.alias("body"), F.lit("application/json").alias("content_type")))
    return found.select("event_id", "body", "body_status", F.col("headers")["Set-Cookie"].alias("cookie"), F.col("headers")["X-Other"].alias("other"))


@query("""
WITH e AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 50000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_orderkey % 5 = 0 THEN 'key' END], lambda x: x IS NOT NULL) AS errors,
  o_orderkey % 3 = 0 AS context, o_orderkey % 4 = 0 AS lost FROM orders)
SELECT len(errors) = 0 AS good, array_to_string(errors, ',') AS errors, context, lost, count(*) AS n FROM e GROUP BY ALL
""")
def quarantine(spark, sf_dir):
    """Orders split by rules, by the context that they were asked for, and by not-found messages."""
    o = table(spark, sf_dir, "orders").withColumns({"asked": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")), "message": F.when(F.col("o_orderkey") % 4 == 0, "HTTP 404 for it").when(F.col("o_orderkey") % 4 == 1, "ok")})
    good, bad = quality.validate(o, {"price": F.col("o_totalprice") < 50000, "status": F.col("o_orderstatus") == "P", "key": F.col("o_orderkey") % 5 == 0})
    rows = good.withColumn("errors", F.array().cast("array<string>")).unionByName(bad)
    same, other = quality.check_context(rows, {"o_custkey": "asked"})
    rows = same.withColumn("context", F.lit(False)).unionByName(other.withColumn("context", F.lit(True)))
    there, lost = quality.split_not_found(rows)
    rows = there.withColumn("lost", F.lit(False)).unionByName(lost.withColumn("lost", F.lit(True)))
    return rows.groupBy((F.size("errors") == 0).alias("good"), F.array_join("errors", ",").alias("errors"), "context", "lost").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS organization_id, c_custkey AS company_id, c_name AS name, c_acctbal > 0 AS active FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT company_id, name FROM c WHERE organization_id = 2 AND active ORDER BY name, company_id LIMIT 50
""")
def company_list(spark, sf_dir):
    """The company list of a tenant: a page of at most 50, whatever is asked for."""
    own = quality.scope(_companies(spark, sf_dir), 2)
    return ordering.limit_capped(ordering.sort_companies(own), 80).select("company_id", "name")


@query("""
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'T' ELSE 'O' END AS type, CASE WHEN o_orderpriority LIKE '1%' THEN 'MAPPED' ELSE 'UNMAPPED' END AS mapping_status, ['FISCAL', 'DP', 'COMPARTILHADO'][1 + o_orderkey % 3] AS department FROM orders)
SELECT type, mapping_status, department, count(*) AS n FROM d WHERE type = 'O' AND (mapping_status = 'MAPPED' OR department = 'FISCAL') GROUP BY ALL
""")
def fiscal_deliveries(spark, sf_dir):
    name = F.get(F.array(F.lit("fiscal"), F.lit("Pessoal"), F.lit("Contábil")), (F.col("o_orderkey") % 3).cast("int"))
    d = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 4 == 0, "T").otherwise("O").alias("type"), F.when(F.col("o_orderpriority").startswith("1"), "MAPPED").otherwise("UNMAPPED").alias("mapping_status"), R.map_department(name, F.lit("COMPARTILHADO")).alias("department")
    )
    return quality.fiscal_only(d).groupBy("type", "mapping_status", "department").agg(F.count(F.lit(1)).alias("n"))


_CACHE_SQL = """
c AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS cnae, CASE WHEN p_partkey % 5 = 0 THEN 'FAILED' ELSE 'PARSED' END AS parse_status, CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE 'v' END AS parser_version,
  TIMESTAMP '2026-02-01' + (p_size - 10) * INTERVAL 1 DAY AS expires_at, TIMESTAMP '2025-12-01' + p_size * INTERVAL 1 DAY AS retrieved_at FROM part)
"""


def _cache(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.lpad(k.cast("string"), 7, "0").alias("cnae"), F.when(k % 5 == 0, "FAILED").otherwise("PARSED").alias("parse_status"), F.when(k % 7 == 0, "old").otherwise("v").alias("parser_version"),
        F.expr("timestamp'2026-02-01' + make_dt_interval(p_size - 10)").alias("expires_at"), F.expr("timestamp'2025-12-01' + make_dt_interval(p_size)").alias("retrieved_at"),
    )


@query("WITH " + _CACHE_SQL + ", x AS (SELECT DISTINCT l_suppkey AS company_id, l_partkey AS k FROM lineitem) SELECT company_id, count(*) AS codes, count(*) FILTER (WHERE parse_status = 'PARSED' AND expires_at > TIMESTAMP '2026-02-01' AND parser_version = 'v') AS fresh FROM x LEFT JOIN c USING (k) GROUP BY 1")
def fresh_cache(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.lpad(F.col("l_partkey").cast("string"), 7, "0").alias("cnae")).distinct()
    both = views.join_fresh_cache(x, _cache(spark, sf_dir), _now(), "v")
    return both.groupBy("company_id").agg(F.count(F.lit(1)).alias("codes"), F.count("parse_status").alias("fresh"))


@query("WITH " + _CACHE_SQL + " SELECT count(*) AS items, count(*) FILTER (WHERE expires_at < TIMESTAMP '2026-02-01') AS expired_items, count(*) FILTER (WHERE parser_version <> 'v') AS outdated_items, strftime(max(retrieved_at), '%Y-%m-%d') AS last_refresh FROM c")
def cache_health(spark, sf_dir):
    return views.cache_health(_cache(spark, sf_dir), _now(), "v").withColumn("last_refresh", F.date_format("last_refresh", "yyyy-MM-dd"))


_CATALOG_SQL = "x AS (SELECT l_suppkey AS company_id, lpad(CAST(l_partkey % 300 AS VARCHAR), 7, '0') AS cnae, min(l_linenumber) = 1 AS is_primary, max(l_quantity) > 20 AS active FROM lineitem GROUP BY ALL)"


def _catalog(spark, sf_dir):
    cnae = F.lpad((F.col("l_partkey") % 300).cast("string"), 7, "0").alias("cnae")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_id"), cnae).agg((F.min("l_linenumber") == 1).alias("is_primary"), (F.max("l_quantity") > 20).alias("active"))


@query("WITH " + _CATALOG_SQL + " SELECT count(*) AS active_items, count(DISTINCT cnae) AS unique_cnaes, count(DISTINCT company_id) AS companies FROM x WHERE active")
def catalog_counts(spark, sf_dir):
    return views.catalog_counts(_catalog(spark, sf_dir))


@query("WITH " + _CATALOG_SQL + " SELECT DISTINCT CAST(NULL AS INTEGER) AS position, cnae FROM x JOIN supplier ON s_suppkey = company_id WHERE active AND s_acctbal > 0 AND cnae <> '0000000'")
def target_cnaes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), (F.col("s_acctbal") > 0).alias("active"))
    return quality.target_cnaes(match.unique_active_cnaes(_catalog(spark, sf_dir), s))


@query("WITH " + _CATALOG_SQL + ", v AS (SELECT company_id, count(*) AS n FROM x WHERE active AND is_primary GROUP BY 1 HAVING count(*) > 1) SELECT 'primary' AS kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM v UNION ALL SELECT 'unique', count(*), CAST(sum(c) AS BIGINT) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey, l_partkey % 300 HAVING count(*) > 1) UNION ALL SELECT 'cnae_seven_digits', count(*), count(*) FROM x WHERE company_id % 10 = 0")
def constraint_checks(spark, sf_dir):
    """Violations: several active primaries, repeated keys, and codes that aren't seven digits."""
    x = _catalog(spark, sf_dir)
    every = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 300).alias("p"))
    broken = quality.table_violations(x.withColumn("cnae", F.when(F.col("company_id") % 10 == 0, F.substring("cnae", 2, 6)).otherwise(F.col("cnae"))), "company_cnae")
    parts = [quality.primary_conflicts(x).agg(F.lit("primary").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")), quality.assert_unique(every, ["l_suppkey", "p"]).agg(F.lit("unique").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"))]
    third = broken.groupBy(F.col("constraint").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("total"))
    return parts[0].unionByName(parts[1]).unionByName(third)


@query("SELECT match_status, count(*) AS n FROM (SELECT ['MATCHED', 'UNMATCHED', 'AMBIGUOUS', 'INVALID_CNPJ'][1 + c_custkey % 4] AS match_status FROM customer) WHERE match_status <> 'MATCHED' GROUP BY 1 UNION ALL SELECT 'first ' || c_custkey, 1 FROM (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 ORDER BY 1 LIMIT 7)")
def sync_candidates(spark, sf_dir):
    """The first seven candidates, and how many rows are skipped for which reason."""
    status = F.get(F.array(*map(F.lit, ("MATCHED", "UNMATCHED", "AMBIGUOUS", "INVALID_CNPJ"))), (F.col("c_custkey") % 4).cast("int"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), status.alias("match_status"))
    first = quality.select_candidates(c, limit=7).select(F.concat(F.lit("first "), F.col("company_id").cast("string")).alias("match_status"), F.lit(1).cast("long").alias("n"))
    return quality.skipped_candidates(c).unionByName(first)


@query("SELECT l_returnflag, count(*) AS n, count(p_name) AS named, count(DISTINCT p_brand) AS brands FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey GROUP BY 1")
def match_master(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_partkey").alias("p_partkey"))
    both = match.match_master(li, table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey", "p_name", "p_brand"), ["p_partkey"])
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("p_name").alias("named"), F.count_distinct("p_brand").alias("brands"))


_LIST_SQL = """
c AS (SELECT CAST(n_regionkey AS BIGINT) AS organization_id, c_custkey AS company_id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT c.organization_id, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS company_id, o_orderkey % 6 AS obligation_id, CAST(strftime(o_orderdate, '%Y') AS BIGINT) AS period_id FROM orders JOIN c ON c.company_id = o_custkey),
b AS (SELECT r_regionkey AS obligation_id, r_name AS code FROM region)
"""


def _list_rows(spark, sf_dir):
    c = _companies(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("company_id")).join(c.select("company_id", "organization_id"), "company_id")
    gone = F.when(F.col("o_orderkey") % 5 == 0, F.col("company_id") + 1000000).otherwise(F.col("company_id"))
    return c, o.select("organization_id", F.col("o_orderkey").alias("id"), gone.alias("company_id"), (F.col("o_orderkey") % 6).alias("obligation_id"), F.year("o_orderdate").cast("long").alias("period_id"))


@query("WITH " + _LIST_SQL + " SELECT o.id, o.company_id, name AS company_name, code FROM o JOIN c USING (organization_id, company_id) JOIN b USING (obligation_id) WHERE period_id = 1995 AND organization_id = 1")
def deliveries_view(spark, sf_dir):
    c, o = _list_rows(spark, sf_dir)
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("obligation_id"), F.col("r_name").alias("code"), F.col("r_name").alias("name"))
    return views.deliveries_view(o, c, b, org=1, period=1995).select("id", "company_id", "company_name", "code")


def _optional(kind: str):
    return "WITH " + _LIST_SQL + f" SELECT o.id, o.company_id, name AS company_name FROM o {kind} JOIN c USING (organization_id, company_id) WHERE period_id = 1996"


@query(_optional("LEFT"))
def evidences_view(spark, sf_dir):
    c, o = _list_rows(spark, sf_dir)
    return views.evidences_view(o, c, period=1996).select("id", "company_id", "company_name")


@query(_optional("LEFT") + " AND organization_id = 3")
def divergences_view(spark, sf_dir):
    c, o = _list_rows(spark, sf_dir)
    return views.divergences_view(o, c, period=1996, org=3).select("id", "company_id", "company_name")


@query(_optional(""))
def installments_view(spark, sf_dir):
    c, o = _list_rows(spark, sf_dir)
    return views.installments_view(o, c, period=1996).select("id", "company_id", "company_name")


@query("WITH " + _LIST_SQL + " SELECT id, coalesce(code, 'OBR-' || obligation_id) AS code, coalesce(code, 'Obrigacao') AS name FROM o LEFT JOIN b USING (obligation_id)")
def attach_obligation(spark, sf_dir):
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("obligation_id"), F.col("r_name").alias("code"), F.col("r_name").alias("name"))
    return views.attach_obligation(_list_rows(spark, sf_dir)[1], b).select("id", "code", "name")


@query("SELECT o_orderkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 10 END AS snapshot_id, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS company_id FROM orders JOIN customer ON c_custkey = o_custkey")
def attach_snapshot(spark, sf_dir):
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").where(k % 3 != 0).select(k.cast("string").alias("external_company_id"), (k * 10).alias("snapshot_id"), F.when(k % 3 == 1, k).alias("company_id"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("external_company_id"))
    return views.attach_snapshot(o, s).select("o_orderkey", "snapshot_id", "company_id")


@query("""
WITH s AS (SELECT c_nationkey AS k, min(c_custkey) AS snapshot_id FROM customer GROUP BY 1)
SELECT s_suppkey, snapshot_id, CASE WHEN s_suppkey % 3 = 1 THEN 42 END AS period_id FROM supplier LEFT JOIN s ON k = s_nationkey AND s_suppkey % 4 <> 0
""")
def attach_task_company(spark, sf_dir):
    period = F.when(F.col("s_suppkey") % 3 == 1, "2026-01").otherwise("2025-12")
    tasks = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("cnpj"), period.alias("period"))
    snapshots = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cnpj"), F.col("c_custkey").alias("snapshot_id"))
    return match.attach_task_company(tasks, snapshots, "2026-01", 42).select("s_suppkey", "snapshot_id", "period_id")


@query("SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS competencia FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderkey % 2 = 0)")
def require_periods(spark, sf_dir):
    have = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.date_format("o_orderdate", "yyyy-MM").alias("competencia")).distinct()
    return match.require_periods(have, table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("competencia")).distinct())


@query("WITH n AS (SELECT p_size AS k, count(*) AS n FROM part WHERE p_partkey % 40 = 0 GROUP BY 1) SELECT s_suppkey AS cnae, CASE WHEN n = 1 THEN 'FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS search_status FROM supplier LEFT JOIN n ON k = s_suppkey")
def exact_search(spark, sf_dir):
    found = table(spark, sf_dir, "part").where("p_partkey % 40 = 0").select(F.col("p_size").cast("long").alias("cnae"))
    return match.exact_search_result(found, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cnae")))


@query("""
WITH s AS (SELECT o_custkey AS company_id, o_orderkey, o_orderkey % 6 AS b, CASE WHEN o_orderstatus = 'F' THEN 'ENTREGUE' ELSE 'PENDENTE' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS due FROM orders),
g AS (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE status = 'ENTREGUE') AS d, string_agg(coalesce(r_name, 'OBR-' || b) || ':' || status, ',' ORDER BY due NULLS LAST, o_orderkey) AS shown FROM s LEFT JOIN region ON r_regionkey = b GROUP BY 1),
a AS (SELECT o_custkey AS company_id, count(*) FILTER (WHERE l_returnflag = 'R') AS dv, count(*) FILTER (WHERE l_returnflag = 'A') AS ev, count(*) FILTER (WHERE l_returnflag = 'N') AS ins FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'ISENTO' ELSE CAST(c_custkey AS VARCHAR) END AS state_registration, CASE c_custkey % 3 WHEN 0 THEN 'Nao informado' WHEN 1 THEN c_mktsegment ELSE c_mktsegment || ' / GO' END AS place,
  CASE c_custkey % 4 WHEN 0 THEN 'Simples Nacional' WHEN 1 THEN 'Regime nao mapeado' ELSE 'Aguardando regime' END AS regime_label, coalesce(n, 0) AS obligations_total, coalesce(d, 0) AS delivered_total, coalesce(n, 0) - coalesce(d, 0) AS pending_total,
  coalesce(dv, 0) AS divergences_total, coalesce(ev, 0) AS evidences_total, coalesce(ins, 0) AS installments_total, coalesce(shown, '') AS shown
FROM customer LEFT JOIN g ON g.company_id = c_custkey LEFT JOIN a ON a.company_id = c_custkey WHERE c_acctbal > 0
""")
def company_summary(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.lit(1).alias("organization_id"), k.alias("company_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"), F.when(k % 3 == 0, " ").otherwise(k.cast("string")).alias("state_registration"),
        F.when(k % 3 != 0, F.col("c_mktsegment")).alias("city"), F.when(k % 3 == 2, "GO").alias("state"),
    )
    o = table(spark, sf_dir, "orders")
    s = o.select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("status_id"), (F.col("o_orderkey") % 6).alias("obligation_id"), F.when(F.col("o_orderstatus") == "F", "ENTREGUE").otherwise("PENDENTE").alias("status"),
        F.lit("FISCAL").alias("department"), F.lit("API").alias("source"), F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("due_date"), F.lit(None).cast("timestamp").alias("delivered_at"),
    )
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("obligation_id"), F.col("r_name").alias("code"), F.col("r_name").alias("name"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").join(o.select("o_orderkey", F.col("o_custkey").alias("company_id")), "o_orderkey")
    of = lambda flag: li.where(F.col("l_returnflag") == flag).select("company_id")
    snap = c.where("company_id % 4 < 2").select("company_id", _then().alias("updated_at"), F.col("company_id").alias("snapshot_id"), F.when(F.col("company_id") % 4 == 0, "SIMPLES_NACIONAL").alias("regime_canonical"), F.when(F.col("company_id") % 4 == 0, "MAPPED").otherwise("UNMAPPED").alias("regime_mapping_status"))
    older = snap.select("company_id", F.lit("2025-01-01").cast("timestamp").alias("updated_at"), "snapshot_id", F.lit("MEI").alias("regime_canonical"), F.lit("MAPPED").alias("regime_mapping_status"))
    out = views.company_summary(c, s, b, of("R"), of("A"), of("N"), snap.unionByName(older))
    shown = F.array_join(F.transform("obligations", lambda x: F.concat_ws(":", x["code"], x["status"])), ",")
    return out.select(
        "company_id", "state_registration", "place", "regime_label", "obligations_total", "delivered_total", "pending_total", "divergences_total", "evidences_total", "installments_total", shown.alias("shown")
    )


@query("""
WITH s AS (SELECT o_custkey AS k, count(*) AS n, arg_min(strftime(o_orderdate, '%Y'), o_orderkey) AS last_source, arg_min(o_orderpriority, o_orderkey) AS department FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT 'ENTREGUE' AS filter, CAST(n_regionkey AS BIGINT) AS organization_id, c_custkey AS company_id, c_name AS name, department, last_source, CASE c_custkey % 3 WHEN 0 THEN 'Simples Nacional' WHEN 1 THEN 'Regime nao mapeado' ELSE 'Aguardando regime' END AS regime_label,
  n AS n_obligations, n AS n_delivered, CAST(0 AS BIGINT) AS n_pending, CAST(0 AS BIGINT) AS n_divergences, 'ENTREGUE' AS overall_status
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN s ON s.k = c_custkey WHERE c_acctbal > 0
UNION ALL
SELECT 'SEM_DADOS', CAST(n_regionkey AS BIGINT), c_custkey, c_name, NULL, NULL, CASE c_custkey % 3 WHEN 0 THEN 'Simples Nacional' WHEN 1 THEN 'Regime nao mapeado' ELSE 'Aguardando regime' END, 0, 0, 0, 0, 'SEM_DADOS'
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
""")
def cockpit_filtered(spark, sf_dir):
    """The cockpit under two filters: companies without a row of the status stay only if the status is the one derived for them."""
    s = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("status_id"), F.when(F.col("o_orderstatus") == "F", "ENTREGUE").otherwise("PENDENTE").alias("status"), F.col("o_orderpriority").alias("department"), F.date_format("o_orderdate", "yyyy").alias("last_source")
    )
    companies = _companies(spark, sf_dir)
    k = F.col("company_id") % 3
    snap = companies.where(k < 2).select("company_id", _then().alias("updated_at"), F.col("company_id").alias("snapshot_id"), F.when(k == 0, "SIMPLES_NACIONAL").alias("regime_canonical"), F.when(k == 0, "MAPPED").otherwise("UNMAPPED").alias("regime_mapping_status"))
    of = lambda status: views.cockpit(companies, s, companies.limit(0).select("company_id"), status=status, department="1-URGENT", snapshots=snap).select(F.lit(status).alias("filter"), "*")
    return of("ENTREGUE").unionByName(of("SEM_DADOS"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS organization_id, 'customers' AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_regionkey, 'suppliers', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def snapshot_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("organization_id"))
    of = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("n_nationkey")).join(n, "n_nationkey")
    return views.snapshot_counts({"customers": of("customer", "c_nationkey"), "suppliers": of("supplier", "s_nationkey")})


@query("""
SELECT CASE WHEN count(*) FILTER (WHERE k IN (5, 6)) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, count(*) AS processed, count(*) FILTER (WHERE k = 0) AS fresh_cache, count(*) FILTER (WHERE k = 1) AS cache_only,
  count(*) FILTER (WHERE k = 2) AS created, count(*) FILTER (WHERE k = 3) AS updated, count(*) FILTER (WHERE k = 4) AS unchanged, count(*) FILTER (WHERE k = 6) AS errors FROM (SELECT event_id % 7 AS k FROM events)
""")
def enrichment_summary(spark, sf_dir):
    names = ("SKIPPED_FRESH_CACHE", "SKIPPED_CACHE_ONLY", "CREATED", "UPDATED", "UNCHANGED", "SESSION_EXPIRED", "TRANSPORT_ERROR")
    return views.enrichment_summary(table(spark, sf_dir, "events").select(F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 7).cast("int")).alias("status")))


_CODES_SQL = "p AS (SELECT p_partkey AS company_id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '12' ELSE lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS a, [lpad(CAST(p_size AS VARCHAR), 7, '0'), lpad(CAST(p_partkey AS VARCHAR), 7, '0'), ' '] AS b FROM part)"


def _coded(spark, sf_dir):
    k = F.col("p_partkey")
    own = F.lpad(k.cast("string"), 7, "0")
    return table(spark, sf_dir, "part").select(k.alias("company_id"), F.when(k % 4 == 1, "12").when(k % 4 > 1, own).alias("cnae_principal"), F.array(F.lpad(F.col("p_size").cast("string"), 7, "0"), own, F.lit(" ")).alias("cnaes_secundarios"))


@query("WITH " + _CODES_SQL + " SELECT count(*) AS companies, CAST(sum(2 + CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS cnaes_received, count(*) FILTER (WHERE a = '12') AS cnaes_invalid, count(*) FILTER (WHERE company_id % 3 = 0) AS created, count(*) FILTER (WHERE company_id % 3 = 1) AS updated, 0 AS reactivated, 0 AS deactivated, count(*) FILTER (WHERE company_id % 3 = 2) AS unchanged, CAST(sum(2 + CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) - count(*) FILTER (WHERE a = '12') AS cnaes_valid FROM p")
def catalog_summary(spark, sf_dir):
    op = F.get(F.array(*map(F.lit, ("CREATED", "UPDATED", "UNCHANGED"))), (F.col("p_partkey") % 3).cast("int"))
    return views.catalog_summary(_coded(spark, sf_dir), table(spark, sf_dir, "part").select(op.alias("op")))


@query("WITH " + _CODES_SQL + ", e AS (SELECT company_id, a AS cnae, 1 AS pr FROM p UNION ALL SELECT company_id, unnest(b), 0 FROM p), g AS (SELECT company_id, cnae, max(pr) = 1 AS is_primary FROM e WHERE regexp_matches(coalesce(cnae, ''), '^[0-9]{7}$') GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY is_primary DESC, cnae) AS INTEGER) AS position FROM g")
def company_cnaes(spark, sf_dir):
    return ordering.normalize_company_cnaes(_coded(spark, sf_dir))


_KINDS = ("Comércio varejista", "Fabricação de peças", "Serviços médicos: medicina", "Corretagem imobiliária", "Templo", "Outro")


@query("""
WITH d AS (SELECT p_partkey AS k, unnest(CASE p_partkey % 6 WHEN 0 THEN ['COMERCIO'] WHEN 1 THEN ['INDUSTRIA'] WHEN 2 THEN ['SERVICOS', 'SERVICOS_MEDICOS_ODONTOLOGICOS'] WHEN 3 THEN ['SERVICOS_IMOBILIARIOS'] WHEN 4 THEN ['TEMPLO_RELIGIOSO'] ELSE [] END) AS activity_type FROM part),
w AS (SELECT DISTINCT l_suppkey AS company_id, activity_type FROM lineitem JOIN d ON l_partkey = k WHERE l_quantity > 20)
SELECT activity_type, CASE WHEN company_id % 4 = 0 AND activity_type = 'COMERCIO' THEN 'UNCHANGED' ELSE 'CREATED' END AS op, count(*) AS n FROM w GROUP BY ALL
""")
def activity_types(spark, sf_dir):
    """Activity classes of suppliers by the parts that they deliver, merged into those that some have."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("cnae"), (F.col("l_quantity") > 20).alias("active"))
    cache = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cnae"), F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 6).cast("int")).alias("description"))
    have = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("company_id"), F.lit("COMERCIO").alias("activity_type"), F.lit("DESCRIPTION").alias("source"), F.lit(0.9).alias("confidence"))
    ops = merge.merge_activity_types(views.company_activity_types(li, cache), have, "DESCRIPTION", 0.9)[1]
    return ops.groupBy("activity_type", "op").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AS active FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS renamed FROM customer WHERE c_custkey % 5 <> 0)
SELECT CASE WHEN t.k IS NULL THEN 'CREATED' WHEN renamed OR NOT active THEN 'UPDATED' ELSE 'UNCHANGED' END AS op, count(*) AS n FROM b LEFT JOIN t USING (k) GROUP BY 1
""")
def upsert_registry(spark, sf_dir):
    """Customers against a registry that has half of them, some deleted."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.lit(1).cast("long").alias("organization_id"), F.lpad(k.cast("string"), 14, "0").alias("cnpj"), F.col("c_name").alias("razao_social"))
    gone = k % 3 == 0
    target = c.where(k % 2 == 0).select(
        "organization_id", "cnpj", "razao_social", (~gone).alias("active"), F.when(gone, _then()).alias("deleted_at"), F.when(gone, merge.DELETED).otherwise(merge.SYNCED).alias("sync_status"), _then().alias("first_seen_at"), _then().alias("last_seen_at")
    )
    batch = c.where(k % 5 != 0).withColumn("razao_social", F.when(k % 7 == 0, F.concat("razao_social", F.lit(" new"))).otherwise(F.col("razao_social")))
    return merge.merge_counts(merge.upsert_registry(target, batch, ["razao_social"], _now())[1])


@query("""
WITH t AS (SELECT c_custkey AS k, c_custkey % 5 AS m, c_acctbal > 0 AS active, CASE WHEN c_acctbal <= 0 AND c_custkey % 2 = 0 THEN 'DELETED_IN_SOURCE' ELSE 'SYNCED' END AS state FROM customer),
h AS (SELECT *, m < 4 AND NOT (m = 1 AND k % 7 = 0) AS hit FROM t)
SELECT 'operation' AS kind, CAST(m AS INT) AS m, CASE WHEN NOT hit THEN 'NOT_FOUND' WHEN NOT active AND state = 'DELETED_IN_SOURCE' THEN 'ALREADY_DELETED' ELSE 'DELETED' END AS op, count(*) AS n FROM h WHERE m < 4 GROUP BY ALL
UNION ALL SELECT 'state', CAST(m AS INT), CASE WHEN hit THEN 'DELETED_IN_SOURCE' WHEN active THEN state || ' active' ELSE state END, count(*) FROM h GROUP BY ALL
""")
def delete_registry(spark, sf_dir):
    """Deletions by cnpj (0), by external id (1; every seventh is unknown), by cnpj with the id of another company (2), by an unknown cnpj with an id (3)."""
    k = F.col("c_custkey")
    m, none = k % 5, F.lit(None).cast("string")
    cnpj, own_id = lambda c: F.lpad(c.cast("string"), 14, "0"), lambda c: F.concat(F.lit("e"), c.cast("string"))
    c = table(spark, sf_dir, "customer")
    state = F.when((F.col("c_acctbal") <= 0) & (k % 2 == 0), merge.DELETED).otherwise(merge.SYNCED)
    target = c.select(F.lit(1).alias("organization_id"), cnpj(k).alias("cnpj"), own_id(k).alias("external_id"), (F.col("c_acctbal") > 0).alias("active"), F.lit(None).cast("timestamp").alias("deleted_at"), state.alias("sync_status"))
    events = c.where("c_custkey % 5 < 4").select(
        F.lit(1).alias("organization_id"), F.when(m.isin(0, 2), cnpj(k)).when(m == 3, cnpj(k + 900_000_000_000)).otherwise(none).alias("cnpj"),
        F.when(m == 1, F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(own_id(k))).when(m == 2, own_id(k + 2)).when(m == 3, own_id(k)).alias("external_id"), _then().alias("deleted_at"),
    )
    after, ops = merge.delete_registry(target, events, _now())
    of = F.coalesce((F.col("cnpj").cast("long") % 5).cast("int"), F.lit(1)).alias("m")
    count = F.count(F.lit(1)).alias("n")
    shown = F.when(F.col("active"), F.concat("sync_status", F.lit(" active"))).otherwise(F.col("sync_status"))
    return ops.groupBy(F.lit("operation").alias("kind"), of, "op").agg(count).unionByName(after.groupBy(F.lit("state").alias("kind"), of, shown.alias("op")).agg(count))


@query("""
WITH x AS (SELECT c_custkey AS k, c_custkey % 2 AS a, c_custkey % 3 % 2 AS b FROM customer WHERE c_custkey % 5 <> 0)
SELECT CASE WHEN k % 7 = 0 THEN 'REOPENED' WHEN k % 7 = 1 THEN 'UPDATED' ELSE 'CREATED' END AS op, 'Regime diverge: ' || ['MEI', 'LUCRO_REAL'][1 + a] || ' vs ' || ['MEI', 'LUCRO_REAL'][1 + b] || '.' AS message, 'OPEN' AS status, count(*) AS n FROM x WHERE a <> b GROUP BY ALL
""")
def merge_regime_alerts(spark, sf_dir):
    """Regimes of customers in two sources; some have an alert, open or closed, already."""
    k = F.col("c_custkey")
    side = lambda x: F.when(x == 0, "6").otherwise("Lucro Real")
    c = table(spark, sf_dir, "customer").where(k % 5 != 0).select(F.lit(1).alias("organization_id"), k.alias("company_id"), R.resolve_regime(side(k % 2))["canonical"].alias("l"), R.resolve_regime(side(k % 3 % 2))["canonical"].alias("r"))
    conflicts = match.find_conflicts(c.select("organization_id", "company_id", F.col("l").alias("v")), c.select("organization_id", "company_id", F.col("r").alias("v")), ["organization_id", "company_id"], "v")
    old = table(spark, sf_dir, "customer").where(k % 7 < 2).select(
        F.lit(1).alias("organization_id"), k.alias("company_id"), F.lit(merge.REGIME_ALERT["code"]).alias("code"), F.lit("t").alias("title"), F.lit("LOW").alias("severity"), F.lit("DP").alias("department"), F.lit("old").alias("message"),
        F.lit("x").alias("source"), F.when(k % 7 == 0, "CLOSED").otherwise("OPEN").alias("status"), _then().alias("first_seen_at"), _then().alias("last_seen_at"),
    )
    after, ops = merge.merge_regime_alerts(conflicts, old, "FEED", _now())
    return ops.join(after.select("company_id", "message", "status"), "company_id").groupBy("op", "message", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT DISTINCT p_brand AS code, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS regime, p_size % 3 AS v FROM part WHERE p_size <= 40),
t AS (SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_partkey, p_brand AS code, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS regime, CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_size % 3 END AS v, p_partkey % 4 <> 0 AS active, p_partkey AS pid FROM part WHERE p_partkey % 50 < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY code, regime ORDER BY pid) AS nth FROM t),
o AS (SELECT CASE WHEN r.pid IS NULL THEN 'CREATED' WHEN s.code IS NULL OR nth > 1 THEN 'DELETED' WHEN r.v = s.v AND active THEN 'UNCHANGED' ELSE 'UPDATED' END AS op FROM r FULL JOIN s ON r.code = s.code AND r.regime IS NOT DISTINCT FROM s.regime)
SELECT op, count(*) AS n FROM o GROUP BY 1
""")
def merge_seed(spark, sf_dir):
    """Brands and sizes as rules that data define, merged into a table with repeated, stale and inactive rows; null keys are equal."""
    m = F.col("p_size") % 3
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("code"), F.when(m > 0, m).alias("regime"), m.alias("v"))
    seed = p.where("p_size <= 40").select("code", "regime", "v").distinct()
    target = p.where("p_partkey % 50 < 2").select(F.col("p_partkey").alias("seed_id"), "code", "regime", F.when(F.col("p_partkey") % 9 == 0, -1).otherwise(F.col("v")).alias("v"), (F.col("p_partkey") % 4 != 0).alias("active"))
    return merge.merge_counts(merge.merge_seed(target, seed, ["code", "regime"], ["v"], _now(), delete_rest=True)[1])


@query("""
WITH y AS (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y') AS INT) AS y FROM orders), m AS (SELECT y, unnest(generate_series(1, 12)) AS m FROM y), p AS (SELECT y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS competencia FROM m)
SELECT competencia, CASE WHEN competencia IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderkey % 500 = 0) THEN 'UNCHANGED' ELSE 'CREATED' END AS op FROM p
""")
def seed_periods(spark, sf_dir):
    """The months of all years with orders, against those that a few orders have."""
    o = table(spark, sf_dir, "orders")
    years = o.select(F.year("o_orderdate").alias("year")).distinct()
    have = o.where("o_orderkey % 500 = 0").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.date_format("o_orderdate", "yyyy-MM").alias("competencia")).distinct()
    have = have.select(F.lit(1).cast("long").alias("seed_id"), "year", "month", "competencia", F.lit("OPEN").alias("status"), F.lit(True).alias("active"))
    return catalogs.seed_periods(have, years, _now())[1]


@query("""
WITH c AS (SELECT c_custkey, ['SIMPLES_NACIONAL', 'MEI', 'LUCRO_REAL', 'LUCRO_PRESUMIDO'][1 + c_custkey % 4] AS regime FROM customer)
SELECT regime, count(*) * CASE regime WHEN 'SIMPLES_NACIONAL' THEN 9 WHEN 'MEI' THEN 8 ELSE 10 END AS n, CASE regime WHEN 'SIMPLES_NACIONAL' THEN 9 WHEN 'MEI' THEN 8 ELSE 10 END AS codes FROM c GROUP BY 1
""")
def applicable_rules(spark, sf_dir):
    """Customers with the rules of their regime: seven rules name none, and count for each."""
    regime = F.get(F.array(*map(F.lit, ("SIMPLES_NACIONAL", "MEI", "LUCRO_REAL", "LUCRO_PRESUMIDO"))), (F.col("c_custkey") % 4).cast("int"))
    both = R.applicable_rules(table(spark, sf_dir, "customer").select("c_custkey", regime.alias("regime")), catalogs.obligation_rules(spark))
    return both.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").cast("int").alias("codes"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'INSERT' ELSE 'DELETE' END AS op FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 IN (2, 4, 3))")
def set_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return match.set_diff(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("""
WITH s AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS due FROM orders)
SELECT 'due' AS kind, o_orderkey AS id FROM (SELECT * FROM s ORDER BY due NULLS LAST, o_orderkey LIMIT 20) UNION ALL SELECT 'newest', o_orderkey FROM (SELECT * FROM s ORDER BY due DESC NULLS LAST, o_orderkey DESC LIMIT 20)
UNION ALL SELECT 'period', CAST(p AS BIGINT) FROM (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m') AS INT) AS p FROM orders ORDER BY p DESC LIMIT 20)
UNION ALL SELECT 'cnae', p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey % 2 = 0 DESC, p_size > 25 DESC, lpad(CAST(p_partkey AS VARCHAR), 7, '0') LIMIT 20)
""")
def sorted_lists(spark, sf_dir):
    """The first twenty of lists in the orders that the views use."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("due"))
    months = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("active"), (F.col("p_size") > 25).alias("is_primary"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("cnae"))
    first = lambda df, kind, c: ordering.limit_capped(df, 20).select(F.lit(kind).alias("kind"), c.cast("long").alias("id"))
    return (
        first(ordering.sort_due(o, "due", "o_orderkey"), "due", F.col("o_orderkey"))
        .unionByName(first(ordering.sort_newest(o, "due", "o_orderkey"), "newest", F.col("o_orderkey")))
        .unionByName(first(ordering.sort_periods(months), "period", F.col("year") * 100 + F.col("month")))
        .unionByName(first(ordering.sort_cnaes(p), "cnae", F.col("p_partkey")))
    )


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 6 < 3 THEN 'DELETE' ELSE 'UPSERT' END AS kind, user_id % 3 = 0 AS old FROM events),
m AS (SELECT approx_ts AS t FROM (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS approx_ts FROM events)),
f AS (SELECT user_id, arg_min({'ts': ts, 'id': event_id}, {'ts': ts, 'id': event_id}) AS born FROM e WHERE kind = 'UPSERT' GROUP BY 1),
x AS (SELECT e.*, kind = 'UPSERT' OR old OR coalesce(f.born < {'ts': ts, 'id': event_id}, false) AS found, NOT old OR ts > t AS fresh FROM e LEFT JOIN f USING (user_id), m),
l AS (SELECT user_id, bool_or(old) AS old, arg_max(kind, {'ts': ts, 'id': event_id}) FILTER (fresh) AS kind FROM x WHERE found GROUP BY 1)
SELECT CASE WHEN kind IS NULL THEN 'STALE' WHEN kind = 'DELETE' THEN 'DELETED' WHEN old THEN 'UPDATED' ELSE 'CREATED' END AS op, count(*) AS n FROM l GROUP BY 1
UNION ALL SELECT 'NOT_FOUND', count(*) FROM x WHERE NOT found HAVING count(*) > 0
""")
def company_events(spark, sf_dir):
    """Change events of a company each user: upserts, and deletions by cnpj, by id alone, or by id with an unknown cnpj; a third of the companies is in the registry already, with half of the time seen."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    k, user = F.col("event_id") % 6, F.col("user_id").cast("string")
    at, cnpj, own_id, none = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lpad(user, 14, "0"), F.concat(F.lit("u"), user), F.lit(None).cast("string")
    raw = e.orderBy("event_id").select(
        F.when(k < 3, "company.deleted").otherwise("company.upsert").alias("event_type"), F.lit("1").alias("organization_id"), F.when(k > 0, own_id).alias("id"), F.when(k == 1, none).when(k == 2, F.lpad(user, 14, "9")).otherwise(cnpj).alias("cnpj"), F.lit("x").alias("razao_social"),
        F.when(k == 3, at).alias("updated_at"), F.when(k > 3, at).alias("updatedAt"), F.when(k == 0, at).alias("deleted_at"), F.when(k.isin(1, 2), at).alias("deletedAt"),
    )
    half = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("event_at"))
    target = e.where("user_id % 3 = 0").select("user_id").distinct().join(F.broadcast(half)).select(
        F.lit(1).cast("long").alias("organization_id"), cnpj.alias("cnpj"), own_id.alias("external_id"), F.lit("x").alias("razao_social"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(merge.SYNCED).alias("sync_status"), "event_at"
    )
    return merge.merge_counts(streams.apply_company_events(target, staged(streams.typed_events(raw), "events"), _now())[1])


@query("SELECT event_id, event_type FROM events WHERE value < 20 AND ts < (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE")
def stale_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("started_at"), F.when(F.col("value") < 20, "RUNNING").otherwise("SUCCESS").alias("status"))
    return streams.stale_runs(e, F.lit(e.agg(F.max("started_at")).first()[0])).select("event_id", "event_type")


@query("""
WITH r AS (SELECT ['ECONTROLE', 'SITTAX', 'ECONET'][1 + user_id % 3] AS provider, event_id, ts, value < 20 AS running, CASE WHEN value < 40 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events),
d AS (SELECT provider, status FROM r WHERE NOT running QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) = 1), l AS (SELECT provider, event_id, ts FROM r WHERE running QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) = 1),
p AS (SELECT unnest(['ECONTROLE', 'ACESSORIAS', 'SITTAX', 'DOMINIO', 'ECONET', 'WATCHER_G']) AS provider, generate_subscripts(['ECONTROLE', 'ACESSORIAS', 'SITTAX', 'DOMINIO', 'ECONET', 'WATCHER_G'], 1) - 1 AS position)
SELECT CAST(position AS INTEGER) AS position, provider, d.status AS last_status, l.event_id AS active_run, coalesce(l.ts < (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE, false) AS stale FROM p LEFT JOIN d USING (provider) LEFT JOIN l USING (provider)
""")
def provider_health(spark, sf_dir):
    """Events as runs of three of the six providers."""
    e = table(spark, sf_dir, "events")
    name = F.get(F.array(*map(F.lit, ("econtrole", "sittax", "econet"))), (F.col("user_id") % 3).cast("int"))
    status = F.when(F.col("value") < 20, "RUNNING").when(F.col("value") < 40, "FAILED").otherwise("SUCCESS")
    runs = e.select(name.alias("provider"), F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"))
    return views.provider_health(spark, runs, F.lit(e.agg(F.max("ts")).first()[0])).select("position", "provider", "last_status", "active_run", "stale")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a b' ELSE p_name END AS trimmed, CASE WHEN p_partkey % 4 = 1 THEN 'a b' WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS collapsed, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a b' ELSE coalesce(nullif(regexp_replace(p_name, '[^0-9]', '', 'g'), ''), p_name) END AS identifier,
  CASE WHEN p_partkey >= 10 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS cnae, CASE WHEN p_partkey >= 10 THEN substr(lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 1, 4) || '-' || substr(lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 5, 1) || '/' || substr(lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 6, 2) END AS formatted,
  p_partkey < 10 AS bad_cnae, CASE WHEN p_partkey < 10 THEN 'cnae' END AS cnae_error, upper(substr(p_brand, 1, 2)) AS uf, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS number, p_partkey % 3 = 1 AS bad_number, CASE WHEN p_partkey % 2 = 0 THEN '.pdf' ELSE '.xml' END AS extension,
  CASE p_partkey % 3 WHEN 0 THEN 'HOMOLOGADA' WHEN 1 THEN 'NAO_HOMOLOGADA' END AS homologation, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS transmitted, CASE p_partkey % 3 WHEN 0 THEN 'HOURS' WHEN 1 THEN 'DECIMAL' ELSE 'UNKNOWN' END AS informed,
  'Nota de ' || upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS title FROM part
""")
def scalar_forms(spark, sf_dir):
    """Parts with blanks, codes, numbers and labels in raw forms, normalised."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 4 == 0, " \t ").when(k % 4 == 1, " a b\n").otherwise(name)
    code = F.when(k < 10, "12").otherwise(F.lpad(k.cast("string"), 7, "0"))
    number = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(k % 3 == 1, "x")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", raw.alias("raw"), code.alias("code"), number.alias("number"), "p_brand", F.when(k % 2 == 0, " .PDF ").alias("ext"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("flag"), F.when(k % 3 == 0, "2026-01-01").alias("sent"),
        F.when(k % 3 == 1, " nao_transmitida").alias("kind"), F.when(k % 3 == 0, "10:30").when(k % 3 == 1, "1.234,50").otherwise("n/a").alias("informed"),
    )
    return p.select(
        "p_partkey", N.trim_to_null("raw").alias("trimmed"), N.collapse_ws("raw").alias("collapsed"), N.normalize_identifier("raw").alias("identifier"), N.normalize_cnae("code").alias("cnae"), N.format_cnae("code").alias("formatted"), N.is_bad_cnae("code").alias("bad_cnae"),
        N.normalize_cnae_optional("code")["error"].alias("cnae_error"), N.normalize_uf("p_brand").alias("uf"), N.parse_int("number").alias("number"), N.is_bad_int("number").alias("bad_number"), N.file_extension("ext", F.lit("file.a.xml")).alias("extension"),
        N.homologation_status("flag").alias("homologation"), N.is_transmitted("sent", "kind").alias("transmitted"), N.parse_informed("informed")["kind"].alias("informed"), N.display_title(F.concat(F.lit("nota_DE_"), F.col("p_brand"))).alias("title"),
    )


@query("""
SELECT o_orderkey, CASE WHEN k > 1 THEN CAST(o_orderdate AS DATE) END AS day, k = 1 AS bad_day, CASE WHEN k > 1 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') || ' 10:00:00.123456' END AS stamp, CASE WHEN k > 1 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') || ' 07:00:00.5' END AS fraction,
  CASE WHEN k > 0 THEN 'x' END AS sentinel, CAST(o_orderdate AS DATE) AS br, strftime(o_orderdate, '%Y-%m') AS period, true AS is_period, strftime(o_orderdate, '%m/%Y') AS shown FROM (SELECT *, o_orderkey % 4 AS k FROM orders)
""")
def date_forms(spark, sf_dir):
    """Order dates in raw forms: zero dates, no dates, times with long fractions and zones, Brazilian dates."""
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 0, "0000-00-00").when(k == 1, "soon").otherwise(F.concat(day, F.lit("T10:00:00.123456789Z")))
    iso = F.when(k == 0, "").when(k == 1, "n/a").otherwise(F.concat(day, F.lit("T10:00:00.5000000+03:00")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), iso.alias("iso"), F.when(k == 0, "0001-01-01T00:00:00").otherwise("x").alias("s"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("br"), F.date_format("o_orderdate", "MM/yyyy").alias("m"))
    shown = lambda c, f: F.date_format(c, f)
    return o.select(
        "o_orderkey", N.parse_date("text").alias("day"), N.is_bad_date("text").alias("bad_day"), shown(N.parse_datetime("text"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"), shown(N.parse_iso_fraction("iso"), "yyyy-MM-dd HH:mm:ss.S").alias("fraction"),
        N.null_sentinel_dt("s").alias("sentinel"), N.parse_br_date("br").alias("br"), N.period_reference("m").alias("period"), N.is_period(N.period_reference("m")).alias("is_period"), N.display_period(N.period_reference("m")).alias("shown"),
    )


@query("""
SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'READ' WHEN 1 THEN 'UNREAD' WHEN 2 THEN 'Outra' END AS guide, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS penalty, CASE user_id % 4 WHEN 0 THEN 'LUCRO_REAL' WHEN 1 THEN 'MEI' END AS regime, CASE user_id % 4 WHEN 0 THEN 'MAPPED' WHEN 1 THEN 'MAPPED' WHEN 2 THEN 'UNMAPPED' ELSE 'MISSING' END AS regime_status,
  '***' AS secret, CAST(user_id AS VARCHAR) AS open, 1 AS entries, '{"a":' || user_id || '}' AS nested, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events
""")
def label_forms(spark, sf_dir):
    """Events with labels of guides, penalties and regimes, maps with secrets, errors with diagnostics, and JSON in JSON."""
    k, user = F.col("user_id") % 4, F.col("user_id").cast("string")
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).when(k == 2, c)
    payload = F.when(k == 0, '{"taxRegime": "Lucro Real"}').when(k == 1, '{"regime": "6", "taxRegime": "x"}').when(k == 2, '{"regime": "?"}').otherwise("{}")
    e = dealt(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id").select(
        "event_id", "event_type", "user_id", pick("Guia já acessada/lida", "não", "Outra").alias("guide"), pick("s", "N", " ").alias("fine"), payload.alias("payload"), F.create_map(F.lit("Senha"), user, F.lit("other"), user).alias("m"),
        F.array(F.create_map(F.lit("contract"), user, F.lit("code"), user)).alias("errors"), F.to_json(F.struct(F.concat(F.lit('{"a":'), user, F.lit("}")).alias("x"))).alias("outer"),
    )
    e, regime = e.withColumn("regime_", R.resolve_registry_regime("payload")), F.col("regime_")
    inner = F.regexp_replace(F.regexp_extract("outer", r'^\{"x":(.*)\}$', 1), "^$", "")
    return e.select(
        "event_id", R.guide_read_status("guide").alias("guide"), R.has_penalty("fine").alias("penalty"), regime["canonical"].alias("regime"), regime["mapping_status"].alias("regime_status"), N.redact_map("m", ["senha"])["Senha"].alias("secret"), N.redact_map("m", ["senha"])["other"].alias("open"),
        F.size(F.get(quality.strip_diagnostics("errors"), F.lit(0))).alias("entries"), N.parse_maybe_nested_json(inner).alias("nested"), N.content_hash("user_id", "event_type").alias("digest"),
    )


@query("""
WITH o AS (SELECT DISTINCT o_orderkey, 'Resumo_' || strftime(o_orderdate, '%m-%Y') || '_' || o_custkey || '.pdf' AS file, strftime(o_orderdate, '%Y-%m') AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT file, count(*) AS n_pages, count(*) AS n_companies, m AS payrolls, count(*) AS payroll, 0 AS employee, CASE WHEN count(*) FILTER (WHERE o_orderkey % 7 = 0) > 0 THEN 'NET_TOTAL_MISSING=' || count(*) FILTER (WHERE o_orderkey % 7 = 0) ELSE '' END AS company_codes FROM o GROUP BY file, m
""")
def report_summary(spark, sf_dir):
    out = payroll.parse_report(report_pages(spark, sf_dir))
    found = views.report_summary(out["reports"], out["companies"], out["warnings"])
    codes = F.array_join(F.transform(F.map_entries("company_warning_codes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("file", "n_pages", "n_companies", F.array_join("payrolls", ",").alias("payrolls"), "payroll", F.col("employee").cast("int").alias("employee"), codes.alias("company_codes"))


@query("""
SELECT 'rubric ' || CASE WHEN l_returnflag = 'R' THEN 'INFORMATIONAL' ELSE 'EARNINGS' END AS kind, count(*) AS n, CAST(sum(630) AS BIGINT) AS minutes, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1
UNION ALL SELECT 'section ' || f, count(*), 0, CAST(sum(v) AS BIGINT) FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'INFORMATIONAL' ELSE 'EARNINGS' END AS f, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v FROM lineitem GROUP BY ALL) GROUP BY f
UNION ALL SELECT 'block MONTHLY_PAYROLL', count(DISTINCT l_orderkey), 0, 0 FROM lineitem UNION ALL SELECT 'warning NET_TOTAL_MISSING', count(DISTINCT l_orderkey), 0, 0 FROM lineitem WHERE l_orderkey % 7 = 0
""")
def payroll_frames(spark, sf_dir):
    """Numbers and sums of the rubrics, sections, blocks and warnings of all report pages."""
    out = payroll.parse_report(report_pages(spark, sf_dir))
    cents = lambda c: F.sum((F.col(c) * 100).cast("long")).alias("cents")
    n, none = F.count(F.lit(1)).alias("n"), F.lit(0).cast("long")
    named = lambda prefix, c: F.concat(F.lit(prefix + " "), c).alias("kind")
    return (
        out["rubrics"].groupBy(named("rubric", F.col("section"))).agg(n, F.sum("minutes").alias("minutes"), cents("calculated"))
        .unionByName(out["sections"].where("size(warnings) = 0").groupBy(named("section", F.col("section"))).agg(n, none.alias("minutes"), cents("declared")))
        .unionByName(out["blocks"].groupBy(named("block", F.col("block_type"))).agg(n, none.alias("minutes"), none.alias("cents")))
        .unionByName(out["warnings"].groupBy(named("warning", F.col("code"))).agg(n, none.alias("minutes"), none.alias("cents")))
    )


@query("""
WITH p AS (SELECT *, p_partkey % 4 AS k, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS c FROM part)
SELECT p_partkey, c AS cnae, 'Comércio de ' || p_name AS description, ['COMERCIO'] AS activity_types, 'PARSED' AS parse_status, CASE k WHEN 0 THEN 'ALLOWED' WHEN 1 THEN 'PROHIBITED' ELSE 'UNKNOWN' END AS presumed_status, CASE WHEN k < 2 THEN 8.0 END AS irpj_rate,
  CASE k WHEN 0 THEN 'MANDATORY' WHEN 1 THEN 'NOT_MANDATORY' WHEN 2 THEN 'ALLOWED' ELSE 'UNKNOWN' END AS actual_profit_status, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS actual_profit_mandatory,
  CASE k WHEN 0 THEN 'ALLOWED' WHEN 1 THEN 'NOT_ALLOWED' END AS mei_status, CASE WHEN k = 0 THEN p_name END AS occupation, CASE WHEN k = 3 THEN [p_type] ELSE [] END AS unmapped_obligations, CASE WHEN k = 2 THEN 'EMPTY' ELSE 'PARSED' END AS general_status,
  2 AS hits, CAST(p_partkey AS VARCHAR) AS activity_id, ['PJ em Geral', 'Optante SIMEI'] AS groups FROM p
""")
def rule_records(spark, sf_dir):
    """Parts written as rule pages of all kinds, and read back as one record each, with the hits of a search page and the tabs."""
    k, name, code = F.col("p_partkey") % 4, F.col("p_name"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    shown = F.regexp_replace(code, r"^(\d{4})(\d)(\d{2})$", "$1-$2/$3")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    hit = lambda i: F.concat(F.lit('<tr><td><input name="idcnae" value="'), F.col("p_partkey").cast("string"), F.lit(f'{i}"/>'), shown, F.lit("</td>"), cell(name), F.lit("</tr>"))
    owed = F.when(k == 3, F.concat(F.lit("<tr>"), cell(F.col("p_type")), cell(F.lit("-")), F.lit("</tr>"))).when(k == 2, F.lit("")).otherwise(F.lit("<tr><td>EFD-Reinf</td><td>-</td></tr>"))
    kinds = {
        "detail": F.concat(F.lit('<div data-econet-id="'), F.col("p_partkey").cast("string"), F.lit('">CNAE: '), shown, F.lit(" Descricao: Com&eacute;rcio de "), name, F.lit("</div>")),
        "presumed": F.concat(F.lit("<p>Lucro Presumido: "), F.when(k == 0, "permitida").when(k == 1, "impedida").otherwise("nada"), F.when(k < 2, ". IRPJ: 8,00%").otherwise("."), F.lit("</p>")),
        "actual_quarter": F.concat(F.lit("Lucro Real: "), F.when(k == 0, "obrigatoria").when(k == 1, "nao obrigatoria").when(k == 2, "possibilidade").otherwise("sem inferencia automatica")),
        "actual_estimate": F.lit("Lucro Real: sem inferencia automatica"),
        "mei": F.when(k == 0, F.concat(F.lit("MEI: possivel o enquadramento. Ocupacao correspondente: "), name, F.lit("."))).when(k == 1, "MEI: nao e possivel o enquadramento como Microempreendedor Individual"),
        "obligations_general": F.concat(F.lit('PJ em Geral<table class="tabelaResultados"><tr><td>Obrigacao</td><td>x</td></tr>'), owed, F.lit("</table>")),
        "search": F.concat(F.lit('<table class="tabela-busca"><tr><td>CNAE</td><td>Descricao</td></tr>'), hit(0), hit(1), F.lit("</table>")),
        "tabs": F.lit('PJ em Geral<b class="grupo-obrigacoes">PJ em Geral</b><b class="grupo-obrigacoes">Optante SIMEI</b>'),
    }
    pages = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), html.alias("html")) for kind, html in kinds.items()]))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_key"), pages.alias("x")).where("x.html IS NOT NULL").select("page_key", "x.kind", "x.html")
    texts = staged(rule_pages.page_texts(p), "rule-texts")
    rules = rule_pages.attach_activity(rule_pages.normalized_rules(texts))
    hits = rule_pages.search_results(texts).where("size(errors) = 0").groupBy("page_key").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    out = rules.hint("merge").join(hits.hint("merge"), "page_key").join(rule_pages.obligation_tabs(texts).select("page_key", "groups").hint("merge"), "page_key")
    return out.select(
        F.col("page_key").alias("p_partkey"), "cnae", "description", "activity_types", "parse_status", F.col("presumed_profit.status").alias("presumed_status"), F.col("presumed_profit.irpj_rate").cast("double").alias("irpj_rate"), "actual_profit_status", "actual_profit_mandatory",
        F.col("mei.status").alias("mei_status"), F.col("mei.occupation").alias("occupation"), "unmapped_obligations", F.col("obligations_general.status").alias("general_status"), "hits", "activity_id", "groups",
    )


@query("""
WITH e AS (SELECT o_orderpriority AS grp, strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN count(*) % 7 = 0 THEN 'FAILED' WHEN count(*) % 5 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, count(*) FILTER (WHERE o_orderstatus = 'P') AS failures FROM orders GROUP BY ALL),
m AS (SELECT 'on' AS mode, * FROM e UNION ALL SELECT 'stop', * FROM e
  WHERE period <= coalesce((SELECT min(period) FROM e AS x WHERE x.grp = e.grp AND x.status <> 'SUCCESS'), '9999'))
SELECT mode, grp, count(*) AS periods_processed, count(*) FILTER (WHERE status = 'SUCCESS') AS periods_success, count(*) FILTER (WHERE status = 'PARTIAL') AS periods_partial, count(*) FILTER (WHERE status = 'FAILED') AS periods_failed,
  CAST(sum(failures) AS BIGINT) AS failures, max(period) AS last_period,
  CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 AND count(*) FILTER (WHERE status <> 'FAILED') = 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE status <> 'SUCCESS') > 0 OR sum(failures) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM m GROUP BY ALL
""")
def range_status(spark, sf_dir):
    """Months of orders as periods of a range each priority, some of which failed or did so partly; run to the end, or stopped at the first of them."""
    n = F.count(F.lit(1))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(
        F.when(n % 7 == 0, "FAILED").when(n % 5 == 0, "PARTIAL").otherwise("SUCCESS").alias("status"), F.count_if(F.col("o_orderstatus") == "P").alias("failures")
    )
    of = lambda mode: views.range_status(o, "grp", stop_on_error=mode == "stop").select(F.lit(mode).alias("mode"), "*")
    return of("on").unionByName(of("stop"))


@query("""
WITH s AS (SELECT o_custkey % 3 AS company_id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ENTREGUE' ELSE 'PENDENTE' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS due FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY due NULLS LAST, o_orderkey) AS nth FROM s)
SELECT company_id, count(*) AS obligations_total, count(*) FILTER (WHERE status = 'ENTREGUE') AS delivered_total, count(*) FILTER (WHERE status <> 'ENTREGUE') AS pending_total, string_agg('OBR-' || o_orderkey || ':' || status, ',' ORDER BY nth) FILTER (WHERE nth <= 5) AS shown,
  count(*) AS divergences_preview, CAST(0 AS BIGINT) AS evidences_preview FROM t GROUP BY 1
""")
def company_previews(spark, sf_dir):
    """All orders as obligations of three companies, of which the summary shows the first five each."""
    o, company = table(spark, sf_dir, "orders"), (F.col("o_custkey") % 3).alias("company_id")
    s = o.select(
        company, F.col("o_orderkey").alias("status_id"), F.col("o_orderkey").alias("obligation_id"), F.when(F.col("o_orderstatus") == "F", "ENTREGUE").otherwise("PENDENTE").alias("status"), F.lit("FISCAL").alias("department"),
        F.lit("API").alias("source"), F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("due_date"), F.lit(None).cast("timestamp").alias("delivered_at"),
    )
    none = F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("company_id")).distinct().select(F.lit(1).alias("organization_id"), "company_id", none.alias("name"), F.lit(True).alias("active"), none.alias("state_registration"), none.alias("city"), none.alias("state"))
    b = o.limit(0).select(F.col("o_orderkey").alias("obligation_id"), none.alias("code"), none.alias("name"))
    snap = s.limit(0).select("company_id", _then().alias("updated_at"), F.col("company_id").alias("snapshot_id"), none.alias("regime_canonical"), none.alias("regime_mapping_status"))
    out = views.company_summary(c, s, b, s.select("company_id"), s.limit(0).select("company_id"), s.limit(0).select("company_id"), snap, shown=5)
    shown = F.array_join(F.transform("obligations", lambda x: F.concat_ws(":", x["code"], x["status"])), ",")
    return out.select("company_id", "obligations_total", "delivered_total", "pending_total", shown.alias("shown"), "divergences_preview", "evidences_preview")


@query("""
WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 THEN 'x' || p_partkey ELSE lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS raw FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50),
t AS (SELECT row_number() OVER (ORDER BY r DESC, k) AS position, c AS cnae, k FROM (SELECT CASE WHEN starts_with(raw, 'x') THEN substr(raw, 2) ELSE raw END AS c, p_partkey AS k, (SELECT p_retailprice FROM part q WHERE q.p_partkey = w.p_partkey) AS r FROM w)),
s AS (SELECT *, length(cnae) = 7 AS valid, k % 10 = 0 AS fresh, CASE WHEN k % 10 = 1 THEN 'TRANSPORT' WHEN k % 10 = 2 THEN 'NOT_FOUND' WHEN k % 10 = 3 THEN 'AMBIGUOUS' WHEN k % 50 = 4 THEN 'SESSION' ELSE 'FOUND' END AS outcome FROM t),
f AS (SELECT *, coalesce(max(CASE WHEN valid AND NOT fresh AND outcome = 'SESSION' THEN 1 END) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM s),
i AS (SELECT position, cnae, CASE WHEN NOT valid THEN 'INVALID_CNAE' WHEN fresh THEN 'SKIPPED_FRESH_CACHE' WHEN stopped THEN 'SESSION_EXPIRED' WHEN outcome = 'SESSION' THEN 'SESSION_NOT_VALID' WHEN outcome = 'TRANSPORT' THEN 'TRANSPORT_ERROR' WHEN outcome = 'NOT_FOUND' THEN 'CNAE_NOT_FOUND'
  WHEN outcome = 'AMBIGUOUS' THEN 'AMBIGUOUS_CNAE_RESULT' WHEN k % 10 = 5 THEN 'PARSE_ERROR' WHEN k % 10 = 6 THEN 'CREATED' WHEN k % 10 = 8 THEN 'UPDATED' ELSE 'UNCHANGED' END AS status FROM f)
SELECT CAST(position AS BIGINT) AS position, cnae, status, CASE WHEN (SELECT count(*) FROM i WHERE status IN ('SESSION_NOT_VALID', 'SESSION_EXPIRED', 'TRANSPORT_ERROR')) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS run_status,
  (SELECT count(*) FROM i WHERE status IN ('INVALID_CNAE', 'TRANSPORT_ERROR', 'SESSION_NOT_VALID')) AS errors FROM i
""")
def enrichment_items(spark, sf_dir):
    """A classification run over parts as codes, dearest first: of the cache some are fresh; of the searches some fail, and one with its session, after which none is made."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k"), "p_retailprice")
    k = F.col("k")
    code = F.lpad(k.cast("string"), 7, "0")
    wanted = p.select(F.when(k % 10 == 7, F.concat(F.lit("x"), k.cast("string"))).otherwise(code).alias("cnae"), F.struct((-F.col("p_retailprice")).alias("price"), "k").alias("place"))
    cache = p.where("k % 10 NOT IN (1, 6)").select(code.alias("cnae"), F.when(k % 10 == 8, "old").otherwise("h").alias("content_hash"), F.lit("PARSED").alias("parse_status"), F.lit("v").alias("parser_version"), F.when(k % 10 == 0, _now() + F.expr("interval 1 day")).otherwise(_then()).alias("expires_at"))
    outcome = F.when(k % 10 == 1, "TRANSPORT").when(k % 10 == 2, "NOT_FOUND").when(k % 10 == 3, "AMBIGUOUS").when(k % 50 == 4, "SESSION").otherwise("FOUND")
    parsed = p.where("k % 10 <> 5").select(code.alias("cnae"), F.lit("h").alias("content_hash"))
    todo = staged(enrichment.targets(wanted, "place", 60), "targets")
    items = staged(enrichment.enrichment_items(todo, cache, p.select(code.alias("cnae"), outcome.alias("outcome")), parsed, _now(), "v"), "items")
    run = views.enrichment_summary(items).select(F.col("status").alias("run_status"), "errors")
    return items.select(F.col("position").cast("long").alias("position"), "cnae", "status").join(F.broadcast(run))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 4) THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS cnae, CASE k WHEN 0 THEN 'PARSED' ELSE 'PARSE_ERROR' END AS parse_status,
  CASE k WHEN 1 THEN ['detail:CODE_MISSING'] WHEN 2 THEN ['detail:MISSING'] WHEN 3 THEN ['detail:CAPTCHA'] WHEN 4 THEN ['mei:LOGIN'] ELSE [] END AS parse_errors, k = 0 AS hashed, CASE WHEN k <> 1 THEN 3 END AS grid, CASE WHEN k <> 1 THEN 'A|B inner||' || p_partkey END AS cells FROM p
""")
def rule_page_errors(spark, sf_dir):
    """Parts as rule pages that can't all be read, with one table whose cells span columns, hold another table and aren't closed."""
    k, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    shown = F.regexp_replace(F.lpad(key, 7, "0"), r"^(\d{4})(\d)(\d{2})$", "$1-$2/$3")
    detail = F.when(k == 1, "CNAE: unknown").when(k == 3, "CNAE: captcha").otherwise(F.concat(F.lit("<p>CNAE: "), shown, F.lit(" Descricao: x")))
    nested = F.concat(F.lit('PJ em Geral<table class="tabelaResultados"><tr><td>A<td colspan="2">B<table><tr><td>inner</table><td>'), key, F.lit("<tr><td>second<td>-</table>"))
    kinds = {"detail": F.when(k != 2, detail), "mei": F.when(k == 4, "MEI senha").otherwise("MEI"), "obligations_general": F.when(k != 1, nested)}
    pages = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), html.alias("html")) for kind, html in kinds.items()]))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_key"), pages.alias("x")).where("x.html IS NOT NULL").select("page_key", "x.kind", "x.html")
    texts = staged(rule_pages.page_texts(p), "error-pages")
    rules = rule_pages.normalized_rules(texts)
    rows = rule_pages.table_rows(texts, "tabelaResultados").where("row_no = 0").select("page_key", (F.size("cells") - 1).alias("grid"), F.array_join("cells", "|").alias("cells"))
    return rules.hint("merge").join(rows, "page_key", "left").select(F.col("page_key").alias("p_partkey"), "cnae", "parse_status", "parse_errors", F.col("content_hash").isNotNull().alias("hashed"), "grid", "cells")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS s, o_orderpriority AS clerk, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT k, 'OFFICE' AS office_name, CASE WHEN m = 0 THEN clerk ELSE 'Company ' || k END AS company_name, CASE WHEN m < 2 THEN true WHEN m = 2 THEN false END AS is_transmitted, CASE WHEN m < 2 THEN d END AS transmitted_on, s = 'P' AS transmission_in_progress, 'D' || k AS das_number,
  [cents, cents + 1, cents + 2, cents + 3, cents + 4, cents + 5, cents + 6, cents + 7] AS money, m = 1 AS taxes_icms, CASE WHEN m <> 2 THEN true END AS taxes_iss, false AS taxes_ipi, CASE m WHEN 3 THEN true END AS taxes_pis_cofins,
  2 AS companies, CASE WHEN m = 0 THEN 0 ELSE 1 END AS annexes, CASE WHEN m = 2 THEN 1 ELSE 3 END AS cfops, ['trade', 'x' || k] AS activities,
  CASE m WHEN 0 THEN ['{"a":1}', '{"b":2}'] WHEN 1 THEN ['{"empresaTemFolha":true}'] WHEN 2 THEN ['{"folhaDePagamentos":false}'] ELSE [] END AS payrolls, CASE WHEN m = 1 THEN ['late', 'again'] ELSE [] END AS alerts, CASE WHEN m = 2 THEN 1 ELSE 2 END AS risks, m = 2 AS known FROM o
""")
def assessment_fields(spark, sf_dir):
    """Orders as replies with all parts of an assessment: totals, taxes, annexes, CFOP blocks, activities, payroll lists, alerts and risks."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    cents = (F.round("o_totalprice", 2).cast("decimal(14,2)") * 100).cast("long")
    brl = lambda more: ((cents + more) / 100).cast("decimal(14,2)")
    cnpj, other = F.lpad(k.cast("string"), 14, "0"), F.lpad(F.lit("9"), 14, "1")
    thing = F.array(F.struct(F.lit(1).alias("n")))
    mine = F.struct(
        cnpj.alias("cnpj"), F.concat(F.lit("Company "), k.cast("string")).alias("nome"), F.when(m == 1, True).alias("empresaTemFolha"), (m == 1).alias("empresaTributaIcms"), F.when(m != 2, True).alias("tributaIss"), F.lit(False).alias("tributaIPI"), F.when(m == 3, True).alias("tributaPISCOFINS"),
        F.array(F.lit(" trade "), F.lit(""), F.concat(F.lit("x"), k.cast("string"))).alias("atividades"), thing.alias("resumoPorCfop"), F.when(m != 2, thing).alias("resumoPorCfopSittax"), F.when(m != 2, thing).alias("resumoPorCfopXml"),
    )
    names = ["receitaLiquida", "receitaProdutos", "receitaServicos", "receitaDevolucao", "rbt12", "rba", "valorDas", "valorDasXml"]
    risk = F.lit('{"risk":1}')
    data = F.struct(
        F.lit("OFFICE").alias("escritorioNome"), F.when(m == 0, F.col("o_orderpriority")).alias("empresaNome"), F.date_format("o_orderdate", "MM/yyyy").alias("periodoFiscal"), F.when(m < 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("dataHoraTransmissao"), F.when(m == 2, "NAO_TRANSMITIDA").alias("tipoDaTransmissao"),
        (F.col("o_orderstatus") == "P").alias("emTransmissao"), F.concat(F.lit("D"), k.cast("string")).alias("numeroDas"), *[brl(i).alias(n) for i, n in enumerate(names)], F.array(mine.withField("cnpj", other), mine).alias("empresasDaApuracao"),
        F.when(m != 0, thing).alias("resumosTributacaoSittax"), F.when(m == 0, F.array(F.struct(F.lit(1).alias("a")))).alias("folhas"), F.when(m == 0, F.array(F.struct(F.lit(2).alias("b")))).alias("folhasDePagamento"), F.when(m == 2, False).alias("folhaDePagamentos"),
        F.when(m == 1, F.array(F.lit("late"), F.lit("again"))).alias("mensagens"),
    )
    whole = F.to_json(F.struct(F.lit(True).alias("ok"), data.alias("data")))
    listed = F.when(m == 2, risk).otherwise(F.concat(F.lit("["), risk, F.lit(","), risk, F.lit("]")))
    body = F.regexp_replace(whole, F.lit(r"\}\}$"), F.concat(F.lit(',"relatorioDeConferenciaSittax":'), listed, F.lit("}}")))
    o = table(spark, sf_dir, "orders").select(k.alias("k"), cnpj.alias("requested_cnpj"), F.date_format("o_orderdate", "yyyy-MM").alias("requested_period"), body.alias("body"))
    r = assessments.map_assessment(o, keep=("k",))
    money = ["net_revenue", "product_revenue", "service_revenue", "return_revenue", "rbt12", "rba", "das_amount", "das_xml_amount"]
    return r.select(
        "k", "office_name", "company_name", "is_transmitted", F.date_format("transmitted_at", "yyyy-MM-dd").alias("transmitted_on"), "transmission_in_progress", "das_number", F.array(*[(F.col(c) * 100).cast("long") for c in money]).alias("money"), "taxes_icms", "taxes_iss", "taxes_ipi", "taxes_pis_cofins",
        *[F.size(c).alias(c) for c in ("companies", "annexes", "cfops")], "activities", "payrolls", "alerts", F.size("risks").alias("risks"), (F.coalesce("transmission_type", F.lit("")) != "").alias("known"),
    )


@query("""
SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '#' || o_orderkey WHEN 1 THEN 'g' || o_orderkey ELSE 'hashed' END AS source_task_key, CASE WHEN o_orderkey % 2 = 0 THEN 'KIND' ELSE o_orderpriority END AS task_type, o_orderpriority AS task_name,
  CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS period, strftime(o_orderdate, '%Y-%m-%d') AS created_on, CASE WHEN o_orderkey % 2 = 0 THEN '.xml' ELSE '.pdf' END AS file_extension, CASE WHEN o_orderkey % 5 = 0 THEN ['period'] ELSE [] END AS errors FROM orders
""")
def task_fields(spark, sf_dir):
    """Orders as tasks with an id, a guid or neither, of a kind or named alone, with file names and periods of which some make no sense."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    item = F.to_json(F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("#"), text)).alias("id"), F.when(k % 3 == 1, F.concat(F.lit("g"), text)).alias("guid"), F.col("o_orderpriority").alias("titulo"), F.when(k % 2 == 0, "KIND").alias("tipoNome"), F.when(k % 5 == 0, "never").otherwise(F.date_format("o_orderdate", "MM/yyyy")).alias("periodo"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("dataCriacao"), F.when(k % 2 == 0, "xml").otherwise("3").alias("extensaoArquivo"), F.lit("a.PDF").alias("nomeArquivo"),
    ))
    r = assessments.map_task(table(spark, sf_dir, "orders").select(k.alias("k"), item.alias("item")))
    key = F.when(F.length("source_task_key") == 32, "hashed").otherwise(F.col("source_task_key"))
    return r.select("k", key.alias("source_task_key"), "task_type", "task_name", "period", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "file_extension", "errors")


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT k, n, a + CASE WHEN n % 2 = 0 THEN q * 100 ELSE 0 END AS total, CASE WHEN n % 3 = 0 THEN 777 ELSE a END AS resale, CASE WHEN n % 2 = 0 THEN q * 100 END AS use_consumption, CASE WHEN n % 4 = 0 THEN ['rejected'] ELSE [] END AS errors, CASE WHEN n % 2 = 0 THEN ['R' || n] ELSE [] END AS dare_numbers FROM l
""")
def difal_totals(spark, sf_dir):
    """Order lines as DIFAL replies: totals of guides, and credit amounts that come before plain ones unless they are zero."""
    n, a, q = F.col("l_linenumber"), F.round("l_extendedprice", 2).cast("decimal(14,2)"), F.col("l_quantity").cast("decimal(14,2)")
    difal = F.struct(a.alias("valorGuiaRevenda"), F.when(n % 2 == 0, q).alias("totalGuiaUsoConsumoImobilizado"), F.when(n % 3 == 0, 7.77).otherwise(0).alias("valorGuiaRevendaUtilizandoCredito"), F.when(n % 2 == 0, F.concat(F.lit("R"), n.cast("string"))).alias("numeroDareGuiaRevenda"))
    body = F.to_json(F.struct((n % 4 != 0).alias("sucesso"), difal.alias("difal")))
    r = assessments.map_difal(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.cast("long").alias("n"), body.alias("body")))
    cents = lambda c: (F.col(c) * 100).cast("long")
    return r.select("k", "n", cents("total_amount").alias("total"), cents("resale_amount").alias("resale"), cents("use_consumption_amount").alias("use_consumption"), "errors", "dare_numbers")


@query("""
WITH l AS (SELECT l_returnflag AS direction, l_partkey % 7 = 0 AS failed, l_partkey % 7 <> 0 AND l_suppkey % 5 = 0 AS skipped, l_orderkey % 3 <> 0 AS matched, l_orderkey % 4 AS k FROM lineitem)
SELECT direction, count(*) AS received, count(*) FILTER (WHERE NOT failed AND NOT skipped AND matched) AS matched, count(*) FILTER (WHERE NOT failed AND NOT skipped AND NOT matched) AS unmatched, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE skipped) AS skipped,
  count(*) FILTER (WHERE NOT failed AND NOT skipped AND k = 0) AS created, count(*) FILTER (WHERE NOT failed AND NOT skipped AND k = 1) AS updated, count(*) FILTER (WHERE NOT failed AND NOT skipped AND k > 1) AS unchanged FROM l GROUP BY 1
""")
def sync_counters(spark, sf_dir):
    """Order lines as received items of a direction each return flag: failed, skipped, matched or not, and what the merge did with the rest."""
    k = F.col("l_orderkey") % 4
    failed = F.col("l_partkey") % 7 == 0
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("direction"), failed.alias("failed"), (~failed & (F.col("l_suppkey") % 5 == 0)).alias("skipped"), F.when(F.col("l_orderkey") % 3 != 0, "MATCHED").when(k == 0, "AMBIGUOUS").alias("match_status"),
        F.when(k == 0, "CREATED").when(k == 1, "WOULD_UPDATE").otherwise("UNCHANGED").alias("op"),
    )
    return merge.sync_counters(rows, rows.where("NOT failed AND NOT skipped").select("direction", "op"), "direction")


@query("""
SELECT DISTINCT lpad(CAST(o_custkey % 50 AS VARCHAR), 7, '0') AS cnae FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 0 AND o_orderstatus = 'F' AND c_custkey BETWEEN 1 AND 100
""")
def tenant_cnaes(spark, sf_dir):
    """Codes of the active companies of one tenant, of some of its ids."""
    catalog = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.lpad((F.col("o_custkey") % 50).cast("string"), 7, "0").alias("cnae"), (F.col("o_orderstatus") == "F").alias("active"))
    return match.unique_active_cnaes(catalog, _companies(spark, sf_dir), org=2, ids=list(range(1, 101)))
