import json

import pytest
from pyspark.sql import functions as F

from taxflow.functions import classify as R
from taxflow.operators import merge, payroll, quality
from taxflow.plans import catalogs, jobs, views
from taxflow.sources import feeds
from taxflow.sources.versions import VersionConflict, Versions
from taxflow.sources.elements import Splitter, read_elements
from taxflow.streaming import run_watch, streams
from tests.test_pages import MONTH, page

STATE = ", active boolean, deleted_at timestamp, sync_status string"
SEEN = ", first_seen_at timestamp, last_seen_at timestamp"


@pytest.fixture
def now(spark):
    return F.lit("2026-06-01 10:00:00").cast("timestamp")


def ops(out):
    return sorted(r.op for r in out["ops"].collect())


def test_tenant(spark):
    orgs = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False)], "organization_id long, slug string, active boolean")
    assert jobs.resolve_tenant(orgs, "b") == 2 and jobs.resolve_tenant(orgs.where("organization_id <> 2")) == 1
    for slug in (None, "c"):
        with pytest.raises(ValueError):
            jobs.resolve_tenant(orgs, slug)


def test_registry_and_deliveries(spark, tmp_path, now):
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"id": 1, "cnpj": "11.222.333/0001-81", "razaoSocial": "X"}, {"id": 1, "cnpj": "11.222.333/0001-81", "razaoSocial": "X"}, {"id": 2}]}))
    target = spark.createDataFrame([], "organization_id long, cnpj string, external_id string, razao_social string" + STATE + SEEN)
    out = jobs.run_registry_sync(spark, str(tmp_path / "c.json"), target, 1, now)
    assert ops(out) == ["CREATED"] and out["rejected"].count() == 1
    assert ops(jobs.run_registry_sync(spark, str(tmp_path / "c.json"), out["after"], 1, now)) == ["UNCHANGED"]
    assert ops(jobs.run_registry_sync(spark, str(tmp_path / "c.json"), target, 1, now, dry_run=True)) == ["WOULD_CREATE"]

    item = {"Nome": "DAS", "EntDtEntrega": "2026-05-10", "EntDtFinalizacao": "2026-05-10 10:00:00", "Status": "Ent. antecipada", "Config": {"EntID": "5001", "ID": "77", "Tipo": "O", "DptoNome": "Fiscal"}}
    folder = tmp_path / "d"
    folder.mkdir()
    for month in ("2026-05", "2026-06", "2026-07"):
        (folder / f"{month}.json").write_text(json.dumps([{"ID": 1, "Identificador": "11.222.333/0001-81", "Razao": "X", "Entregas": [item, item | {"Nome": "GPS"}]}]))
    companies = spark.createDataFrame([(7, "11222333000181", True)], "company_id long, cnpj string, active boolean")
    periods = spark.createDataFrame([(1, "2026-05"), (2, "2026-06"), (3, "2026-07")], "period_id long, competencia string")
    obligations = spark.createDataFrame([(9, "DAS")], "obligation_id long, code string")
    statuses = spark.createDataFrame([], "company_id long, period_id long, obligation_id long, status string, department string, confidence decimal(5,2), delivered_at timestamp" + SEEN)
    out = jobs.run_delivery_sync(spark, str(folder), companies, periods, obligations, statuses, now, "2026-05", "2026-06")
    assert {(r.period_id, r.op, r.n) for r in out["counts"].collect()} == {(1, "CREATED", 1), (2, "CREATED", 1)} and out["deliveries"].count() == 4
    assert {r.status for r in out["after"].collect()} == {"CONFIRMADO_API"}


def test_assessment_jobs(spark, tmp_path, now):
    (tmp_path / "a.json").write_text(json.dumps({"sucesso": True, "empresas": [{"id": 1, "cnpj": "11222333000181", "nome": "X"}, {"id": 2, "cnpj": "9", "nome": "Y"}]}))
    master = spark.createDataFrame([(7, "11222333000181", True)], "company_id long, cnpj string, active boolean")
    target = spark.createDataFrame([(1, "old", "1", None, "UNMATCHED", None, None)], "organization_id long, external_id string, cnpj string, company_id long, match_status string" + SEEN)
    out = jobs.run_assessment_companies(spark, str(tmp_path / "a.json"), master, target, 1, now)
    assert ops(out) == ["CREATED"] and [r.external_id for r in out["missing"].collect()] == ["old"] and out["rejected"].count() == 1
    assert {(r.external_id, r.company_id) for r in out["after"].collect()} == {("old", None), ("1", 7)}

    good = {"ok": True, "data": {"id": "A", "empresaCnpj": "11222333000181", "periodoFiscal": "05/2026", "valorDas": "1.234,50"}}
    replies = spark.createDataFrame([(json.dumps(good), "11222333000181", "2026-05"), (json.dumps(good), "11222333000181", "2026-06")], "body string, requested_cnpj string, requested_period string")
    table = spark.createDataFrame([], "organization_id long, assessment_id string, das_amount decimal(14,2)" + SEEN)
    out = jobs.run_assessments(replies, table, 1, now)
    assert ops(out) == ["CREATED"] and [r.errors for r in out["rejected"].collect()] == [["period"]] and str(out["after"].first().das_amount) == "1234.50"

    def items(*rows):
        return spark.createDataFrame([(json.dumps(r),) for r in rows], "item string")

    doc = {"numero": 1, "data_competencia": "05/2026", "valor_total": 2}
    landed = {"DIFAL": replies.limit(0), "ENTRADA": items(doc, doc), "SAIDA": items(doc, {"id": 3}), "TASKS": items({"id": 5, "titulo": "T"})}
    targets = {
        "DIFAL": spark.createDataFrame([], "organization_id long, requested_cnpj string, requested_period string, total_amount decimal(14,2)" + SEEN),
        "DOCUMENTS": spark.createDataFrame([], "organization_id long, direction string, source_document_key string, total_amount decimal(14,2)" + SEEN),
        "TASKS": spark.createDataFrame([], "organization_id long, source_task_key string, task_name string" + SEEN),
    }
    out = jobs.run_operational(landed, targets, 1, now)
    assert ops(out["DIFAL"]) == [] and ops(out["DOCUMENTS"]) == ["CREATED", "CREATED"] and ops(out["TASKS"]) == ["CREATED"] and out["DOCUMENTS"]["rejected"].count() == 1
    assert set(jobs.run_operational(landed, targets, 1, now, "TASKS")) == {"TASKS"}
    with pytest.raises(ValueError):
        jobs.run_operational(landed, targets, 1, now, "OTHER")


def test_enrichment_catalog_and_import(spark, tmp_path, now):
    pages = spark.createDataFrame([("k", "detail", "CNAE: 0000-0/01 Descricao: Comércio varejista"), ("j", "detail", "CNAE: 0000-0/02 Descricao: Outro")], "page_key string, kind string, html string")
    wanted = spark.createDataFrame([("0000001",), ("0000002",), ("0000003",)], "cnae string")
    cache = spark.sql("SELECT '0000002' AS cnae, 'h' AS content_hash, 'x' AS description, 'PARSED' AS parse_status, 'rule-pages-1' AS parser_version, timestamp'2026-05-01' AS retrieved_at, timestamp'2026-12-01' AS expires_at")
    columns = ["description", "parse_status", "parser_version"]
    out = jobs.run_enrichment(pages, wanted, cache, columns, now)
    assert {(r.cnae, r.status) for r in out["items"].collect()} == {("0000001", "CREATED"), ("0000002", "SKIPPED_FRESH_CACHE"), ("0000003", "CNAE_NOT_FOUND")}
    assert {(r.cnae, r.op) for r in out["ops"].collect()} == {("0000001", "CREATED")} and [r.cnae for r in out["missing"].collect()] == ["0000003"]
    assert {(r.cnae, r.description) for r in out["after"].collect()} == {("0000001", "Comércio varejista"), ("0000002", "x")}
    assert ops(jobs.run_enrichment(pages, wanted, cache, columns, now, force_refresh=True)) == ["CREATED", "UPDATED"]

    companies = spark.sql("SELECT 7L AS company_id, true AS active, '0000-0/01' AS cnae_principal, array('0000-0/02') AS cnaes_secundarios")
    catalog = spark.createDataFrame([], "company_id long, cnae string, is_primary boolean, source string, active boolean, first_seen_at timestamp, last_seen_at timestamp, deactivated_at timestamp")
    assert ops(jobs.run_catalog_backfill(companies, catalog, now)) == ["CREATED", "CREATED"]

    rows = [{"file": "a_05-2026.pdf", "page_no": 1, "text": page("1/1", "1", MONTH)}, {"file": "b.pdf", "page_no": 1, "text": page("1/1", "1", MONTH)}]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(r) for r in rows))
    assert jobs.run_payroll_report(spark, str(tmp_path / "p.json"))["companies"].count() == 2
    hashes = spark.createDataFrame([("a_05-2026.pdf", "s1"), ("b.pdf", "s2")], "file string, sha256 string")
    master = spark.createDataFrame([(7, "12345678000195", True)], "company_id long, cnpj string, active boolean")
    imported = spark.createDataFrame([(1, "s2")], "organization_id long, sha256 string")
    out = jobs.run_payroll_import(jobs.read_report_pages(spark, str(tmp_path / "p.json")), hashes, imported, master, 1)
    assert [(r.company_id, r.competencia, str(r.amount)) for r in out["evidence"].collect()] == [(7, "2026-06", "3291.00")] and out["imported"].count() == 1


def test_delivery_feed(spark, tmp_path):
    """Three items of one block, a block with a single item, an empty page, a page with an error, and one that can't be read."""
    done = {"EntDtEntrega": "2026-05-10", "EntDtFinalizacao": "2026-05-10 10:00:00"}
    none = {"EntDtEntrega": "0000-00-00", "EntDtFinalizacao": None}
    items = [
        {"Nome": "DAS", "Status": "Ent. antecipada", "Config": {"EntID": "5001", "ID": "1", "Tipo": "O", "DptoNome": "Fiscal"}} | done,
        {"Nome": "GPS", "Status": "Atrasada!", "Config": {"EntID": "5002", "ID": "2", "Tipo": "O", "DptoNome": "Fiscal"}} | none,
        {"Nome": "Tarefa", "Status": "Pendente", "Config": {"EntID": "5003", "ID": "3", "Tipo": "T", "DptoNome": "Contabil"}} | none,
    ]
    block = {"ID": "1", "Identificador": "11.222.333/0001-81", "Razao": "X"}
    bodies = [json.dumps([block | {"Entregas": items}, block | {"ID": "2", "Entregas": items[0]}]), "", json.dumps({"Erro": "limit"}), "{broken"]
    rows = feeds.delivery_items(spark.createDataFrame([("2026-05", b) for b in bodies], "period string, body string"))
    assert sorted(r.error_message for r in rows.where("error_message IS NOT NULL").collect()) == ["limit", "unreadable page"]
    found = R.map_obligation(feeds.map_delivery(rows.where("error_message IS NULL")), "name", spark.createDataFrame([(9, "DAS")], "obligation_id long, code string"))
    got = {(r.external_company_id, r.external_delivery_id): (r.type, r.normalized_status, r.mapping_status, r.department) for r in found.collect()}
    assert got == {
        ("1", "5001"): ("O", "CONFIRMADO_API", "MAPPED", "FISCAL"), ("1", "5002"): ("O", "PENDENTE", "UNMAPPED", "FISCAL"), ("1", "5003"): ("T", "PENDENTE", "UNMAPPED", "COMPARTILHADO"),
        ("2", "5001"): ("O", "CONFIRMADO_API", "MAPPED", "FISCAL"),
    }
    assert {r.external_delivery_id for r in quality.fiscal_only(found).collect()} == {"5001", "5002"}
    for name in ("2026-05", "default"):
        (tmp_path / f"{name}.json").write_text(json.dumps([block | {"ID": name, "Entregas": []}]))
    of = lambda month: [r.external_company_id for r in feeds.delivery_blocks(feeds.read_feed_by_period(spark, str(tmp_path), month, "default.json"), "11222333/0001-81").collect()]
    assert of("2026-05") == ["2026-05"] and of("2026-06") == ["default"]


def test_last_of_equal_keys_wins(spark, tmp_path, now):
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"id": 1, "cnpj": "11.222.333/0001-81", "razaoSocial": n} for n in ("Z", "A")]}))
    target = spark.createDataFrame([], "organization_id long, cnpj string, razao_social string" + STATE + SEEN)
    assert [r.razao_social for r in jobs.run_registry_sync(spark, str(tmp_path / "c.json"), target, 1, now)["after"].collect()] == ["A"]


def test_registry_stream(spark, tmp_path):
    """Versions of the registry from change events; the same files again change nothing."""
    columns = "organization_id long, cnpj string, external_id string, razao_social string, active boolean, deleted_at timestamp, sync_status string, event_at timestamp"
    versions = Versions(spark, str(tmp_path / "t"))
    assert versions.commit(spark.createDataFrame([], columns), None) == 0
    (tmp_path / "in").mkdir()
    base = {"organization_id": "1", "cnpj": "11222333000181", "id": "7"}
    events = [base | {"event_type": "company.upsert", "razao_social": "B", "updated_at": "2026-01-02T00:00:00Z"}, base | {"event_type": "company.upsert", "razao_social": "A", "updated_at": "2026-01-01T00:00:00Z"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, events)))
    run = lambda: streams.start_registry_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    run()
    rows = versions.read(1).collect()
    assert [(r.razao_social, r.active, r.sync_status) for r in rows] == [("B", True, "SYNCED")]
    (tmp_path / "in/b.json").write_text(json.dumps({"organization_id": "1", "id": "7", "event_type": "company.deleted", "deleted_at": "2026-01-03T00:00:00Z"}))
    run()
    number, after = versions.latest()
    assert number == 2
    assert [(r.razao_social, r.active, r.sync_status, str(r.deleted_at)) for r in after.collect()] == [("B", False, "DELETED_IN_SOURCE", "2026-01-03 00:00:00")]
    again = streams.typed_events(spark.read.schema(streams.EVENT_SCHEMA).json(str(tmp_path / "in")))
    assert [r.op for r in streams.apply_company_events(after, again, F.current_timestamp())[1].collect()] == ["STALE"]


def test_seeds_and_report_summary(spark, now):
    empty = spark.createDataFrame([], "seed_id long, code string, name string, category string, department_default string, source_priority array<string>, active boolean")
    after, ops = catalogs.seed_obligations(empty, now)
    assert merge.merge_counts(ops).collect()[0].n == 13 and catalogs.obligation_rules(spark).count() == 16
    assert {r.op for r in catalogs.seed_obligations(after.withColumn("seed_id", F.monotonically_increasing_id()), now)[1].collect()} == {"UNCHANGED"}
    out = payroll.parse_report(spark.createDataFrame([("Resumo_05-2026.pdf", 1, page("1/1", "0001", MONTH)), ("x.pdf", 1, None)], "file string, page_no int, text string"))
    got = {r.file: r for r in views.report_summary(out["reports"], out["companies"], out["warnings"]).collect()}
    assert got["Resumo_05-2026.pdf"].payroll == 1 and got["Resumo_05-2026.pdf"].employee == 1 and got["Resumo_05-2026.pdf"].company_warning_codes == {}
    assert got["x.pdf"].warning_codes == {"TEXT_LAYER_MISSING": 1, "COMPANY_HEADER_INCOMPLETE": 1, "PAGE_HEADER_MISSING": 1}


def test_versions(spark, tmp_path):
    """A writer that stops half-way leaves no version, one that reads an old version is refused, and a rerun of a commit does nothing."""
    v = Versions(spark, f"file://{tmp_path}/t")
    rows = lambda n: spark.range(n).toDF("id")
    with pytest.raises(ValueError):
        v.latest()
    assert v.commit(rows(1), None, "a") == 0

    class Stopped(Versions):
        def _make_valid(self, number, entry):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Stopped(spark, v.root).commit(rows(5), 0, "b")
    assert v.latest()[0] == 0 and v.latest()[1].count() == 1
    assert v.commit(rows(2), 0, "b") == 1 and v.commit(rows(9), 0, "b") == 1 and v.latest()[1].count() == 2
    with pytest.raises(VersionConflict):
        v.commit(rows(3), 0, "c")

    class Late(Versions):  # both have seen that the number is free
        def numbers(self):
            return [0]

    with pytest.raises(VersionConflict):
        Late(spark, v.root).commit(rows(3), 0, "c")
    assert v.latest()[1].count() == 2 and v.numbers() == [0, 1]


def test_two_identities(spark, now):
    """A cnpj decides before an id; ids that an earlier event of the batch gave, or took away, count at their time."""
    columns = "organization_id long, cnpj string, external_id string, razao_social string, active boolean, deleted_at timestamp, sync_status string, event_at timestamp"
    target = spark.createDataFrame([(1, "A" * 14, "a", "A", True, None, "SYNCED", None), (1, "B" * 14, "b", "B", True, None, "SYNCED", None), (1, "C" * 14, "c", "C", False, None, "SYNCED", None)], columns)
    seen = "organization_id long, cnpj string, external_id string, deleted_at timestamp"
    after, ops = merge.delete_registry(target, spark.createDataFrame([(1, "A" * 14, "b", None), (1, "Z" * 14, "c", None), (1, None, "z", None), (2, "A" * 14, None, None)], seen), now)
    assert {(r.cnpj, r.external_id, r.op) for r in ops.collect()} == {("A" * 14, "a", "DELETED"), ("C" * 14, "c", "DELETED"), (None, "z", "NOT_FOUND"), ("A" * 14, None, "NOT_FOUND")}
    assert {(r.external_id, r.active, r.sync_status) for r in after.collect()} == {("a", False, "DELETED_IN_SOURCE"), ("b", True, "SYNCED"), ("c", False, "DELETED_IN_SOURCE")}
    assert {r.op for r in merge.delete_registry(after, spark.createDataFrame([(1, "A" * 14, None, None)], seen), now)[1].collect()} == {"ALREADY_DELETED"}

    def run(*events):
        raw = spark.createDataFrame([{"organization_id": "1", "event_type": "upsert"} | e for e in events], streams.EVENT_SCHEMA).coalesce(1)
        after, ops = streams.apply_company_events(target, streams.typed_events(raw), now)
        return {r.external_id: (r.cnpj[0], r.active) for r in after.collect()}, sorted((r.cnpj or "-")[0] + ":" + r.op for r in ops.collect())

    gone = {"event_type": "company.deleted"}
    day = lambda d: f"2026-01-{d:02d}T00:00:00Z"
    assert run({"id": "d", "cnpj": "44444444444444", "updated_at": day(1)}, gone | {"id": "d", "deleted_at": day(2)}) == ({"a": ("A", True), "b": ("B", True), "c": ("C", False), "d": ("4", False)}, ["4:DELETED"])
    assert run(gone | {"id": "d", "deleted_at": day(1)}, {"id": "d", "cnpj": "44444444444444", "updated_at": day(2)})[1] == ["-:NOT_FOUND", "4:CREATED"]
    assert run(gone | {"id": "b", "cnpj": "99999999999999", "deletedAt": day(2)})[1] == ["B:DELETED"]
    # the id moves to another company before it is deleted
    assert run({"id": "x", "cnpj": "B" * 14, "updatedAt": day(1)}, {"id": "b", "cnpj": "A" * 14, "updatedAt": day(2)}, gone | {"id": "b", "updated_at": day(3)})[1] == ["A:DELETED", "B:UPDATED"]
    assert run({"id": "q", "cnpj": None})[1] == ["-:REJECTED"]


def test_last_item_of_a_page_counts(spark, tmp_path, now):
    """Two items of one status in both orders; ids as text would decide otherwise."""
    item = lambda i, done: {"Nome": "DAS", "EntDtEntrega": "2026-05-10" if done else "0000-00-00", "EntDtFinalizacao": None, "Status": "Ent. antecipada", "Config": {"EntID": i, "ID": "7", "Tipo": "O", "DptoNome": "Outro"}}
    companies = spark.createDataFrame([(7, "11222333000181", True)], "company_id long, cnpj string, active boolean")
    periods = spark.createDataFrame([(1, "2026-05")], "period_id long, competencia string")
    obligations = spark.createDataFrame([(9, "DAS", "CONTABIL")], "obligation_id long, code string, department_default string")
    statuses = spark.createDataFrame([], "company_id long, period_id long, obligation_id long, status string, department string, confidence decimal(5,2), delivered_at timestamp" + SEEN)
    for n, items in enumerate(([item("9", True), item("10", False)], [item("10", False), item("9", True)])):
        (tmp_path / f"{n}").mkdir()
        (tmp_path / f"{n}/2026-05.json").write_text(json.dumps([{"ID": 1, "Identificador": "11.222.333/0001-81", "Razao": "X", "Entregas": items}]))
        row = jobs.run_delivery_sync(spark, str(tmp_path / f"{n}"), companies, periods, obligations, statuses, now, "2026-05")["after"].first()
        assert (row.status, str(row.confidence), row.department) == (("PENDENTE", "CONFIRMADO_API")[n] if n else "CONFERENCIA_MANUAL", "100.00" if n else "70.00", "CONTABIL")


def test_redaction(spark):
    """No secret is left, and JSON stays JSON."""
    deep = '{"a":' * 200_000 + '{"token":"SECRET"}' + "}" * 200_000
    bodies = [
        '{"token":{"a":"}","b":"SECRET"},"x":1}', '{"token":{"a":{"b":{"c":{"d":"SECRET"}}}},"x":1}', '{"to\\u006ben":"SECRET","x":1}', '[{"a":[[{"Senha":["SECRET"]}]]},"x"]', '{"token": "SECRET', '{"a":1,"token":{"b":["SECRET',
        "user=1&password=SECRET&x=1", '{"token":"SECRET","token":"SECRET"}', deep, '{"x":"\\ud800","secret":"SECRET"}', "plain", None, '{"x": NaN, "pwd": SECRET}',
    ]
    rows = spark.createDataFrame([(i, {}, b, "application/json") for i, b in enumerate(bodies)], "i int, headers map<string,string>, body string, content_type string")
    got = {r.i: r for r in feeds.sanitize_http_log(rows).collect()}
    assert not any("SECRET" in (r.body or "") for r in got.values())
    assert [json.loads(got[i].body) for i in (0, 1, 2)] == [{"token": "<REDACTED>", "x": 1}] * 3 and json.loads(got[3].body) == [{"a": [[{"Senha": "<REDACTED>"}]]}, "x"]
    assert got[6].body == "user=1&password=<REDACTED>&x=1" and got[8].body_status == "TOO_DEEP" and got[10].body == "plain" and got[11].body_status == "EMPTY"


def elements(text, step, names=("items",), single=False):
    s, out = Splitter(names, single), []
    for i in range(0, len(text), step):
        out += s.feed(text[i : i + step])
    return out, s.finish()


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_splitter(step):
    a, b = '{"x": "}],{[\\\\\\" ", "y": [1, {"z": []}]}', '{"k": "é"}'
    for text, found in {f"[{a}, {b}]": [a, b], f' {{"total": 2, "other": [1], "n": {{"items": [3]}}, "items" : [{a},\n{b} , 5, "s,]"], "last": [7]}}': [a, b, "5", '"s,]"'], "[]": [], '{"items": []}': []}.items():
        assert elements(text, step) == (found, None), text
    assert elements(f"[{a}, {b[:5]}", step) == ([a], "ends early") and elements(f"[{a}}}", step)[1] == "broken JSON" and elements("[1] x [2]", step)[1] == "broken JSON"
    assert elements('{"a": 1}', step)[1] == "no list" and elements("plain", step)[1] == "no list" and elements(a, step, (), True) == ([a], None) and elements("", step) == ([], None)


def test_large_bodies(spark, tmp_path):
    """Files are read in several splits, and a broken tail gives one error row and loses nothing before it."""
    items = [json.dumps({"id": i, "cnpj": "11222333000181", "razaoSocial": "x}" * (i % 50)}) for i in range(20_000)]
    whole = '{"results": [' + ",".join(items) + "]}"
    (tmp_path / "a b.json").write_text(whole)
    (tmp_path / "cut.json").write_text(whole[: len(whole) // 2])
    (tmp_path / "almost.json").write_text(whole[:-1])
    (tmp_path / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = feeds.read_company_feed(spark, str(tmp_path))
        got = {r.file: r for r in rows.groupBy("file").agg(F.count("*").alias("n"), F.max("item_no").alias("last"), F.count_distinct("item").alias("d")).collect()}
        assert [(got[f].n, got[f].last, got[f].d) for f in ("a b.json", "almost.json")] == [(20_000, 19_999, 20_000)] * 2 and 9_000 < got["cut.json"].n < 11_000
        assert [r.item for r in rows.where("file = 'a b.json' AND item_no IN (0, 777, 19999)").orderBy("item_no").collect()] == [items[0], items[777], items[19_999]]
        assert {(r.file, r.error) for r in feeds.feed_errors(spark, str(tmp_path)).collect()} == {("cut.json", "ends early"), ("almost.json", "ends early")}
        assert read_elements(spark, str(tmp_path / "empty.json")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stale_runs_are_told_once(spark, tmp_path):
    spark.conf.set(*run_watch.STATE_STORE)
    (tmp_path / "in").mkdir()
    told = []

    def trigger(n, *rows):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "status", "started_at", "written_at"), (r, s, f"2026-01-01T{a}:00Z", f"2026-01-01T{w}:00Z")))) for r, s, a, w in rows))
        ledger = spark.readStream.schema("run_id string, status string, started_at timestamp, written_at timestamp").json(str(tmp_path / "in"))
        out = run_watch.watch_stale_runs(ledger).writeStream.outputMode("append").foreachBatch(lambda df, i: told.extend((r.run_id, str(r.stale_at)) for r in df.collect()))
        out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    trigger(1, ("a", "RUNNING", "10:00", "10:00"), ("b", "RUNNING", "10:01", "10:01"))
    assert told == []
    trigger(2, ("b", "SUCCESS", "10:01", "10:10"), ("c", "RUNNING", "10:14", "10:14"))
    assert told == []
    trigger(3, ("d", "RUNNING", "10:20", "10:20"), ("a", "RUNNING", "10:00", "10:20"))
    assert told == [("a", "2026-01-01 10:15:00")]
    trigger(4, ("e", "SUCCESS", "10:59", "10:59"))
    assert sorted(told) == [("a", "2026-01-01 10:15:00"), ("c", "2026-01-01 10:29:00"), ("d", "2026-01-01 10:35:00")]


def test_file_events(spark, tmp_path):
    """Files that land, with their digest; K3."""
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abc")
    seen = []
    streams.file_events(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.size, r.sha256) for r in seen] == [(3, hashlib.sha256(b"abc").hexdigest())]
