import json

import pytest
from pyspark.sql import functions as F

from taxflow import staging
from taxflow.functions import classify as R
from taxflow.functions import normalize as N
from taxflow.operators import merge
from taxflow.plans import more_queries  # noqa: F401  (registers its queries)
from taxflow.plans.queries import QUERIES, SQL
from taxflow.sources import feeds
from taxflow.streaming import streams
from tests.oracle import differences


@pytest.mark.parametrize("name", ["cockpit", "merge_snapshot_ops", "factor_r_potential", "group_pages"])
def test_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", name, QUERIES[name], SQL[name]) == ""


def test_normalisers(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(N.validate_cnpj(F.lit("11.222.333/0001-81")))["status"] == "VALID"
    assert one(N.validate_cnpj(F.lit("11.222.333/0001-82")))["status"] == "INVALID"
    assert one(N.validate_cnpj(F.lit(" ")))["status"] == "MISSING"
    assert str(one(N.parse_brl_strict(F.lit("1.234,56")))) == "1234.56" and str(one(N.parse_brl_strict(F.lit(",50")))) == "0.50"
    assert one(N.parse_brl_strict(F.lit("1234.56"))) is None and str(one(N.parse_decimal_mixed(F.lit("1.234")))) == "1.23"
    assert one(N.payroll_to_assessment(F.lit("12/2026")))["assessment"] == "2027-01"
    assert one(N.parse_informed(F.lit("220:30")))["minutes"] == 13230
    assert one(R.resolve_regime(F.lit("Lucro Presumido - Serviços")))["canonical"] == "LUCRO_PRESUMIDO"
    assert one(R.rubric_signals(F.lit("1"), F.lit("Horas Normais"))) == ["has_employee"]
    assert one(R.classify_activity(F.lit("Comércio varejista de imóveis"))) == ["COMERCIO", "SERVICOS_IMOBILIARIOS"]


def test_merge_twice_changes_nothing(spark):
    now = F.lit("2026-01-01").cast("timestamp")
    batch = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    empty = batch.limit(0).withColumns({"first_seen_at": now, "last_seen_at": now})
    after, ops = merge.merge_snapshot(empty, batch, ["k"], ["v"], now)
    assert {r.op for r in ops.collect()} == {"CREATED"}
    assert {r.op for r in merge.merge_snapshot(after, batch, ["k"], ["v"], now)[1].collect()} == {"UNCHANGED"}


def test_feed_and_stream(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"id": 1, "cnpj": "11.222.333/0001-81", "razaoSocial": "X", "uf": "goias"}, {"id": 2}]}))
    rows = feeds.map_registry_company(feeds.read_company_feed(spark, str(tmp_path / "c.json"))).orderBy("external_id").collect()
    assert rows[0].cnpj == "11222333000181" and rows[0].uf == "GO" and rows[0].errors == [] and rows[1].errors == ["cnpj", "razao_social"]
    (tmp_path / "in").mkdir()
    event = {"organization_id": "1", "cnpj": "9", "event_type": "upsert"}
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(event | {"updated_at": f"2026-01-0{d}", "razao_social": str(d)}) for d in (1, 3, 2)))
    seen = []
    streams.start_company_stream(spark, str(tmp_path / "in"), lambda df, i: seen.extend(r.razao_social for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["1", "2", "3"]


def test_statuses_are_sorted_narrow(spark):
    """Columns that the result doesn't need aren't carried through the sort by key, and a task's rows don't grow with the table."""
    row = (1, 1, 1, "O", "MAPPED", None, None, None, "FISCAL", "{}")
    kinds = "company_id int, period_id int, obligation_id int, type string, mapping_status string, normalized_status string, finalized_at timestamp, delivered_on date, department string, raw string"
    late = spark.createDataFrame([(*row, 1), (*row[:5], "PENDENTE", *row[6:8], "DP", "{}", 3), (*row[:5], "CONFERENCIA_MANUAL", *row[6:], 2)], kinds + ", delivery_id int")
    none = late.limit(0).select("company_id", "period_id", "obligation_id", F.lit("").alias("status"), "department", F.lit(None).cast("decimal(5,2)").alias("confidence"), *[F.lit(None).cast("timestamp").alias(c) for c in ("delivered_at", "first_seen_at", "last_seen_at")])
    after, _ = merge.merge_status(late, none, F.lit("2026-01-01").cast("timestamp"))
    assert [(r.status, r.department, float(r.confidence)) for r in after.collect()] == [("PENDENTE", "DP", 100.0)]
    grouped = [line for line in after._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert grouped and not any("raw" in line or "mapping_status" in line for line in grouped)
    assert staging.dealt(spark.range(100), "id", rows=5).rdd.getNumPartitions() == 20
    plan = QUERIES["overwrite_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan


def test_labels_of_deliveries(spark):
    labels = [None, " ", "Pendente", "atrasada!", "Atrasada", "Ent. antecipada", "Contábil", "PENDENTÉ"]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", R.delivery_status(F.lit(None), F.lit(1), "x").alias("done"), R.delivery_status(F.lit(None), F.lit(None), "x").alias("open")).collect()
    assert [(r.done, r.open) for r in got] == [(("CONFERENCIA_MANUAL", "PENDENTE") if i in (0, 1, 2, 3, 7) else ("CONFIRMADO_API", "CONFERENCIA_MANUAL")) for i in range(8)]
    names = ["Depto_ Pessoal", "Departamento_ /pessoal", " dp", "físcal", None, "", "Outro"]
    got = spark.createDataFrame([(x,) for x in names], "x string").select(R.map_department("x", F.lit("Y")).alias("y")).collect()
    assert [r.y for r in got] == ["Y", "DP", "DP", "FISCAL", "Y", "Y", "Y"]


def test_forms_are_computed_once(spark):
    """A regime's payload is read once a row, whatever is taken from it, and regimes, aliases and nested JSON keep their values."""
    labels = ["Lucro Real", "6", "06", "99", "99999999999", " ", None, "filial - simples nacional", "Imune/Isenta", "Comércio", "MEÍ"]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select(R.resolve_regime("x").alias("r")).collect()
    assert [tuple(r.r) for r in got] == [
        ("Lucro Real", None, "LUCRO_REAL", "MAPPED"), ("6", 6, "MEI", "MAPPED"), ("06", 6, "MEI", "MAPPED"), ("99", 99, None, "UNMAPPED"), ("99999999999", None, None, "UNMAPPED"), (None, None, None, "MISSING"), (None, None, None, "MISSING"),
        ("filial - simples nacional", None, "SIMPLES_NACIONAL", "MAPPED"), ("Imune/Isenta", None, "IMUNE_ISENTA", "MAPPED"), ("Comércio", None, None, "UNMAPPED"), ("MEÍ", None, "MEI", "MAPPED"),
    ]
    items = ['{"b": 1, "a": null}', '{"b": {"c": 2}}', '{"c": 1}', "[1]", "no", None, '{"a": "x", "b": "y"}']
    got = spark.createDataFrame([(x,) for x in items], "x string").select(N.pick("x", ["a", "b"]).alias("v")).collect()
    assert [r.v for r in got] == [None, '{"c":2}', None, None, None, None, "x"]
    nested = ['{"a":1}', '"{\\"a\\":1}"', '"[1]"', "[1]", "no", None, '"\\"{}\\""', "{}"]
    got = spark.createDataFrame([(x,) for x in nested], "x string").select(N.parse_maybe_nested_json("x").alias("v")).collect()
    assert [r.v for r in got] == ['{"a":1}', '{"a":1}', None, None, None, None, None, "{}"]
    names = ["Guia já acessada/lida", " não ", "Outra coisa de mais de vinte", " ", None]
    got = spark.createDataFrame([(x,) for x in names], "x string").select(R.guide_read_status("x").alias("v")).collect()
    assert [r.v for r in got] == ["READ", "UNREAD", "Outra coisa de mais ", None, None]
    plan = QUERIES["label_forms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.taxRegime") == 1 and "RepartitionByExpression [event_id" in plan
