"""Obligations and their rules as data, and the merges that bring tables up to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxflow.operators.merge import merge_seed

# Code, name, category, department and sources by priority of each obligation.
OBLIGATIONS = [
    ("DAS", "DAS", "SIMPLES", "FISCAL", ["ACESSORIAS_API", "SITTAX_API", "WATCHER_FILE"]),
    ("DIFAL", "DIFAL", "ESTADUAL", "FISCAL", ["SITTAX_API", "ACESSORIAS_API", "WATCHER_FILE"]),
    ("ICMS", "ICMS", "ESTADUAL", "FISCAL", ["ACESSORIAS_API", "WATCHER_FILE"]),
    ("ISS", "ISS", "MUNICIPAL", "FISCAL", ["ACESSORIAS_API", "WATCHER_FILE"]),
    ("PIS", "PIS", "FEDERAL", "FISCAL", ["ACESSORIAS_API", "WATCHER_FILE"]),
    ("COFINS", "COFINS", "FEDERAL", "FISCAL", ["ACESSORIAS_API", "WATCHER_FILE"]),
    ("PROTEGE", "PROTEGE", "ESTADUAL", "FISCAL", ["WATCHER_FILE", "ACESSORIAS_API"]),
    ("DCTFWEB", "DCTFWeb", "FEDERAL", "COMPARTILHADO", ["DOMINIO_FOLHA", "REINF_API", "FEDERAL_API"]),
    ("REINF", "EFD-Reinf", "FEDERAL", "FISCAL", ["ACESSORIAS_API", "WATCHER_FILE"]),
    ("EFD_CONTRIBUICOES", "EFD Contribuições", "FEDERAL", "FISCAL", ["ACESSORIAS_API", "WATCHER_FILE"]),
    ("DEFIS", "DEFIS", "SIMPLES", "FISCAL", ["ACESSORIAS_API"]),
    ("DASN_SIMEI", "DASN-SIMEI", "MEI", "FISCAL", ["ACESSORIAS_API"]),
    ("PARCELAMENTO", "Parcelamento", "PARCELAMENTO", "FISCAL", ["WATCHER_FILE"]),
]
# Obligation, regime (None: any), type, periodicity, department, authority and final source of each rule.
RULES = [
    ("DAS", "SIMPLES_NACIONAL", "APPLICABILITY", "MONTHLY", "FISCAL", "CGSN", "ACESSORIAS_API"),
    ("DEFIS", "SIMPLES_NACIONAL", "APPLICABILITY", "ANNUAL", "FISCAL", "CGSN", "ACESSORIAS_API"),
    ("DASN_SIMEI", "MEI", "APPLICABILITY", "ANNUAL", "FISCAL", "CGSN", "ACESSORIAS_API"),
    ("DCTFWEB", None, "CONDITIONAL_ORIGIN", "MONTHLY_WHEN_TRIGGERED", None, "RFB", "MANUAL_REVIEW"),
    ("REINF", None, "CONDITIONAL", "MONTHLY_WHEN_TRIGGERED", "FISCAL", "SPED", "ACESSORIAS_API"),
    ("DIFAL", None, "CONDITIONAL", None, "FISCAL", "SEFAZ_GO", "SITTAX_API"),
    ("ICMS", None, "CONDITIONAL", None, "FISCAL", "SEFAZ_GO", "ACESSORIAS_API"),
    ("ISS", None, "CONDITIONAL", None, "FISCAL", "PREFEITURA_ANAPOLIS", "ACESSORIAS_API"),
    ("PIS", "LUCRO_PRESUMIDO", "APPLICABILITY", "MONTHLY", "FISCAL", "RFB", "ACESSORIAS_API"),
    ("PIS", "LUCRO_REAL", "APPLICABILITY", "MONTHLY", "FISCAL", "RFB", "ACESSORIAS_API"),
    ("COFINS", "LUCRO_PRESUMIDO", "APPLICABILITY", "MONTHLY", "FISCAL", "RFB", "ACESSORIAS_API"),
    ("COFINS", "LUCRO_REAL", "APPLICABILITY", "MONTHLY", "FISCAL", "RFB", "ACESSORIAS_API"),
    ("EFD_CONTRIBUICOES", "LUCRO_PRESUMIDO", "APPLICABILITY", "MONTHLY", "FISCAL", "SPED", "ACESSORIAS_API"),
    ("EFD_CONTRIBUICOES", "LUCRO_REAL", "APPLICABILITY", "MONTHLY", "FISCAL", "SPED", "ACESSORIAS_API"),
    ("PROTEGE", None, "CONDITIONAL", None, "FISCAL", "SEFAZ_GO", "MANUAL_REVIEW"),
    ("PARCELAMENTO", None, "ACTIVE_INSTALLMENT", "MONTHLY_WHILE_ACTIVE", "FISCAL", "PGFN", "WATCHER_FILE"),
]


def obligations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBLIGATIONS, "code string, name string, category string, department_default string, source_priority array<string>")


def obligation_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "code string, regime string, rule_type string, periodicity string, department string, authority string, final_source string")


def seed_obligations(target: DataFrame, now: Column, seed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(next, ops): missing obligations are created, others brought up to date and reactivated; more of them stay."""
    seed = obligations(target.sparkSession) if seed is None else seed
    return merge_seed(target, seed, ["code"], [c for c in seed.columns if c != "code"], now)


def seed_rules(target: DataFrame, now: Column, seed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(next, ops): as obligations; of equal rules the first stays, and rules that the data don't have are deleted.

    Only rules of the obligations that the data name are touched.
    """
    seed = obligation_rules(target.sparkSession) if seed is None else seed
    keys = ["code", "regime", "rule_type"]
    named = seed.select("code").distinct()
    after, ops = merge_seed(target.join(named, "code", "left_semi"), seed, keys, [c for c in seed.columns if c not in keys], now, delete_rest=True)
    return after.unionByName(target.join(named, "code", "left_anti").select(*after.columns)), ops


def seed_periods(target: DataFrame, years: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next, ops): the twelve months of each of ``years`` (year), OPEN where they are new; periods that are there stay as they are."""
    months = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    months = months.select("year", "month", F.format_string("%04d-%02d", "year", "month").alias("competencia"))
    new = months.hint("merge").join(target.select("competencia"), "competencia", "left_anti").withColumns({"seed_id": F.lit(None).cast(target.schema["seed_id"].dataType), "status": F.lit("OPEN"), "active": F.lit(True)})
    ops = months.hint("merge").join(target.select("competencia", "seed_id"), "competencia", "left").select("competencia", F.when(F.col("seed_id").isNull(), "CREATED").otherwise("UNCHANGED").alias("op"))
    return target.unionByName(new.select(*target.columns)), ops
