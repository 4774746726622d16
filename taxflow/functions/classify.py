"""Rule classification: fixed lookups and ordered CASE expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxflow.functions import normalize as N
from taxflow.staging import small_side
from taxflow.functions.normalize import col

# Codes and accent-free labels of tax regimes.
REGIME_CODES = {
    1: "SIMPLES_NACIONAL",
    2: "SIMPLES_NACIONAL",
    3: "LUCRO_PRESUMIDO",
    4: "LUCRO_PRESUMIDO",
    5: "LUCRO_REAL",
    6: "MEI",
    10: "IMUNE_ISENTA",
}
REGIME_LABELS = {
    "FILIAL - SIMPLES NACIONAL": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL COM INSCRICAO ESTADUAL": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL SEM INSCRICAO ESTADUAL": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL - COMERCIO E INDUSTRIA": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL - COMERCIO E SERVICO": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL - COMERCIO E SERVICOS": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL - SERVICOS": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL - SERVICOS IMOBILIARIOS": "SIMPLES_NACIONAL",
    "SIMPLES NACIONAL - SERVICOS MEDICOS E ODONTOLOGICOS": "SIMPLES_NACIONAL",
    "LUCRO PRESUMIDO": "LUCRO_PRESUMIDO",
    "LUCRO PRESUMIDO COM INSCRICAO ESTADUAL - INDUSTRIA/COMERCIO": "LUCRO_PRESUMIDO",
    "LUCRO PRESUMIDO SEM INSCRICAO ESTADUAL - SERVICO": "LUCRO_PRESUMIDO",
    "LUCRO PRESUMIDO - COMERCIO E SERVICOS": "LUCRO_PRESUMIDO",
    "LUCRO PRESUMIDO - INDUSTRIA E SERVICOS": "LUCRO_PRESUMIDO",
    "LUCRO PRESUMIDO - SERVICOS": "LUCRO_PRESUMIDO",
    "LUCRO PRESUMIDO - SERVICOS IMOBILIARIOS": "LUCRO_PRESUMIDO",
    "LUCRO PRESUMIDO - SERVICOS MEDICOS E ODONTOLOGICOS": "LUCRO_PRESUMIDO",
    "LUCRO REAL": "LUCRO_REAL",
    "LUCRO REAL - COMERCIO E INDUSTRIA": "LUCRO_REAL",
    "LUCRO REAL - SERVICOS": "LUCRO_REAL",
    "MEI": "MEI",
    "MEI - MICRO EMPREENDEDOR INDIVIDUAL": "MEI",
    "IMUNE/ISENTA": "IMUNE_ISENTA",
    "IMUNE ISENTA": "IMUNE_ISENTA",
    "IMUNE/ISENTA - ISENTA": "IMUNE_ISENTA",
}
REGIMES = ("SIMPLES_NACIONAL", "LUCRO_PRESUMIDO", "LUCRO_REAL", "MEI", "IMUNE_ISENTA")
BRANCH_LABEL = "FILIAL - REGIME NORMAL"
REGISTRY_REGIME_KEYS = ["regime", "regime_tributario", "regimeTributario", "tax_regime", "taxRegime"]
# Names of obligations and their codes.
OBLIGATION_ALIASES = {
    "DAS": "DAS",
    "DIFAL": "DIFAL",
    "ICMS": "ICMS",
    "ISS": "ISS",
    "PIS": "PIS",
    "COFINS": "COFINS",
    "PROTEGE": "PROTEGE",
    "DCTFWEB": "DCTFWEB",
    "REINF": "REINF",
    "EFD REINF": "REINF",
    "EFD-REINF": "REINF",
    "EFD CONTRIBUICOES": "EFD_CONTRIBUICOES",
    "DEFIS": "DEFIS",
    "DASN-SIMEI": "DASN_SIMEI",
    "DASN SIMEI": "DASN_SIMEI",
    "PARCELAMENTO": "PARCELAMENTO",
}
DEPARTMENTS = {"FISCAL": "FISCAL", "DEPARTAMENTO PESSOAL": "DP", "PESSOAL": "DP", "DP": "DP"}
DELIVERED = ("ENTREGUE", "CONFIRMADO_API", "CONFIRMADO_ARQUIVO", "CONFIRMADO_ARQUIVO_ACESSORIAS")
OPEN_LABELS = ("PENDENTE", "ATRASADA!")
READ_LABELS = ("S", "SIM", "GUIA JA ACESSADA/LIDA", "GUIA JA ACESSADA", "LIDA", "ACESSADA")
UNREAD_LABELS = ("N", "NAO", "GUIA NAO ACESSADA/LIDA", "GUIA NAO ACESSADA", "NAO LIDA")
# Whole words of activity descriptions.
ACTIVITY_WORDS = {
    "COMERCIO": ("comercio", "varejista", "atacadista"),
    "INDUSTRIA": ("fabricacao", "industria", "industrializacao"),
    "SERVICOS_MEDICOS_ODONTOLOGICOS": ("medico", "medicina", "odontologia", "odontologico"),
    "SERVICOS_IMOBILIARIOS": ("imobiliario", "imoveis", "corretagem imobiliaria", "administracao de imoveis"),
    "TEMPLO_RELIGIOSO": ("templo", "religiosa", "organizacao religiosa"),
    "SERVICOS": ("servico", "servicos"),
}
# Payroll rubric codes and name parts of each signal.
RUBRIC_CODES = {
    "has_pro_labore": ("100", "9380"),
    "has_autonomous": ("235", "858"),
    "has_inss": ("843", "858", "998", "812", "826", "989", "8092", "8093"),
    "has_fgts": ("23", "32", "35", "813", "996", "8096", "8097", "9637"),
}
EMPLOYEE_CODES = (
    "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "37", "150", "250", "960", "981", "996", "998",
)
RUBRIC_TERMS = {
    "has_pro_labore": ("pro labore",),
    "has_autonomous": ("autonomo",),
    "has_inss": ("inss", "i n s s"),
    "has_fgts": ("fgts", "f g t s"),
    "has_vacation": ("ferias",),
    "has_termination": ("rescisao", "aviso previo", "fgts 40", "saldo de salario", "multa estabilidade"),
    "has_leave": ("afast", "doenca", "acid trabalho", "aposent invalidez", "lic s venc", "carcere"),
}
EMPLOYEE_TERMS = (
    "horas normais",
    "horas extras",
    "salario",
    "adicional noturno",
    "insalubridade",
    "periculosidade",
    "comissoes",
    "gratificacao",
    "ferias",
    "fgts do mes",
    "i n s s",
    "inss",
    "afast",
    "rescisao",
)
NOT_EMPLOYEE_TERMS = ("empregador", "pro labore", "autonomo")


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_part(c: Column, parts) -> Column:
    return any_of(F.contains(c, F.lit(p)) for p in parts)


def delivery_status(finalized, delivered, label) -> Column:
    unsure = F.coalesce(N.upper_ascii(label), F.lit(OPEN_LABELS[0])).isin(*OPEN_LABELS)
    done = col(finalized).isNotNull() | col(delivered).isNotNull()
    return F.when(unsure, F.when(done, "CONFERENCIA_MANUAL").otherwise("PENDENTE")).otherwise(F.when(done, "CONFIRMADO_API").otherwise("CONFERENCIA_MANUAL"))


def guide_read_status(c) -> Column:
    labels = {name: "READ" for name in READ_LABELS} | {name: "UNREAD" for name in UNREAD_LABELS}
    return F.coalesce(F.try_element_at(_lookup(labels), N.upper_ascii(c)), F.left(N.trim_to_null(c), F.lit(20)))


def has_penalty(c) -> Column:
    return F.upper(N.trim_to_null(c)) == "S"


def resolve_regime(c) -> Column:
    """struct(raw, code, canonical, mapping_status MAPPED/UNMAPPED/MISSING) of a code or a label."""
    return N.once(N.trim_to_null(c), _regime)


def _regime(raw: Column) -> Column:
    numeric = raw.rlike("^[0-9]+$")
    code = F.when(numeric, raw.try_cast("int"))
    canonical = F.when(numeric, F.try_element_at(_lookup(REGIME_CODES), code)).otherwise(F.try_element_at(_lookup(REGIME_LABELS), F.upper(N.unaccent(raw))))
    status = lambda x: F.when(x["raw"].isNull(), "MISSING").when(x["canonical"].isNull(), "UNMAPPED").otherwise("MAPPED")
    return N.once(F.struct(raw.alias("raw"), code.alias("code"), canonical.alias("canonical")), lambda x: F.struct(x["raw"].alias("raw"), x["code"].alias("code"), x["canonical"].alias("canonical"), status(x).alias("mapping_status")))


def resolve_registry_regime(payload) -> Column:
    return resolve_regime(N.pick(payload, REGISTRY_REGIME_KEYS))


def obligation_name(c) -> Column:
    return F.nullif(F.trim(F.regexp_replace(N.upper_ascii(c), r"[\s_/]+", " ")), F.lit(""))


def map_obligation(df: DataFrame, name: str, obligations: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds obligation_id, obligation_code, mapping_status (and the obligation's department_default, where there is one): by normalised code, else by alias.

    The obligations are few, so that the rows, whose names are a dozen very common ones, aren't shuffled by them.
    """
    aliases = OBLIGATION_ALIASES if aliases is None else aliases
    more = [c for c in ("department_default",) if c in obligations.columns]
    codes = obligations.groupBy(obligation_name("code").alias("norm_")).agg(F.max_by(F.struct("obligation_id", "code", *more), "obligation_id").alias("exact_"))
    exact = obligations.groupBy(F.col("code").alias("alias_")).agg(F.count(F.lit(1)).alias("n_"), F.min_by(F.struct("obligation_id", *more), "obligation_id").alias("one_"))
    staged = df.withColumn("norm_", obligation_name(name)).withColumn("alias_", F.try_element_at(_lookup(aliases), F.col("norm_")))
    joined = staged.join(small_side(codes), "norm_", "left").join(small_side(exact), "alias_", "left")
    hit, one = F.col("exact_").isNotNull(), F.col("n_") == 1
    return joined.select(
        *[joined[c] for c in df.columns],
        F.when(hit, F.col("exact_.obligation_id")).when(one, F.col("one_.obligation_id")).alias("obligation_id"),
        F.when(hit, F.col("exact_.code")).otherwise(F.col("alias_")).alias("obligation_code"),
        F.when(hit | one, "MAPPED").when(F.col("n_") > 1, "AMBIGUOUS").otherwise("UNMAPPED").alias("mapping_status"),
        *[F.when(hit, F.col(f"exact_.{c}")).when(one, F.col(f"one_.{c}")).alias(c) for c in more],
    )


def unknown_names(mapped: DataFrame, name: str, company: str) -> DataFrame:
    """(name, n, companies) of the rows of ``map_obligation`` that no obligation fits, and how many companies have them."""
    return mapped.where("mapping_status = 'UNMAPPED'").groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(company).alias("companies"))


def map_department(c, default) -> Column:
    return F.coalesce(F.try_element_at(_lookup(DEPARTMENTS), obligation_name(c)), default)


def classify_words(c, table: dict[str, tuple[str, ...]]) -> Column:
    """Sorted classes whose words, as whole words, occur in the search form of the text; none for null."""
    tests = [(k, r"\b(?:" + "|".join(words) + r")\b") for k, words in sorted(table.items())]
    found = N.once(N.search_form(c), lambda form: F.array_compact(F.array(*[F.when(form.rlike(p), F.lit(k)) for k, p in tests])))
    return F.coalesce(found, F.array().cast("array<string>"))


def classify_activity(c) -> Column:
    return classify_words(c, ACTIVITY_WORDS)


def rubric_signals(code, name) -> Column:
    """Sorted signals of a payroll rubric."""
    both = F.struct(F.coalesce(N.search_form(name), F.lit("")).alias("form"), col(code).cast("string").alias("code"))
    return N.once(both, lambda x: signals_of(x["form"], x["code"]))


def signals_of(form: Column, code: Column) -> Column:
    """Sorted signals of a rubric whose name has this search form; most have none, and need no list to be gone through."""
    on = {}
    for signal, parts in RUBRIC_TERMS.items():
        on[signal] = has_part(form, parts) | F.coalesce(code.isin(*RUBRIC_CODES.get(signal, ("",))), F.lit(False))
    on["has_termination"] = on["has_termination"] | form.rlike(r"\b13\b.*\bsalario\b.*\brescisao\b")
    employee = F.when(on["has_vacation"] | on["has_termination"] | on["has_leave"], True).when(on["has_pro_labore"] | on["has_autonomous"], False)
    employee = employee.when(has_part(form, NOT_EMPLOYEE_TERMS), False).when(code.isin(*EMPLOYEE_CODES), True)
    on["has_employee"] = employee.otherwise(has_part(form, EMPLOYEE_TERMS))
    found = F.array_compact(F.array(*[F.when(on[s], F.lit(s)) for s in sorted(on)]))
    return F.when(any_of(on.values()), found).otherwise(F.array().cast("array<string>"))


def factor_r_applicable(explicit, allowed, status, annex, conditional) -> Column:
    """Three-valued: null means that the page doesn't tell."""
    a = col(annex)
    return (
        F.when(col(explicit).isNotNull(), col(explicit))
        .when((col(allowed) == F.lit(False)) | (col(status) == "PROHIBITED"), False)
        .when(a.isNull(), None)
        .when(a == "V", F.coalesce(col(conditional) == "III", F.lit(False)))
        .when(a.isin("I", "II", "III", "IV", "VI") | col(conditional).isNotNull(), False)
    )


def is_delivered(c) -> Column:
    return col(c).isin(*DELIVERED)


def overall_status(obligations, delivered, divergences) -> Column:
    return (
        F.when(col(divergences) > 0, "COM_DIVERGENCIA")
        .when(col(obligations) == 0, "SEM_DADOS")
        .when(col(delivered) >= col(obligations), "ENTREGUE")
        .otherwise("PENDENTE")
    )


def run_status(received, failures, errors, truncated=None, policy: str = "deliveries") -> Column:
    """``deliveries``: nothing received is FAILED; ``registry``: any error is FAILED; ``assessments``: truncated is PARTIAL."""
    bad = (col(failures) > 0) | (col(errors) > 0)
    if policy == "registry":
        return F.when(bad, "FAILED").otherwise("SUCCESS")
    if policy == "assessments":
        return F.when(bad | F.coalesce(col(truncated) if truncated is not None else F.lit(False), F.lit(False)), "PARTIAL").otherwise("SUCCESS")
    return F.when(col(received) == 0, "FAILED").when(bad, "PARTIAL").otherwise("SUCCESS")


def applicable_rules(companies: DataFrame, rules: DataFrame, regimes: tuple[str, ...] = REGIMES) -> DataFrame:
    """Companies with the rules of their regime; a rule that names none counts for each of ``regimes``."""
    general = rules.where("regime IS NULL").withColumn("regime", F.explode(F.array(*[F.lit(r) for r in regimes])))
    return companies.join(small_side(rules.where("regime IS NOT NULL").unionByName(general.select(rules.columns))), "regime")
