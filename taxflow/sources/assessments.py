"""Feed mappers for assessments: companies, assessments, DIFAL, fiscal documents, tasks, service invoices.

Each takes a frame with the landed JSON as text in one column and returns typed
columns, plus ``errors`` that names what makes a row unusable.  Nothing is dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxflow.functions import normalize as N
from taxflow.sources.feeds import place

# Service invoice layouts.
NFSE_LAYOUTS = ("NFSE_ABRASF_204", "NFSE_NACIONAL_101")
DIRECTIONS = ("ENTRADA", "SAIDA")
# Fixed names: amounts, taxes and CFOP blocks of an assessment, and the members of its reply and of one of its companies that are read.
MONEY = {
    "net_revenue": "receitaLiquida", "product_revenue": "receitaProdutos", "service_revenue": "receitaServicos", "return_revenue": "receitaDevolucao",
    "rbt12": "rbt12", "rba": "rba", "das_amount": "valorDas", "das_xml_amount": "valorDasXml", "factor_r_percent": "percentualFatorR",
}
TAXES = {f"{name}": (f"empresaTributa{a}", f"tributa{a}", f"tributa{b}") for name, a, b in (("icms", "Icms", "ICMS"), ("iss", "Iss", "ISS"), ("ipi", "Ipi", "IPI"), ("pis_cofins", "PisCofins", "PISCOFINS"))}
CFOP_LISTS = ("resumoPorCfop", "resumoPorCfopSittax", "resumoPorCfopXml")
_TAX_MEMBERS = tuple(name for names in TAXES.values() for name in names)
DATA_MEMBERS = (
    "id", "empresasApuracao", "empresasDaApuracao", "empresaCnpj", "empresaNome", "escritorioNome", "periodoFiscal", "folhas", "folhasDePagamento", "folhaDePagamentos", "dataHoraTransmissao", "tipoDaTransmissao", "emTransmissao",
    "numeroDas", "numeroDeclaracao", "numeroExtrato", *MONEY.values(), "resumosTributacaoSittax", "mensagens", "inconsistencias", "relatorioDeConferenciaSittax", *_TAX_MEMBERS,
)
COMPANY_MEMBERS = ("nome", "empresaTemFolha", "atividades", *CFOP_LISTS, *_TAX_MEMBERS)
DIFAL_MEMBERS = (
    "id", "possuiGuia", "numeroDareGuiaRevenda", "numeroDareGuiaUsoConsumoImobilizado", "valorGuiaRevenda", "totalGuiaUsoConsumoImobilizado", "totalGuiaIndustrializacao", "valorGuiaRevendaUtilizandoCredito",
    "valorGuiaUsoConsumoImobilizadoUtilizandoCredito", "totalTodasCompras", "dataFechamento", "dataTransmissao", "temNotasComReferenciaSemTipo", "creditos",
)


def _raw(json: str, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def _text(json: str, path: str) -> Column:
    return N.trim_to_null(_raw(json, path))


def _bool(json: str, *paths: str) -> Column:
    return N.first_bool(*[_raw(json, p) for p in paths])


def _money(json: str, path: str) -> Column:
    return N.parse_decimal_mixed(_raw(json, path))


def _list(c: Column) -> Column:
    """Elements, as JSON text, of a JSON list; none for anything else."""
    return F.coalesce(F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")), F.array().cast("array<string>"))


def _objects(c: Column) -> Column:
    return F.filter(_list(c), lambda x: F.ltrim(x).startswith("{"))


def _members(df: DataFrame, json: str, *names: str) -> DataFrame:
    """Adds the text of each member of the JSON object in a column, which is parsed once for all of them."""
    return df.select("*", F.json_tuple(json, *names).alias(*[_name(json, n) for n in names]))


def _name(json: str, name: str) -> str:
    """Column of a member; capitals are marked, since names that differ by them alone would be one to Spark."""
    return f"{json}:" + re.sub("([A-Z])", r"^\1", name)


def _member(json: str, name: str) -> Column:
    return F.col(_name(json, name))


def _period_of(value: Column) -> Column:
    """A period given as text, or as an object with its first day."""
    day = F.coalesce(F.get_json_object(value, "$.dataInicial"), F.get_json_object(value, "$.dataFinal"))
    return F.when(F.ltrim(value).startswith("{"), F.date_format(N.parse_datetime(day), "yyyy-MM")).otherwise(N.period_reference(value))


def _errors(**rules: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))


def map_assessment_company(df: DataFrame, item: str = "item") -> DataFrame:
    """Companies; only CNPJs of 14 digits are good."""
    out = df.select(
        _text(item, "id").alias("external_id"), N.normalize_cnpj(_raw(item, "cnpj")).alias("cnpj"), _text(item, "nome").alias("legal_name"),
        _text(item, "fantasia").alias("trade_name"), _text(item, "inscricaoEstadual").alias("state_registration"), _text(item, "uf").alias("state"),
        N.homologation_status(_bool(item, "homologada")).alias("status"), _bool(item, "homologada").alias("homologated"), _bool(item, "usaRegimeDeCaixa").alias("cash_regime"), *place(df),
    )
    return out.withColumn(
        "errors", _errors(cnpj=F.col("cnpj").isNull() | ~F.col("cnpj").rlike("^[0-9]{14}$"), external_id=F.col("external_id").isNull(), legal_name=F.col("legal_name").isNull())
    )


def map_assessment(df: DataFrame, body: str = "body", cnpj: str = "requested_cnpj", period: str = "requested_period", keep: tuple[str, ...] = ()) -> DataFrame:
    """Assessments of a requested company and period; a reply about another one has the error ``company`` or ``period``.

    Columns in ``keep`` are carried along.
    """
    cnpj, period = F.col(cnpj).alias("requested_cnpj"), F.col(period).alias("requested_period")
    own = _members(df.select(*keep, cnpj, period, F.col(body).alias("body")), "body", "ok", "data").withColumnRenamed(_name("body", "data"), "data")
    own = _members(own, "data", *DATA_MEMBERS).withColumns({_name("data", n): _objects(_member("data", n)) for n in ("folhas", "folhasDePagamento")})
    of_data, of_company = (lambda n: _member("data", n)), (lambda n: _member("company", n))
    listed = _objects(of_data("empresasApuracao"))
    own = own.withColumn("companies", F.when(F.size(listed) > 0, listed).otherwise(_objects(of_data("empresasDaApuracao"))))
    # The number of each company is read once, no number as an empty one; below, companies are told by their numbers.
    own = own.withColumn("numbers_", F.transform("companies", lambda x: F.get_json_object(x, "$.cnpj")))
    own = own.withColumn("numbers_", F.transform("numbers_", lambda x: F.coalesce(N.normalize_cnpj(x), F.lit(""))))
    asked = F.when(F.array_contains("numbers_", F.nullif(F.col("requested_cnpj"), F.lit(""))), F.col("requested_cnpj"))
    own = own.withColumn("confirmed_cnpj", F.coalesce(N.normalize_cnpj(of_data("empresaCnpj")), asked))
    at = F.array_position("numbers_", F.coalesce("confirmed_cnpj", F.lit(""))).cast("int")
    own = _members(own.withColumn("company", F.get("companies", at - 1)), "company", *COMPANY_MEMBERS)
    own = own.withColumn("confirmed_cnpj", F.coalesce("confirmed_cnpj", F.get(F.array_remove("numbers_", ""), 0)))
    flag = lambda name, c: F.array(F.to_json(F.struct(c.alias(name))))
    own = own.withColumns({"own_payroll_": N.first_bool(of_company("empresaTemFolha")), "any_payroll_": N.first_bool(of_data("folhaDePagamentos")), "payrolls_": F.concat(of_data("folhas"), of_data("folhasDePagamento"))})
    payrolls = (
        F.when(F.size("payrolls_") > 0, F.col("payrolls_"))
        .when(F.col("own_payroll_").isNotNull(), flag("empresaTemFolha", F.col("own_payroll_")))
        .when(F.col("any_payroll_").isNotNull(), flag("folhaDePagamentos", F.col("any_payroll_")))
        .otherwise(F.array().cast("array<string>"))
    )
    activities = F.filter(F.transform(_list(of_company("atividades")), N.trim_to_null), lambda x: x.isNotNull())
    risks = of_data("relatorioDeConferenciaSittax")
    text = lambda name: N.trim_to_null(of_data(name))
    at, kind = N.parse_datetime(of_data("dataHoraTransmissao")), text("tipoDaTransmissao")
    # What is taxed stands with the company, or with the data of a reply that lists no such company.
    taxed = lambda n: F.when(F.col("company").isNotNull(), of_company(n)).otherwise(of_data(n))
    out = own.select(
        *keep, "requested_cnpj", "requested_period", "confirmed_cnpj", _period_of(of_data("periodoFiscal")).alias("confirmed_period"),
        N.assessment_id(of_data("id"), "requested_cnpj", "requested_period").alias("assessment_id"),
        text("escritorioNome").alias("office_name"), F.coalesce(text("empresaNome"), N.trim_to_null(of_company("nome"))).alias("company_name"),
        N.is_transmitted(at, kind).alias("is_transmitted"), N.first_bool(of_data("emTransmissao")).alias("transmission_in_progress"), at.alias("transmitted_at"), kind.alias("transmission_type"),
        text("numeroDas").alias("das_number"), text("numeroDeclaracao").alias("declaration_number"), text("numeroExtrato").alias("statement_number"),
        *[N.parse_decimal_mixed(of_data(path)).alias(name) for name, path in MONEY.items()],
        F.coalesce("any_payroll_", "own_payroll_").alias("company_has_payroll"),
        *[N.first_bool(*map(taxed, names)).alias(f"taxes_{name}") for name, names in TAXES.items()],
        "companies", _objects(of_data("resumosTributacaoSittax")).alias("annexes"), F.concat(*[_objects(of_company(k)) for k in CFOP_LISTS]).alias("cfops"),
        activities.alias("activities"), payrolls.alias("payrolls"), _list(of_data("mensagens")).alias("alerts"), _list(of_data("inconsistencias")).alias("inconsistencies"),
        F.when(F.ltrim(risks).startswith("{"), F.array(risks)).otherwise(_list(risks)).alias("risks"),
        (~F.coalesce(N.first_bool(_member("body", "ok")), F.lit(False))).alias("rejected_"), (~F.coalesce(F.ltrim("data").startswith("{"), F.lit(False))).alias("no_data_"),
    )
    wrong_company = F.col("confirmed_cnpj").isNotNull() & (F.col("confirmed_cnpj") != F.col("requested_cnpj"))
    errors = _errors(rejected=F.col("rejected_"), data=F.col("no_data_"), company=wrong_company, period=~F.col("confirmed_period").eqNullSafe(F.col("requested_period")))
    return out.withColumn("errors", errors).drop("rejected_", "no_data_")


def map_difal(df: DataFrame, body: str = "body") -> DataFrame:
    """DIFAL replies; a credit amount that is there and not zero comes before the plain one."""
    keep = [c for c in df.columns if c != body]
    own = _members(_members(df.select(*keep, F.col(body).alias("body")), "body", "sucesso", "mensagem", "difal").withColumnRenamed(_name("body", "difal"), "difal"), "difal", *DIFAL_MEMBERS)
    raw = lambda name: _member("difal", name)
    text = lambda name: N.trim_to_null(raw(name))
    # Each amount is read once, whichever of the results it goes into.
    amounts = ("valorGuiaRevenda", "totalGuiaUsoConsumoImobilizado", "totalGuiaIndustrializacao", "valorGuiaRevendaUtilizandoCredito", "valorGuiaUsoConsumoImobilizadoUtilizandoCredito", "totalTodasCompras")
    own = own.withColumns({_name("difal", name): N.parse_decimal_mixed(raw(name)) for name in amounts})
    total = [F.coalesce(raw(p), F.lit(0)) for p in ("valorGuiaRevenda", "totalGuiaUsoConsumoImobilizado", "totalGuiaIndustrializacao")]
    either = lambda a, b: F.coalesce(F.nullif(raw(a), F.lit(0)), raw(b))
    return own.select(
        *keep, F.coalesce(text("id"), F.lit("difal")).alias("difal_id"), N.first_bool(raw("possuiGuia")).alias("has_guide"),
        F.array_compact(F.array(text("numeroDareGuiaRevenda"), text("numeroDareGuiaUsoConsumoImobilizado"))).alias("dare_numbers"),
        sum(total[1:], total[0]).cast("decimal(14,2)").alias("total_amount"), either("valorGuiaRevendaUtilizandoCredito", "valorGuiaRevenda").alias("resale_amount"),
        either("valorGuiaUsoConsumoImobilizadoUtilizandoCredito", "totalGuiaUsoConsumoImobilizado").alias("use_consumption_amount"), raw("totalTodasCompras").alias("total_purchases"),
        N.parse_datetime(raw("dataFechamento")).alias("closed_at"), N.parse_datetime(raw("dataTransmissao")).alias("transmitted_at"), N.trim_to_null(_member("body", "mensagem")).alias("message"),
        N.first_bool(raw("temNotasComReferenciaSemTipo")).alias("notes_without_type"), _list(raw("creditos")).alias("inconsistencies"),
        _errors(rejected=~F.coalesce(N.first_bool(_member("body", "sucesso")), F.lit(False)), difal=~F.coalesce(F.ltrim("difal").startswith("{"), F.lit(False))).alias("errors"),
    )


def map_document(df: DataFrame, direction: str, item: str = "item") -> DataFrame:
    """Fiscal documents of one direction; the key is the id, else the access key, else a hash of what identifies it."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    issued, period = N.parse_datetime(_raw(item, "data_emissao")), N.period_reference(_raw(item, "data_competencia"))
    issued_text = F.coalesce(_text(item, "data_emissao"), F.lit(""))
    party = F.coalesce(_text(item, "emitente_nome"), _text(item, "destinatario_nome"))
    parts = [F.lit(direction), period, _text(item, "numero"), _text(item, "modelo"), issued_text, _text(item, "status"), party]
    cfops = F.when(F.ltrim(_raw(item, "cfops")).startswith("["), F.filter(F.transform(_list(_raw(item, "cfops")), N.trim_to_null), lambda x: x.isNotNull())).otherwise(N.string_list(_raw(item, "cfops")))
    keep = [c for c in df.columns if c != item]
    return df.select(
        *keep, N.surrogate_key([_raw(item, "id"), _raw(item, "chave_acesso")], parts).alias("source_document_key"), F.lit(direction).alias("direction"),
        _text(item, "id").alias("external_id"), _text(item, "chave_acesso").alias("access_key"), _text(item, "modelo").alias("model"), _text(item, "numero").alias("number"), _text(item, "status").alias("status"),
        issued.alias("issued_at"), N.parse_datetime(_raw(item, "data_entrada")).alias("entered_at"), period.alias("period"),
        _text(item, "emitente_nome").alias("issuer_name"), _text(item, "emitente_uf").alias("issuer_state"), _text(item, "emitente_cpf_cnpj").alias("issuer_document"),
        _text(item, "destinatario_nome").alias("recipient_name"), _text(item, "destinatario_uf").alias("recipient_state"),
        F.coalesce(cfops, F.array().cast("array<string>")).alias("cfops"), _money(item, "valor_total").alias("total_amount"), _text(item, "tipo_importacao").alias("import_source"),
        _bool(item, "importada").alias("imported"), _bool(item, "tem_xml").alias("has_xml"), _errors(period=period.isNull()).alias("errors"),
    )


def map_task(df: DataFrame, item: str = "item") -> DataFrame:
    """Tasks; the key is the id, else the guid, else a hash; the file extension comes from its field or the file name."""
    asked = _text(item, "periodo")
    period, name = N.period_reference(asked), _text(item, "titulo")
    key = N.surrogate_key([_raw(item, "id"), _raw(item, "guid")], [name, period, _text(item, "nomeEmpresa"), _text(item, "dataCriacao")])
    extension = F.when(~_text(item, "extensaoArquivo").rlike(r"^\d+$"), _raw(item, "extensaoArquivo"))
    keep = [c for c in df.columns if c != item]
    return df.select(
        *keep, key.alias("source_task_key"), _text(item, "id").alias("external_id"), F.coalesce(_text(item, "tipo"), _text(item, "tipoNome"), name).alias("task_type"), name.alias("task_name"),
        _text(item, "descricaoString").alias("description"), _text(item, "nomeEmpresa").alias("company_name"), N.normalize_cnpj(_raw(item, "empresaCnpj")).alias("company_cnpj"), period.alias("period"),
        N.parse_datetime(_raw(item, "dataCriacao")).alias("created_at"), N.parse_datetime(_raw(item, "dataFimProcessamento")).alias("finished_at"),
        _text(item, "usuarioId").alias("user_id"), _text(item, "usuarioNome").alias("user_name"), _text(item, "status").alias("status"), N.parse_int(_raw(item, "status")).alias("status_code"),
        _bool(item, "possuiArquivo").alias("has_file"), _text(item, "nomeArquivo").alias("file_name"), N.file_extension(extension, _text(item, "nomeArquivo")).alias("file_extension"),
        N.parse_int(_raw(item, "extensaoArquivo")).alias("file_extension_code"), _money(item, "tempoProcessamento").alias("seconds"), _errors(period=asked.isNotNull() & period.isNull()).alias("errors"),
    )


def map_nfse(df: DataFrame, item: str = "item") -> DataFrame:
    """Service invoices in one of two layouts, with provider, taker and cancellation."""
    out = df.select(
        _text(item, "source_layout").alias("source_layout"), _text(item, "document_key").alias("document_key"), N.parse_datetime(_raw(item, "issued_at")).alias("issued_at"),
        _text(item, "service_period").alias("service_period"), _money(item, "service_amount").alias("service_amount"), N.normalize_cnae(_raw(item, "cnae")).alias("cnae"),
        _text(item, "municipal_tax_code").alias("municipal_tax_code"), _text(item, "municipal_tax_description").alias("municipal_tax_description"),
        *[_text(item, f"{who}.{what}").alias(f"{who}_{what}") for who in ("provider", "taker") for what in ("document", "name")],
        F.coalesce(_bool(item, "cancellation.cancelled"), F.lit(False)).alias("cancelled"), _text(item, "cancellation.substituted_by_key").alias("substituted_by_key"),
    )
    return out.withColumn(
        "errors",
        _errors(
            source_layout=~F.coalesce(F.col("source_layout").isin(*NFSE_LAYOUTS), F.lit(False)), document_key=F.col("document_key").isNull(),
            service_period=~F.coalesce(F.col("service_period").rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$"), F.lit(False)), service_amount=F.col("service_amount").isNull(),
        ),
    )
