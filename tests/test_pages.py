import json
import re

import pytest
from pyspark.sql import functions as F

from taxflow.functions.page_parser import Page
from taxflow.operators import payroll, rule_pages
from taxflow.plans.queries import QUERIES, SQL
from taxflow.sources import assessments, feeds
from taxflow.staging import staged
from tests.oracle import differences


@pytest.mark.parametrize("name", ["payroll_companies", "rule_pages_simples", "map_documents", "map_assessments", "period_range"])
def test_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", name, QUERIES[name], SQL[name]) == ""


def page(number, code, body, cnpj="12.345.678/0001-95", month="05/2026"):
    head = [f"{number}Página:", "RESUMO DA FOLHA", f"Empresa: {code} - EMPRESA X" if code else "", f"CNPJ: {cnpj} Emissão: 29/07/2026", "Cálculo: Folha Mensal Hora: 11:03:59", f"Competência: {month}"]
    return "\n".join([*head, *body, "Sistema licenciado para X"])


MONTH = [
    "Folha Mensal", "PROVENTOS", "HORAS NORMAIS 1 1 220:00 1.670,00", "PRO-LABORE 100 1 220:00 1.621,00", "3.291,00Total:", "DESCONTOS", "I.N.S.S. 998 1 7,78 155,21", "155,21Total:",
    "INFORMATIVA", "F.G.T.S DO MES 996 1 0,00 159,58 *", "159,58Total:", "3.135,79Liquido Geral:",
]


def test_payroll(spark):
    texts = [
        ("Resumo_05-2026.pdf", 1, page("1/1", "0001", MONTH)),
        ("Resumo_06-2026.pdf", 1, "nothing here"),
        ("Resumo_06-2026.pdf", 2, page("1/2", "7", ["Folha Mensal", "PROVENTOS", "EXTRA 5 1 1,00 10,00", "EXTRA 6 1 1,00 90,00 *"])),
        ("Resumo_06-2026.pdf", 3, page("2/2", None, ["10,00Total:", "Comp strange", "5,00Total:", "10,00Líquido Geral:"])),
        ("Resumo_06-2026.pdf", 4, page("1/1", "8", ["Comp 05/2026 - Data pagto 10/05/2026 - Lançamento", "DESCONTOS", "NO CODE 1 x 2,00", "X 9 1 1,00 3,00", "4,00Total:"], cnpj="12.345.678/0001-96")),
        ("empty.pdf", 1, None),
    ]
    out = payroll.parse_report(spark.createDataFrame(texts, "file string, page_no int, text string"))
    found = {r.company_code: r for r in out["companies"].collect()}
    a = found["0001"]
    assert [str(x) for x in (a.gross, a.deductions, a.informational, a.net)] == ["3291.00", "155.21", "159.58", "3135.79"]
    assert (a.payroll, a.assessment, a.confidence, a.cnpj, a.warnings) == ("2026-05", "2026-06", "HIGH", "12345678000195", [])
    assert a.has_employee and a.has_pro_labore and a.has_inss and a.has_fgts and not a.has_vacation
    b = found["7"]
    assert b.pages == [2, 3] and b.confidence == "MEDIUM" and b.warnings == ["SECTION_TOTAL_WITHOUT_SECTION", "UNKNOWN_BLOCK_HEADING"] and str(b.gross) == "10.00"
    c = found["8"]
    assert c.confidence == "LOW" and c.warnings == ["INVALID_CNPJ", "NET_TOTAL_MISSING", "SECTION_TOTAL_MISMATCH"]
    rubrics = out["rubrics"].where("name = 'HORAS NORMAIS'").collect()
    assert len(rubrics) == 1 and rubrics[0].minutes == 13200 and rubrics[0].code == "1"
    blocks = {r.block_type: r for r in out["blocks"].collect()}
    assert str(blocks["PAYMENT_ENTRY"].payment_date) == "2026-05-10" and blocks["PAYMENT_ENTRY"].source_competence == "2026-05"
    reports = {r.file: r for r in out["reports"].collect()}
    assert reports["Resumo_05-2026.pdf"].warnings == [] and reports["Resumo_06-2026.pdf"].warnings == ["FILE_NAME_COMPETENCE_MISMATCH"] and reports["empty.pdf"].warnings == ["TEXT_LAYER_MISSING"]
    assert out["warnings"].where("code = 'COMPANY_HEADER_INCOMPLETE'").count() == 3


def test_rule_pages(spark):
    table = '<table class="tabelaResultados"><tr><td>Obrigacao</td></tr><tr><td><p>DCTFWeb</p></td><td>-</td></tr><tr style="display: none;"><td>a</td><td>b</td></tr><tr><td>e-Social</td><td>-</td></tr></table>'
    search = '<table class="tabela-busca"><tr><td>CNAE</td><td>Descricao</td></tr><tr><td><label><input name="idcnae" value="99"/>0000-0/01</label></td><td><label>UMA &amp; OUTRA</label></td></tr></table>'
    rows = {
        "search": search,
        "detail": '<div data-econet-id="99">CNAE: 0000-0/01 Descricao: Comércio varejista</div>',
        "presumed": "<p>Lucro Presumido: possibilidade. IRPJ: 8,00% CSLL: 12%</p>",
        "actual_quarter": "Lucro Real: nao obrigatoria",
        "actual_estimate": "Lucro Real: sem inferencia automatica",
        "simples": "Simples Nacional <p>Anexo V.</p><p>Sujeito ao Fator R.</p><p>Anexo III quando o Fator R for igual ou superior a 28,00%.</p>",
        "mei": "MEI: possivel o enquadramento. Ocupacao correspondente: Vendedor.",
        "tabs": 'PJ em Geral<b class="grupo-obrigacoes">PJ em Geral</b><b class="grupo-obrigacoes">Optante SIMEI</b>',
        "obligations_general": "PJ em Geral" + table,
        "obligations_simples": "Simples Nacional",
        "obligations_simei": "Microempreendedor Individual: nao e possivel o enquadramento como microempreendedor individual",
    }
    data = [("k", kind, html) for kind, html in rows.items()] + [("e", "mei", None), ("l", "mei", "MEI senha"), ("c", "mei", "MEI captcha"), ("m", "mei", "other")]
    texts = rule_pages.page_texts(spark.createDataFrame(data, "page_key string, kind string, html string"))
    assert {r.page_key: r.gate for r in texts.where("page_key <> 'k'").collect()} == {"e": "EMPTY", "l": "LOGIN", "c": "CAPTCHA", "m": "MARKER_MISSING"}
    hit = rule_pages.search_results(texts).collect()
    assert [(h.activity_id, h.cnae, h.description, h.errors) for h in hit] == [("99", "0000001", "UMA & OUTRA", [])]
    assert rule_pages.obligation_tabs(texts).first().groups == ["PJ em Geral", "Optante SIMEI"]
    r = rule_pages.attach_activity(rule_pages.normalized_rules(texts)).where("page_key = 'k'").first()
    assert (r.cnae, r.activity_id, r.description, r.activity_types) == ("0000001", "99", "Comércio varejista", ["COMERCIO"])
    assert (r.simples.status, r.simples.annex_default, r.simples.annex_conditional, r.simples.factor_r, str(r.simples.factor_r_threshold)) == ("ALLOWED", "V", "III", True, "28.00")
    assert str(r.presumed_profit.irpj_rate) == "8.00" and str(r.presumed_profit.csll_rate) == "12.00" and r.mei.occupation == "Vendedor"
    assert (r.actual_profit_status, r.actual_profit_mandatory) == ("NOT_MANDATORY", False)
    assert [(x.name, x.mapped_code) for x in r.obligations_general["items"]] == [("DCTFWeb", "DCTFWEB"), ("e-Social", None)] and r.unmapped_obligations == ["e-Social"]
    others = {x.page_key: (x.parse_status, x.parse_errors, x.content_hash) for x in rule_pages.normalized_rules(texts).where("page_key <> 'k'").collect()}
    assert others == {k: ("PARSE_ERROR", [f"mei:{gate}", "detail:MISSING"], None) for k, gate in (("e", "EMPTY"), ("l", "LOGIN"), ("c", "CAPTCHA"), ("m", "MARKER_MISSING"))}
    assert r.obligations_simples.status == "EMPTY" and r.obligations_simei.status == "REGIME_NOT_ALLOWED" and len(r.content_hash) == 64


def test_mappers(spark):
    def frame(*items):
        return spark.createDataFrame([(json.dumps(i),) for i in items], "item string")

    tasks = assessments.map_task(frame({"guid": "g", "titulo": "T", "nomeArquivo": "a.PDF", "extensaoArquivo": 3, "status": 2, "periodo": "05/2026"}, {"titulo": "T"})).collect()
    assert (tasks[0].source_task_key, tasks[0].file_extension, tasks[0].file_extension_code, tasks[0].period, tasks[0].status_code) == ("g", ".pdf", 3, "2026-05", 2)
    assert len(tasks[1].source_task_key) == 32 and tasks[1].errors == []
    d = assessments.map_difal(frame({"sucesso": True, "difal": {"possuiGuia": True, "valorGuiaRevenda": 10.5, "totalGuiaUsoConsumoImobilizado": "1.000,00", "valorGuiaRevendaUtilizandoCredito": 0, "numeroDareGuiaRevenda": "9"}}, {"sucesso": False}).withColumnRenamed("item", "body")).collect()
    assert str(d[0].total_amount) == "1010.50" and str(d[0].resale_amount) == "10.50" and d[0].dare_numbers == ["9"] and d[0].errors == [] and d[1].errors == ["rejected", "difal"]
    c = assessments.map_assessment_company(frame({"id": 1, "cnpj": "11.222.333/0001-81", "nome": "X", "homologada": True}, {"id": 2, "cnpj": "1", "nome": "Y"})).collect()
    assert (c[0].status, c[0].errors) == ("HOMOLOGADA", []) and c[1].errors == ["cnpj"]
    n = assessments.map_nfse(frame({"source_layout": "NFSE_ABRASF_204", "document_key": "k", "service_period": "2026-05", "service_amount": "1000.00", "cancellation": {"cancelled": True}}, {})).collect()
    assert n[0].cancelled and n[0].errors == [] and len(n[1].errors) == 4
    empty = frame().select(F.col("item"))
    assert assessments.map_document(empty, "ENTRADA").count() == 0


def test_page_parser():
    """Nested tables, spans, tags that aren't closed, and silent parts."""
    p = Page('<!DOCTYPE html><script>var x = "<td>no</td>"</script><style>no</style><table class="a b"><tr><td rowspan="2">1<td colspan=2>2<table class=in><tr><th>h<td>x &amp; y</table>tail<tr><td>3</td><td>4</table><p>after')
    assert p.text == "1 2 h x & y tail 3 4 after"
    assert [(t["classes"], [r["cells"] for r in t["rows"]]) for t in p.tables] == [("in", [["x & y"]]), ("a b", [["1", "2 h x & y tail", ""], ["", "3", "4"]])]
    p = Page('<div class="titulo_tabela_capa">0000-0/01 - <b>One</b></div> two<br>three <b class="grupo-obrigacoes">G <b>h</b></b><i data-econet-id="7">')
    assert (p.title, p.groups, p.activity_id) == ("0000-0/01 - One two", ["G h"], "7")
    assert Page("").tables == [] and len(Page('<table><tr><td colspan="99999">x').tables[0]["rows"][0]["cells"]) == 100
    assert len(Page("<table>" * 3000 + "<tr><td>x").tables) == 3000


def test_pages_are_read_once_for_all_entries(spark):
    """The page isn't parsed again for each of its entries: nothing reads its JSON after the entries are listed."""
    page = json.dumps({"sucesso": True, "empresas": [{"id": 1}, 7, {"id": 2}]})
    bodies = spark.createDataFrame([("a", page), ("b", '{"sucesso": false}'), ("c", '{"sucesso": true}'), ("d", None)], "file string, body string")
    items, failures = feeds.assessment_company_items(bodies)
    for df in (items, failures):
        after = df._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
        assert "get_json_object" not in after and "json_tuple" not in after
    assert [(r.file, r.item_no, r.item) for r in items.orderBy("item_no").collect()] == [("a", 0, '{"id":1}'), ("a", 2, '{"id":2}')]
    assert sorted((r.file, r.reason, r.item) for r in failures.collect() if r.file == "a") == [("a", "entry", "7")]
    assert sorted((r.file, r.reason) for r in failures.collect() if r.file != "a") == [("b", "sucesso"), ("c", "empresas"), ("d", "sucesso")]


def test_replies_are_parsed_once(spark):
    """One parse gives all members of a JSON object, and names that differ by capitals alone stay apart."""
    reply = {"ok": True, "data": {"periodoFiscal": "05/2026", "empresasApuracao": [{"nome": "none"}, {"cnpj": "1", "nome": "a"}, {"cnpj": "2", "nome": "b", "tributaIcms": None, "tributaICMS": True, "tributaISS": False}], "folhas": [{"a": 1}, 5]}}
    rows = [(1, "2", "2026-05", json.dumps(reply)), (2, "9", "2026-05", json.dumps(reply)), (3, "2", "2026-05", '{"ok": true, "data": {"empresaCnpj": "2", "tributaPisCofins": true}}'), (4, "2", "2026-05", "broken"), (5, "2", "2026-05", None)]
    replies = spark.createDataFrame(rows, "k long, requested_cnpj string, requested_period string, body string")
    out = assessments.map_assessment(replies, keep=("k",))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"get_json_object\((body|data|company)#", plan) and plan.count("json_tuple") == 3
    r = {x.k: x for x in out.collect()}
    assert (r[1].confirmed_cnpj, r[1].company_name, r[1].taxes_icms, r[1].taxes_iss, r[1].payrolls, len(r[1].companies), r[1].errors) == ("2", "b", True, False, ['{"a":1}'], 3, [])
    assert (r[2].confirmed_cnpj, r[2].company_name, r[2].errors) == ("1", "none", ["company"])
    assert (r[3].confirmed_cnpj, r[3].taxes_pis_cofins, r[3].errors) == ("2", True, ["period"])
    assert r[4].errors == r[5].errors == ["rejected", "data", "period"]
    plan = assessments.map_difal(replies.select("k", "body"))._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("json_tuple") == 2


def test_equal_pages_are_parsed_once(monkeypatch):
    """Of equal pages of a batch one is parsed, and each row has its own page's result; a page that isn't there is an empty one."""
    import pyarrow as pa

    pages = ["<b>x</b>", None, "<b>y</b>", "<b>x</b>", "", '<table class="t"><tr><td>1', "<b>x</b>", '<table class="t"><tr><td>1']
    parsed = []

    class Counted(Page):
        def __init__(self, html):
            parsed.append(html)
            super().__init__(html)

    monkeypatch.setattr(rule_pages, "Page", Counted)
    got = rule_pages.parse_page.func(pa.array(pages, pa.string())).to_pylist()
    assert len(parsed) == len(set(parsed)) == 4
    for html, row in zip(pages, got):
        p = Page(html or "")
        assert (row["text"], row["tables"], row["title"], row["groups"], row["activity_id"]) == (p.text, p.tables, p.title, p.groups, p.activity_id)
    assert rule_pages.parse_page.func(pa.array([], pa.string())).to_pylist() == []


def test_rubric_lines_are_read_once(spark):
    """The parts of a rubric line are told with the lines, which are written, and not again for the rubrics."""
    text = "1/1Página:\nEmpresa: 7 - X\nCompetência: 05/2026\nFolha Mensal\nPROVENTOS\nSALARIO 1000 1 10:30 1.234,56\nother line\n1.234,56Total:"
    pages = spark.createDataFrame([("f", 1, text)], "file string, page_no int, text string")
    lines = payroll.body_lines(payroll.group_pages(payroll.page_headers(pages)))
    assert [(r.line, r.rubric.value) for r in lines.where("rubric IS NOT NULL").collect()] == [("SALARIO 1000 1 10:30 1.234,56", "1.234,56")]
    given = spark.createDataFrame(lines.collect(), lines.schema)
    found = payroll.rubrics(given)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "endswith(line" not in plan.lower()
    assert [(r.code, r.name, str(r.calculated), r.minutes) for r in found.collect()] == [("1000", "SALARIO", "1234.56", 630)]


def test_report_is_read_in_one_pass(spark, monkeypatch):
    """The text of the pages is dealt out by file once, and nothing that is read from it: lines are numbered where they lie; later parts read what was written."""
    plans = {}

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        return staged(df, label)

    monkeypatch.setattr(payroll, "staged", kept)
    texts = [("a_05-2026.pdf", 2, page("1/1", None, ["1,00Total:", "Comp X 12 1 2,00 3,00"])), ("a_05-2026.pdf", 1, page("1/1", "7", MONTH).replace("\n", " \r\n\t")), ("b.pdf", 1, None), ("b.pdf", 2, page("1/1", "9", []))]
    pages = spark.createDataFrame(texts, "file string, page_no int, text string")
    out = payroll.parse_report(pages)
    logical, physical = plans["payroll-parts"]
    assert "Join" not in logical and physical.count("Exchange") == 1
    for label in ("payroll-companies", "payroll-reports"):
        assert "split(" not in plans[label][0] and "regexp_extract(text" not in plans[label][0]
    a, b = (next(r for r in out["companies"].collect() if r.company_code == c) for c in ("7", "9"))
    assert (a.pages, a.n_rubrics, str(a.gross), a.warnings) == ([1, 2], 5, "3291.00", ["DECLARED_PAGE_SEQUENCE_MISMATCH", "SECTION_TOTAL_MISMATCH"])
    assert (b.pages, b.n_rubrics, b.n_blocks, b.warnings) == ([2], 0, 0, ["CONTINUATION_PAGE_EMPTY", "NET_TOTAL_MISSING"])
    assert [(r.line_no, r.code) for r in out["rubrics"].orderBy("file", "page_no", "line_no").collect()] == [(2, "1"), (3, "100"), (6, "998"), (9, "996"), (1, "12")]
    assert {r.file: (r.n_pages, r.n_companies) for r in out["reports"].collect()} == {"a_05-2026.pdf": (2, 1), "b.pdf": (2, 1)}
