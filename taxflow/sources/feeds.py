"""Landed feeds: JSON envelopes, pages by period, file manifests, and the run ledger."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taxflow.functions import classify as R
from taxflow.functions import normalize as N
from taxflow.operators.ordering import latest_per_key
from taxflow.sources.elements import read_elements

COMPANY_LISTS = ("items", "results", "companies", "data")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(file, body): one row a file, the JSON as text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))


def explode_list(df: DataFrame, body: str, names: tuple[str, ...]) -> DataFrame:
    """A row (item_no, item: JSON text) for each element of a JSON list, or of the first of ``names`` that the object has."""
    listed = F.when(F.ltrim(F.col(body)).startswith("["), F.col(body)).otherwise(F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in names]))
    items = F.from_json(listed, "array<string>")
    return df.select(*[c for c in df.columns if c != body], F.posexplode_outer(items).alias("item_no", "item"))


def place(df: DataFrame) -> list[Column]:
    """``order_``, the place of a row in the input (file, block and item, as far as ``df`` has them), or none of these columns."""
    known = [c for c in ("period", "file", "block_no", "item_no") if c in df.columns]
    return [F.col("order_")] if "order_" in df.columns else [F.struct(*known).alias("order_")] if "item_no" in known else []


def read_company_feed(spark: SparkSession, path: str) -> DataFrame:
    """(file, item_no, item) of the companies in landed files of any size; ``feed_errors`` tells of files that can't be read to their end."""
    return _with_file(read_elements(spark, path, COMPANY_LISTS)).where("item IS NOT NULL").select("file", "item_no", "item")


def feed_errors(spark: SparkSession, path: str, names: tuple[str, ...] = COMPANY_LISTS) -> DataFrame:
    """(file, error) of landed files that are broken, end early or have no list."""
    return _with_file(read_elements(spark, path, names)).where("error IS NOT NULL").select("file", "error")


def _with_file(elements: DataFrame) -> DataFrame:
    return elements.withColumn("file", F.url_decode(F.element_at(F.split("path", "/"), -1)))


def map_registry_company(df: DataFrame) -> DataFrame:
    """Typed registry companies from ``item``; ``errors`` names missing fields."""
    pick = lambda *names: N.trim_to_null(N.pick("item", list(names)))
    out = df.select(
        pick("id").alias("external_id"),
        N.normalize_cnpj(pick("cnpj")).alias("cnpj"),
        pick("razao_social", "razaoSocial").alias("razao_social"),
        pick("nome_fantasia", "nomeFantasia").alias("nome_fantasia"),
        pick("municipio").alias("municipio"),
        N.normalize_uf(pick("uf")).alias("uf"),
        N.normalize_cnae(pick("cnae_principal", "cnaePrincipal")).alias("cnae_principal"),
        F.from_json(pick("cnaes_secundarios", "cnaesSecundarios"), "array<string>").alias("cnaes_secundarios"),
        N.parse_datetime(pick("updated_at", "updatedAt")).alias("updated_at"),
        N.parse_datetime(pick("deleted_at", "deletedAt")).alias("deleted_at"),
        R.resolve_registry_regime("item").alias("regime"),
        *place(df),
    )
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("external_id", "cnpj", "razao_social")]
    return out.withColumn("errors", F.array_compact(F.array(*missing)))


def period_of_file(file: str) -> Column:
    return F.nullif(F.regexp_extract(file, r"^(\d{4}-(?:0[1-9]|1[0-2]))\.json$", 1), F.lit("")).alias("period")


def read_feed_by_period(spark: SparkSession, path: str, period: str | None = None, default: str | None = None) -> DataFrame:
    """(period, file, body): the file stem is the period; other files have a null period.

    With ``period`` only that one's bodies, or, where it has no file, those of the file named ``default`` under that period.
    """
    bodies = read_bodies(spark, path)
    known = bodies.select(period_of_file("file"), "file", "body")
    if period is None:
        return known
    own = known.where(F.col("period") == period)
    return bodies.where(F.col("file") == default).select(F.lit(period).alias("period"), "file", "body") if default and own.isEmpty() else own


def as_list(c) -> Column:
    """JSON text of a list; an object counts as a list of one; null for anything else."""
    text = F.trim(N.col(c))
    listed = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_parse_json(listed).isNotNull(), listed)


def delivery_blocks(bodies: DataFrame, identifier: str | None = None) -> DataFrame:
    """A row a company block of (period, body); an empty body is an empty list, blocks that can't be read have ``error_message``.

    ``identifier``: only blocks whose identifier has the same digits.
    """
    body = F.coalesce(as_list("body"), F.when(F.trim("body") == "", "[]").otherwise('[{"Erro": "unreadable page"}]'))
    where = [c for c in ("file",) if c in bodies.columns]
    return _typed_blocks(bodies.select("period", *where, F.posexplode(F.from_json(body, "array<string>")).alias("block_no", "block")), identifier)


def _typed_blocks(rows: DataFrame, identifier: str | None) -> DataFrame:
    get = lambda path: N.trim_to_null(F.get_json_object("block", f"$.{path}"))
    where = [c for c in ("file",) if c in rows.columns]
    items = F.when(F.get_json_object("block", "$.Entregas").isNull(), "[]").otherwise(as_list(F.get_json_object("block", "$.Entregas")))
    rows = rows.select(
        "period", *where, "block_no", "block", get("ID").alias("external_company_id"), N.normalize_identifier(get("Identificador")).alias("cnpj"), get("Razao").alias("company_name"), get("Fantasia").alias("trade_name"), items.alias("items"),
        F.coalesce(get("Erro"), F.when(items.isNull(), "unreadable deliveries")).alias("error_message"),
    )
    wanted = "".join(ch for ch in identifier or "" if ch.isdigit())
    return rows.where(N.digits("cnpj") == wanted) if wanted else rows


def delivery_items(bodies: DataFrame, identifier: str | None = None) -> DataFrame:
    """A row a delivery item with its block; a block without items, or with an error, has one row with a null item."""
    return _items_of(delivery_blocks(bodies, identifier))


def _items_of(blocks: DataFrame) -> DataFrame:
    return blocks.select(*[c for c in blocks.columns if c not in ("block", "items")], F.posexplode_outer(F.from_json("items", "array<string>")).alias("item_no", "item"))


def read_delivery_feed(spark: SparkSession, path: str, identifier: str | None = None) -> DataFrame:
    """Delivery items of landed pages of any size, block by block; pages with ``Erro``, and pages that can't be read to their end, have error_message."""
    rows = _with_file(read_elements(spark, path, single=True))
    block = F.when(F.col("error").isNotNull(), F.lit('{"Erro": "unreadable page"}')).otherwise(F.col("item"))
    return _items_of(_typed_blocks(rows.select(period_of_file("file"), "file", F.col("item_no").alias("block_no"), block.alias("block")), identifier))


def map_feed_company(bodies: DataFrame) -> DataFrame:
    """Companies of a feed (item: JSON text) with their regime; ``errors`` names missing fields."""
    get = lambda path: N.trim_to_null(F.get_json_object("item", f"$.{path}"))
    regime = R.resolve_regime(get("Regime"))
    rows = bodies.select(
        get("ID").alias("external_company_id"), N.normalize_identifier(get("Identificador")).alias("cnpj"), get("Razao").alias("company_name"), get("Fantasia").alias("trade_name"), get("Status").alias("external_status"),
        *[regime[x].alias(f"regime_{x}") for x in ("raw", "code", "canonical", "mapping_status")],
    )
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("external_company_id", "cnpj", "company_name")]
    return rows.withColumn("errors", F.array_compact(F.array(*missing)))


# Names of the parts of a delivery item.
DELIVERY_ITEM = (
    "Nome string, Status string, EntCompetencia string, EntDtPrazo string, EntDtAtraso string, EntDtEntrega string, EntDtFinalizacao string, EntLastDH string, EntGuiaLida string, EntMulta string, RespEntrega string, "
    "Config struct<EntID: string, ID: string, Tipo: string, DptoID: string, DptoNome: string, RespPrazoID: string, RespPrazo: string, RespEntregaID: string, RespEntrega: string>"
)


def map_delivery(df: DataFrame) -> DataFrame:
    """Typed delivery items from ``item``; ``errors`` names missing parts.  A department that isn't known is COMPARTILHADO."""
    get = lambda path: N.trim_to_null(F.col(f"j_.{path}"))
    finalized, delivered = N.parse_datetime(get("EntDtFinalizacao")), N.parse_date(get("EntDtEntrega"))
    texts = {
        "external_delivery_id": "Config.EntID", "external_item_id": "Config.ID", "name": "Nome", "external_status": "Status", "competence_raw": "EntCompetencia",
        "department_external_id": "Config.DptoID", "department_name": "Config.DptoNome", "responsible_deadline_id": "Config.RespPrazoID", "responsible_deadline_name": "Config.RespPrazo",
        "responsible_delivery_id": "Config.RespEntregaID",
    }
    # parsed once; values of any type are read as text
    parsed = df.where("item IS NOT NULL").withColumn("j_", F.from_json("item", DELIVERY_ITEM))
    rows = parsed.select(
        "period", "external_company_id", "cnpj", "company_name", "trade_name", *[get(path).alias(name) for name, path in texts.items()], F.upper(get("Config.Tipo")).alias("type"),
        F.coalesce(get("Config.RespEntrega"), get("RespEntrega")).alias("responsible_delivery_name"),
        N.parse_date(get("EntDtPrazo")).alias("due_date"), N.parse_date(get("EntDtAtraso")).alias("delay_date"), delivered.alias("delivered_on"), finalized.alias("finalized_at"),
        N.parse_datetime(get("EntLastDH")).alias("changed_at"), R.delivery_status(finalized, delivered, get("Status")).alias("normalized_status"),
        R.guide_read_status(get("EntGuiaLida")).alias("guide_read_status"), R.has_penalty(get("EntMulta")).alias("has_penalty"),
        R.map_department(get("Config.DptoNome"), F.lit("COMPARTILHADO")).alias("department"), F.col("item").alias("raw"), *place(df),
    )
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("external_company_id", "cnpj", "external_delivery_id", "name")]
    return rows.withColumn("errors", F.array_compact(F.array(*missing)))


def list_pages(bodies: DataFrame, name: str = "lista", keep: tuple[str, ...] = ("file",)) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of landed pages ``{sucesso, lista, total, totalFiltrado}``.

    Items: keep, total, total_filtered, item_no, item (objects alone).  Failures: keep, reason; a page whose ``sucesso``
    isn't true, or without a list.
    """
    get = lambda path: F.get_json_object("body", f"$.{path}")
    rows = bodies.select(*keep, get("sucesso").alias("ok"), get(name).alias("list"), N.parse_int(get("total")).alias("total"), N.parse_int(get("totalFiltrado")).alias("total_filtered"))
    good = F.coalesce(F.col("ok") == "true", F.lit(False))
    reason = F.when(~good, "sucesso").when(~F.coalesce(F.ltrim("list").startswith("["), F.lit(False)), name)
    rows = rows.withColumn("reason", reason)
    items = rows.where("reason IS NULL").select(*keep, "total", "total_filtered", F.posexplode(F.from_json("list", "array<string>")).alias("item_no", "item"))
    return items.where(F.ltrim("item").startswith("{")), rows.where("reason IS NOT NULL").select(*keep, "reason")


def read_document_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return list_pages(read_bodies(spark, path))


read_task_pages = read_document_pages


def assessment_company_items(bodies: DataFrame, keep: tuple[str, ...] = ("file",)) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of ``{sucesso, empresas}``; an entry that is no object is a failure, and so is a page that isn't a success."""
    # What is known of a page is told before its entries are listed: beside a generator it would be computed again for each entry.
    pages = bodies.select(*keep, F.json_tuple("body", "sucesso", "empresas").alias("ok", "list"))
    bad = ~F.coalesce(F.col("ok") == "true", F.lit(False))
    reason = F.when(bad, "sucesso").when(~F.coalesce(F.ltrim("list").startswith("["), F.lit(False)), "empresas")
    pages = pages.select(*keep, reason.alias("reason"), F.from_json("list", "array<string>").alias("entries"))
    rows = pages.select(*keep, "reason", F.posexplode_outer("entries").alias("item_no", "item"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(~F.ltrim("item").startswith("{"), "entry")))
    return rows.where("reason IS NULL AND item IS NOT NULL").select(*keep, "item_no", "item"), rows.where("reason IS NOT NULL").select(*keep, "reason", "item")


def manifest(files: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """(path, size, sha256, competencia, range_end, target_competencia, n_pages) of (path, content).

    A second period in the name ends a range; the target is the month after the last.  ``page_counts``: path, n_pages.
    """
    months = F.regexp_extract_all("path", F.lit(r"(0[1-9]|1[0-2])[-_/](\d{4})"), F.lit(0))
    end = F.when(F.size(months) > 1, N.competence_from_name(F.element_at(months, -1)))
    own = N.competence_from_name("path")
    rows = files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), own.alias("competencia"), end.alias("range_end"))
    rows = rows.withColumn("target_competencia", F.date_format(F.add_months(N.period_start(F.coalesce("range_end", "competencia")), 1), "yyyy-MM"))
    return rows.withColumn("n_pages", F.lit(None).cast("long")) if page_counts is None else rows.join(page_counts.select("path", "n_pages"), "path", "left")


def file_manifest(spark: SparkSession, path: str, page_counts: DataFrame | None = None) -> DataFrame:
    return manifest(spark.read.format("binaryFile").load(path).select("path", "content"), page_counts)


def write_run(df: DataFrame, ledger_path: str) -> None:
    """Append rows to the run ledger, a RUNNING one and later a terminal one; the last row of a run id counts (``last_runs``)."""
    df.write.mode("append").parquet(ledger_path)


def last_runs(ledger: DataFrame) -> DataFrame:
    """The state of each run: its terminal row if there is one, else its RUNNING row."""
    ranked = ledger.withColumn("done_", (F.col("status") != "RUNNING").cast("int"))
    return latest_per_key(ranked, ["run_id"], ["done_", "finished_at", "started_at"]).drop("done_")


AUDIT = ("event_type", "message", "actor_type", "actor_id", "resource_type", "resource_id")


def audit_rows(df: DataFrame, metadata: list[str]) -> DataFrame:
    """Audit events: the AUDIT columns (null where ``df`` lacks one) and ``event_metadata``, JSON of the columns named."""
    own = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in AUDIT]
    return df.where("event_type IS NOT NULL AND message IS NOT NULL").select(*own, F.to_json(F.struct(*metadata)).alias("event_metadata"))


def write_audit(df: DataFrame, path: str, metadata: list[str]) -> None:
    audit_rows(df, metadata).write.mode("append").parquet(path)


# Names of headers and of keys whose values are secrets, and the most characters of a body.
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key")
SECRET_KEYS = (
    "password", "passwd", "pwd", "senha", "token", "access_token", "refresh_token", "authorization", "cookie", "set-cookie", "apikey", "api_key", "client_secret", "secret",
)
MAX_BODY_CHARS, MAX_BODY_BYTES = 25_000, 2 << 20
TOKEN = r"\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}\b"


def _redacted(value):
    """A parsed JSON value without secrets; walks with a stack, so that depth costs no recursion."""
    top = [value]
    todo = [top]
    while todo:
        at = todo.pop()
        for key, item in list(at.items() if isinstance(at, dict) else enumerate(at)):
            if isinstance(at, dict) and key.lower() in SECRET_KEYS:
                at[key] = "<REDACTED>"
            elif isinstance(item, (dict, list)):
                todo.append(item)
            elif isinstance(item, str):
                at[key] = re.sub(TOKEN, "<REDACTED_JWT>", item)
    return top[0]


_NAMES = "|".join(map(re.escape, SECRET_KEYS))
#: In a body that is no JSON: a secret key with a text or a bare value, with an object or list that may not end, and in a form.
_TEXT_VALUE = re.compile(rf'("(?:{_NAMES})"\s*:\s*)("(?:[^"\\]|\\.)*(?:"|$)|[^\s,}}\]{{\["][^\s,}}\]]*)', re.I | re.S)
_OPEN_VALUE = re.compile(rf'("(?:{_NAMES})"\s*:\s*)[{{\[].*', re.I | re.S)
_FORM_VALUE = re.compile(rf"\b((?:{_NAMES})=)[^&\s]+", re.I)


def _no_constant(name: str):
    raise ValueError(name)


def _redact_body(text: str) -> str | None:
    """A body without secrets: JSON by its tree, written anew; other texts by patterns; None for JSON too deep to be parsed."""
    try:
        found = json.loads(text, parse_constant=_no_constant)
        if isinstance(found, (dict, list)):
            return json.dumps(_redacted(found), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace").decode()
    except RecursionError:
        return None
    except ValueError:
        pass
    text = _OPEN_VALUE.sub(r'\1"<REDACTED>"', text)  # where such a value ends can't be told, so nothing after it is kept
    text = _TEXT_VALUE.sub(r'\1"<REDACTED>"', text)
    return re.sub(TOKEN, "<REDACTED_JWT>", _FORM_VALUE.sub(r"\1<REDACTED>", text))


@F.pandas_udf(StringType())
def redact_body(body: pd.Series) -> pd.Series:
    return pd.Series([_redact_body(b) if b else b for b in body], dtype=object)


def sanitize_http_log(df: DataFrame) -> DataFrame:
    """``headers`` (map) and ``body`` of captured messages without secrets.

    Values of secret headers become <REDACTED>, and so do those of secret keys at any depth of a JSON body, which is parsed and written anew;
    tokens become <REDACTED_JWT>.  In bodies that are no JSON secret keys are found by patterns, and all that follows a secret
    object or list is left out.  Bodies over two MB, of binary types, or of JSON too deep to be parsed are left out,
    others cut to 25,000 characters; ``body_status`` tells KEPT, CUT, TOO_LARGE, BINARY, TOO_DEEP or EMPTY.
    """
    headers = F.transform_values("headers", lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), F.lit("<REDACTED>")).otherwise(F.regexp_replace(v, TOKEN, "<REDACTED_JWT>")))
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    text = kind.rlike("json|text|xml|html|javascript|urlencoded") | (kind == "")
    status = F.when(F.coalesce(F.col("body"), F.lit("")) == "", "EMPTY").when(F.octet_length("body") > MAX_BODY_BYTES, "TOO_LARGE").when(~text, "BINARY")
    told = df.withColumn("status_", status).withColumn("clean_", redact_body(F.when(F.col("status_").isNull(), F.col("body"))))
    status = F.coalesce("status_", F.when(F.col("clean_").isNull(), "TOO_DEEP").when(F.length("clean_") > MAX_BODY_CHARS, "CUT").otherwise("KEPT"))
    return told.select(*[c for c in df.columns if c not in ("headers", "body")], headers.alias("headers"), F.left("clean_", F.lit(MAX_BODY_CHARS)).alias("body"), status.alias("body_status"))


# Encodings that pages may name.
ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "windows-1252": "cp1252", "cp1252": "cp1252", "iso-8859-1": "iso-8859-1", "latin-1": "iso-8859-1", "latin1": "iso-8859-1"}


def _decoded(content: bytes | None, content_type: str | None) -> str | None:
    head = (content or b"")[:4096].decode("ascii", "ignore")
    named = re.findall(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", f"{content_type or ''} {' '.join(re.findall(r'(?is)<meta[^>]*>', head))}", re.I)
    for name in dict.fromkeys(ENCODINGS[n] for n in (*map(str.lower, named), "utf-8", "cp1252", "iso-8859-1") if n in ENCODINGS):
        try:
            text = (content or b"").decode(name)
        except UnicodeDecodeError:
            continue
        if text and not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]", text):
            return unicodedata.normalize("NFC", text)
    return None


@F.pandas_udf(StringType())
def decode_html(content: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text of HTML bytes in the first encoding that fits: of the header, of meta tags, then UTF-8, Windows-1252, Latin-1; null if none does.

    Spark's own decode has no Windows-1252, so this runs on Arrow batches.
    """
    return pd.Series([_decoded(b, t) for b, t in zip(content, content_type)], dtype=object)
