"""Scalar normalisers of feed values, as Column functions.

All are built-in expressions, so filters on their results can be pushed and
fused.  Casts never fail: a value that can't be read gives null, and the
``is_bad_*`` companions tell it from a missing one.  The session time zone is UTC.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, in the same order.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
BLANKS = " \t\n\x0b\f\r"
# Weights of the two CNPJ check digits.
CNPJ_FIRST = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
CNPJ_SECOND = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
ZERO_DATES = ("0000-00-00", "0000-00-00 00:00:00")
SMALL_WORDS = ("da", "das", "de", "do", "dos", "e")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c, use) -> Column:
    """``use(value of c)``, with c computed once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(col(c)), use), F.lit(0))


def trim_to_null(c) -> Column:
    """Text without blanks at its ends; empty is null."""
    return F.nullif(F.btrim(col(c).cast("string"), F.lit(BLANKS)), F.lit(""))


def unaccent(c) -> Column:
    """Text of one byte a letter has no accents, and needn't be walked letter by letter."""
    c = col(c)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), ACCENTED, PLAIN))


def upper_ascii(c) -> Column:
    return F.upper(unaccent(trim_to_null(c)))


def search_form(c) -> Column:
    """Lower-case words of a-z and 0-9 with single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccent(col(c))), "[^a-z0-9]+", " "))


def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def digits(c) -> Column:
    return F.regexp_replace(col(c).cast("string"), "[^0-9]", "")


def normalize_identifier(c) -> Column:
    return F.coalesce(F.nullif(digits(c), F.lit("")), trim_to_null(c))


def normalize_cnpj(c) -> Column:
    return F.when(F.length(digits(c)) == 14, digits(c)).otherwise(F.left(trim_to_null(c), F.lit(18)))


def cnpj_root(c) -> Column:
    return F.when(F.length(digits(c)) >= 8, F.left(digits(c), F.lit(8)))


def check_digit(number, weights: tuple[int, ...]) -> Column:
    """Modulo-11 digit of the first digits of a number: 11 less the rest, and 0 for a rest under 2."""

    def digit(n: Column) -> Column:
        rest = reduce(lambda a, b: a + b, [F.substring(n, i + 1, 1).cast("int") * w for i, w in enumerate(weights)]) % 11
        return (11 - rest) % 11 % 10

    return once(number, digit)


def cnpj_is_good(d: Column) -> Column:
    """Whether digits are 14, not all the same, and have the check digits of the first 12."""

    def good(n: Column) -> Column:
        first, second = check_digit(n, CNPJ_FIRST), check_digit(n, CNPJ_SECOND)
        return (n != F.repeat(F.left(n, F.lit(1)), 14)) & (F.right(n, F.lit(2)) == F.concat(first.cast("string"), second.cast("string")))

    return F.coalesce(F.when(F.length(d) == 14, good(d)), F.lit(False))


def cnpj_status(c, d: Column) -> Column:
    """VALID/INVALID/MISSING of a text whose digits are ``d``."""
    return F.when(trim_to_null(c).isNull(), "MISSING").when(cnpj_is_good(d), "VALID").otherwise("INVALID")


def validate_cnpj(c) -> Column:
    """struct(normalized, status VALID/INVALID/MISSING, length_valid, check_valid)."""

    def parts(d: Column) -> Column:
        whole = F.length(d) == 14
        text = F.when(whole, d).otherwise(trim_to_null(c))
        return F.struct(text.alias("normalized"), cnpj_status(c, d).alias("status"), F.coalesce(whole, F.lit(False)).alias("length_valid"), cnpj_is_good(d).alias("check_valid"))

    return once(digits(c), parts)


def format_cnpj(c) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")).otherwise(col(c))


def mask_value(c, prefix: int = 2, suffix: int = 2) -> Column:
    n = F.length(col(c))
    hidden = F.concat(F.left(col(c), F.lit(prefix)), F.repeat(F.lit("*"), n - prefix - suffix), F.right(col(c), F.lit(suffix)))
    return F.when(n <= prefix + suffix, F.repeat(F.lit("*"), n)).otherwise(hidden)


def redact_map(c, keys: list[str]) -> Column:
    named = [k.lower() for k in keys]
    return F.transform_values(col(c), lambda k, v: F.when(F.lower(k).isin(named), F.lit("***")).otherwise(v))


def sanitize_message(c) -> Column:
    return F.left(collapse_ws(F.regexp_replace(col(c), "[0-9]", "#")), F.lit(120))


def normalize_cnae(c) -> Column:
    """Seven digits, else null."""
    return F.when(F.length(digits(c)) == 7, digits(c))


def format_cnae(c) -> Column:
    return F.regexp_replace(normalize_cnae(c), r"^(\d{4})(\d)(\d{2})$", "$1-$2/$3")


def is_bad_cnae(c) -> Column:
    """Digits are there, but not seven."""
    return F.coalesce((F.length(digits(c)) > 0) & (F.length(digits(c)) != 7), F.lit(False))


def normalize_uf(c) -> Column:
    return F.left(F.upper(trim_to_null(c)), F.lit(2))


def parse_date(c) -> Column:
    text = F.left(trim_to_null(c), F.lit(10))
    return F.when(~text.isin(*ZERO_DATES), text.try_cast("date"))


def is_bad_date(c) -> Column:
    text = F.left(trim_to_null(c), F.lit(10))
    return F.coalesce(~text.isin(*ZERO_DATES) & text.try_cast("date").isNull(), F.lit(False))


def parse_datetime(c) -> Column:
    """Zero dates are null; a time without zone is UTC; digits beyond microseconds are cut."""
    text = trim_to_null(c)
    return F.when(~text.startswith("0000-00-00"), text.try_cast("timestamp"))


def parse_iso_fraction(c) -> Column:
    """ISO time with any number of fraction digits, a zone or none (UTC); digits beyond microseconds are cut, other text is null."""
    text = F.regexp_replace(trim_to_null(c), r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), text.try_cast("timestamp"))


def normalize_cnae_optional(c) -> Column:
    """struct(cnae, error): no digits is no code, other than seven digits an error."""
    return F.struct(normalize_cnae(c).alias("cnae"), F.when(is_bad_cnae(c), F.lit("cnae")).alias("error"))


def null_sentinel_dt(c) -> Column:
    text = trim_to_null(c)
    return F.when(~(text.startswith("0001-01-01") | text.startswith("0000-00-00")), text)


def period_reference(c) -> Column:
    """``YYYY-MM...`` or ``MM/YYYY`` as ``YYYY-MM``; null for a month out of range."""
    text = trim_to_null(c)
    iso = F.nullif(F.regexp_extract(text, r"^(\d{4}-(?:0[1-9]|1[0-2]))", 1), F.lit(""))
    month, year = F.regexp_extract(text, r"^(0[1-9]|1[0-2])/(\d{4})$", 1), F.regexp_extract(text, r"^(0[1-9]|1[0-2])/(\d{4})$", 2)
    return F.coalesce(iso, F.when(month != "", F.concat_ws("-", year, month)))


def is_period(c) -> Column:
    return F.coalesce(col(c).rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def period_start(c) -> Column:
    return F.concat(col(c), F.lit("-01")).try_cast("date")


def period_bounds(c) -> Column:
    return F.struct(period_start(c).alias("first_day"), F.last_day(period_start(c)).alias("last_day"))


def payroll_month(c) -> Column:
    """``MM/YYYY``, from 1900 on, as ``YYYY-MM``; null for other text."""
    text = trim_to_null(c)
    return F.when(text.rlike(r"^(?:0[1-9]|1[0-2])/(?:19|[2-9]\d)\d{2}$"), F.concat(F.substring(text, 4, 4), F.lit("-"), F.left(text, F.lit(2))))


def month_after(c) -> Column:
    return F.date_format(F.add_months(period_start(c), 1), "yyyy-MM")


def payroll_to_assessment(c) -> Column:
    """struct(payroll, assessment): ``MM/YYYY`` and the month after it, both ``YYYY-MM``."""
    return once(payroll_month(c), lambda own: F.struct(own.alias("payroll"), month_after(own).alias("assessment")))


def parse_decimal_mixed(c) -> Column:
    """Brazilian with a comma, else plain; two places, half up."""
    text = trim_to_null(c)
    plain = F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text)
    return plain.try_cast("decimal(14,2)")


def brl_amount(text: Column) -> Column:
    """Brazilian amount with two places, without blanks around it; null for other text."""
    shaped = text.rlike(r"^(?:\d{1,3}(?:\.\d{3})*|\d+|),\d{2}$")
    return F.when(shaped, F.concat(F.lit("0"), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).try_cast("decimal(14,2)"))


def parse_brl_strict(c) -> Column:
    return brl_amount(trim_to_null(c))


HOURS = r"^\d+:[0-5]\d$"


def hours_minutes(text: Column) -> Column:
    """Minutes of a text like ``HOURS``."""
    return F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).try_cast("int")


def parse_informed(c) -> Column:
    """struct(kind HOURS/DECIMAL/UNKNOWN, minutes, amount)."""
    text = trim_to_null(c)
    hours = text.rlike(HOURS)
    minutes = F.when(hours, hours_minutes(text))
    amount = parse_brl_strict(text)
    return F.struct(F.when(hours, "HOURS").when(amount.isNotNull(), "DECIMAL").otherwise("UNKNOWN").alias("kind"), minutes.alias("minutes"), amount.alias("amount"))


def parse_percent(c) -> Column:
    text = F.regexp_replace(col(c), r"[%\s]", "")
    plain = F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text)
    return plain.try_cast("decimal(5,2)")


def parse_int(c) -> Column:
    return trim_to_null(c).try_cast("int")


def is_bad_int(c) -> Column:
    return trim_to_null(c).isNotNull() & parse_int(c).isNull()


def first_bool(*cs) -> Column:
    """First of the values that is a real boolean."""
    return F.coalesce(*[F.when(F.lower(col(c).cast("string")).isin("true", "false"), col(c).cast("string").try_cast("boolean")) for c in cs])


def string_list(c) -> Column:
    """Comma text as a list without blanks."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def pick(json: Column | str, aliases: list[str]) -> Column:
    """Value, as text, of the first alias that is a key of the JSON object, even where it is null."""

    def value(keys: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in reversed(aliases):
            out = F.when(F.array_contains(keys, name), F.get_json_object(col(json), f"$.{name}")).otherwise(out)
        return out

    return once(F.json_object_keys(col(json)), value)


def parse_maybe_nested_json(c) -> Column:
    """A JSON object that may have been encoded twice, as text; null if it is no object."""

    def text(outer: Column) -> Column:
        kind = F.schema_of_variant(outer)
        inner = once(F.try_variant_get(outer, "$", "string"), lambda x: F.when(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), x))
        return F.when(kind == "STRING", inner).when(kind.startswith("OBJECT"), col(c))

    return once(F.try_parse_json(col(c)), text)


def file_extension(c, name) -> Column:
    own = trim_to_null(c)
    found = F.nullif(F.regexp_extract(col(name), r"\.([^.\\/]+)$", 1), F.lit(""))
    return F.lower(F.concat(F.lit("."), F.coalesce(F.ltrim(own, F.lit(".")), found)))


def surrogate_key(ids: list, parts: list) -> Column:
    """First id that is there, else 32 hex digits of the SHA-256 of the parts joined by |."""
    joined = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.coalesce(*[trim_to_null(i) for i in ids], F.left(F.sha2(joined, 256), F.lit(32)))


def assessment_id(explicit, cnpj, period) -> Column:
    return F.coalesce(trim_to_null(explicit), F.concat_ws(":", F.lit("apuracao"), col(cnpj), col(period)))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the JSON of the columns in order of their names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def competence_from_name(c) -> Column:
    month, year = (F.regexp_extract(col(c), r"(0[1-9]|1[0-2])[-_/](\d{4})", i) for i in (1, 2))
    return F.when(month != "", F.concat_ws("-", year, month))


def parse_br_date(c) -> Column:
    return F.when(trim_to_null(c).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(trim_to_null(c), F.lit("dd/MM/yyyy")).cast("date"))


def display_state_registration(c) -> Column:
    return F.coalesce(trim_to_null(c), F.lit("ISENTO"))


def display_place(city, state) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" / ", trim_to_null(city), trim_to_null(state)), F.lit("")), F.lit("Nao informado"))


def display_title(c) -> Column:
    words = F.split(F.lower(collapse_ws(F.replace(col(c), F.lit("_"), F.lit(" ")))), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.initcap(w))), " ")


def homologation_status(c) -> Column:
    return F.when(col(c).isNull(), None).when(col(c), "HOMOLOGADA").otherwise("NAO_HOMOLOGADA")


def is_transmitted(at, kind) -> Column:
    return F.when(col(at).isNotNull(), True).when(F.upper(trim_to_null(kind)) == "NAO_TRANSMITIDA", False)


REGIME_TITLES = {"SIMPLES_NACIONAL": "Simples Nacional", "LUCRO_PRESUMIDO": "Lucro Presumido", "LUCRO_REAL": "Lucro Real", "MEI": "MEI", "IMUNE_ISENTA": "Imune/Isenta"}


def display_regime(canonical, mapping_status) -> Column:
    """Title of a mapped regime; what can't be mapped and what isn't there have their own."""
    title = F.lit(None).cast("string")
    for name, shown in REGIME_TITLES.items():
        title = F.when(col(canonical) == name, shown).otherwise(title)
    known = (col(mapping_status) == "MAPPED") & col(canonical).isNotNull()
    return F.when(known, F.coalesce(title, col(canonical))).when(col(mapping_status) == "UNMAPPED", "Regime nao mapeado").otherwise("Aguardando regime")


def display_period(c) -> Column:
    return F.coalesce(F.when(F.contains(col(c), F.lit("-")), F.concat_ws("/", F.split_part(col(c), F.lit("-"), F.lit(2)), F.split_part(col(c), F.lit("-"), F.lit(1)))), F.nullif(col(c), F.lit("")), F.lit("-"))
