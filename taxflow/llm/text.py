"""Column helpers on texts, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inside a character class: the white space that parts words.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Maximal runs of other characters than ``SPACE``; none for null."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) > 0, F.split(bare, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0


def upto(n: Column) -> Column:
    """0 .. n-1 as an array, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A key of a document, 128 bits; rows with equal id and text share it."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(told(F.col(id_column).cast("string")), told(F.col(text_column)))))


def row_key_pair(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """Such a key as two numbers, ``key1_`` and ``key2_``, of 64 bits each."""
    return [F.xxhash64(F.col(id_column), F.col(text_column)).alias("key1_"), F.xxhash64(F.lit(1), F.col(id_column), F.col(text_column)).alias("key2_")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        found = f"tf_{name}__"
        while found.lower() in taken:
            found += "_"
        out.append(found)
    return out
