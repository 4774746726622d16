"""Quality rules as a short-circuit cascade (operator 3), built-in functions only.

The verdict is the same for every order of the rules; the order decides what it
costs.  On a bounded sample, chosen by hash, one job counts which rules reject
which documents together, and the work that each rule does beyond the measures
that are there anyway: values compared and characters read, at fixed unit
costs.  Rules then stand in the order in which each next one rejects most of what is left
for its cost, as the branches of one CASE, so that a rejected document is
spared the rest.  Nothing is timed, so every run finds the same order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxflow.llm import text as T

SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
#: Documents, about, on which the order of the rules is found.
SAMPLE_ROWS = 2000


#: Nanoseconds, measured once: for a comparison of numbers, and for a character that a regular expression reads.
COMPARE_NS, CHARACTER_NS = 20.0, 6.0


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``rejects`` is true; null counts as false.

    ``characters``: how many characters the condition reads in a document, beside the measures; none by default.
    """

    name: str
    rejects: Column
    characters: Column | None = None

    def cost(self) -> Column:
        return F.lit(COMPARE_NS) if self.characters is None else COMPARE_NS + CHARACTER_NS * self.characters


def default_rules() -> list[Rule]:
    """The rules of ``quality_rules``, over the columns that ``measures`` adds."""
    return [
        Rule("symbols", F.expr("10 * n_symbols > 3 * n_words")),
        Rule("duplicate_lines", F.expr("100 * n_dup_lines > 30 * n_lines")),
        Rule("word_length", F.expr("word_chars < 2 * n_words OR word_chars > 15 * n_words")),
        Rule("capitals", 2 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > F.col("word_chars"), F.length("text")),
    ]


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of each text, beside ``keep`` and text."""
    filled = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.select(*keep, filled.alias("text")).select("*", T.words(F.col("text")).alias("words_"))
    lines = F.filter(F.split("text", "\n"), T.has_word)
    hashed = F.transform("words_", lambda w: F.xxhash64(w))
    staged = staged.select("*", lines.alias("lines_"), hashed.alias("hashed_"))
    grams = F.transform(T.upto(F.size("hashed_") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashed_", i + 1, WINDOW)))
    staged = staged.select("*", grams.alias("grams_"))
    # positions of windows found twice or more: neighbours in order of (hash, position)
    ordered = F.array_sort(F.transform("grams_", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeated = F.size("grams_") > F.size(F.array_distinct("grams_"))
    staged = staged.select("*", F.when(repeated, ordered).alias("ordered_"))
    at = lambda i: F.get("ordered_", i)["g"]
    twice = F.filter("ordered_", lambda x, i: F.coalesce(x["g"] == at(i - 1), F.lit(False)) | F.coalesce(x["g"] == at(i + 1), F.lit(False)))
    staged = staged.select("*", F.when(F.col("ordered_").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))).alias("starts_"))
    gaps = F.transform("starts_", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts_", i + 1) - p, F.lit(WINDOW))))
    return staged.select(
        *keep,
        "text",
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, nanoseconds a document, share rejected of what came to it) in the order to apply, from about ``sample_rows`` documents.

    Documents are chosen by a hash of their id over the whole table; only the order depends on them.  Each next rule is the one with most
    rejections per cost among the sampled documents that the rules before it keep; equal ones by name.
    """
    total = docs.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(min(1.0, sample_rows / max(1, total)) * (1 << 20)))
    sample = measures(docs.where(share))  # no filter on the measures: Spark would compute them again for it
    mask = F.array(F.expr(BASE_FAILED), *[F.coalesce(r.rejects, F.lit(False)) for r in rules])
    costs = [F.sum(r.cost()).alias(f"cost_{i}") for i, r in enumerate(rules)]
    seen = sample.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *costs).collect()  # a row for each set of rules that meet
    seen = [r for r in seen if not r["mask"][0]]  # the base rule comes first
    n = max(1, sum(r["n"] for r in seen))
    each = [sum(r[f"cost_{i}"] for r in seen) / n or COMPARE_NS for i in range(len(rules))]
    left, out = set(range(len(rules))), []
    while left:
        come = [r for r in seen if not any(r["mask"][i + 1] for i in range(len(rules)) if i not in left)]
        hits = {i: sum(r["n"] for r in come if r["mask"][i + 1]) for i in left}
        best = min(left, key=lambda i: (-hits[i] / each[i], rules[i].name))
        left.remove(best)
        out.append((rules[best], each[best], hits[best] / max(1, sum(r["n"] for r in come))))
    return out


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document with its measures and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed, kept (boolean) and rejected_by (the first rule that
    rejected it in the order applied, ``base``, or null).  Null and empty texts
    have no words and fail the base rule.  Repeated rows are judged each;
    further columns of ``docs`` are not read.  An empty table gives no rows.
    """
    rules = default_rules() if rules is None else rules
    ordered = [x[0] for x in order_rules(docs, rules, sample_rows)]
    found = measures(docs, "doc_id").withColumn("base_failed", F.expr(BASE_FAILED))
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    found = found.withColumn("rejected_by", verdict)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS gram
  FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS i)
), r AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM r GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS caps
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d
  LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * caps > word_chars) AS kept
FROM b
"""
