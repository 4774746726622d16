"""Line dedup by winnowing (operator 9), built-in functions only.

A document is the sequence of its lines with a word.  Windows over it are one
line of ``WORDS`` or more words, two lines of as many together, and ``RUN``
lines.  In every window the least line hash (the last of equals) is a
fingerprint, so two equal windows share one.  Fingerprints that occur more than
once are extended both ways to the runs that they stand for; of equal runs the
first in order of (doc_id, line) stays and the lines of all later ones are
deleted, so that longer repeated runs go as a chain of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxflow.llm import text as T
from taxflow.llm.scratch import Scratch

#: Lines of a run that is deleted whatever its words, and words of a run of one or two lines.
RUN = 3
WORDS = 5


def _enough_words(line: Column) -> Column:
    return line.rlike(rf"^[{T.SPACE}]*(?:[^{T.SPACE}]+[{T.SPACE}]+){{{WORDS - 1}}}[^{T.SPACE}]")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(tf_key__, tf_gone__ array<int>): of each document with later repeated runs the line numbers to delete."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lined = docs.where(F.col("text").isNotNull()).select("doc_id", T.row_key().alias("tf_key__"), F.split("text", "\n").alias("lines"))
    lined = lined.select("doc_id", "tf_key__", "lines", F.filter(T.upto(F.size("lines")), lambda i: T.has_word(F.get("lines", i))).alias("places"))
    at = lambda i: F.get("lines", F.get("places", i))
    lined = lined.select(
        "doc_id", "tf_key__", "lines", "places", F.transform("places", lambda i: F.xxhash64(F.get("lines", i))).alias("h"), F.transform("places", lambda i: F.xxhash64(F.lit(1), F.get("lines", i))).alias("h2"), F.transform("places", lambda i: _enough_words(F.get("lines", i))).alias("long")
    )
    h, long = lambda i: F.get("h", i), lambda i: F.get("long", i)

    # Windows of long lines alone are left out: each of their lines is a window of its own.
    def of_three(i: Column) -> Column:
        low = F.least(h(i), h(i + 1), h(i + 2))
        return F.when(~(long(i) & long(i + 1) & long(i + 2)), F.when(h(i + 2) == low, i + 2).when(h(i + 1) == low, i + 1).otherwise(i))

    def of_two(i: Column) -> Column:
        short = ~(long(i) & long(i + 1))
        enough = long(i) | long(i + 1) | _enough_words(F.concat(at(i), F.lit(" "), at(i + 1)))
        return F.when(short & enough, F.when(h(i + 1) <= h(i), i + 1).otherwise(i))

    chosen = lined.select(
        "doc_id", "tf_key__", "places", "h", "h2", "long",
        F.transform(T.upto(F.size("h") - (RUN - 1)), of_three).alias("three"), F.transform(T.upto(F.size("h") - 1), of_two).alias("two"),
    )

    def fingerprint(p: Column) -> Column:
        # the windows that this fingerprint stands for, by extension to its left and right
        def runs(name: str, n: int) -> Column:
            near = F.filter(F.sequence(p - (n - 1), p), lambda i: (i >= 0) & F.coalesce(F.get(name, F.when(i >= 0, i)) == p, F.lit(False)))
            return F.transform(near, lambda i: F.struct(F.xxhash64(F.slice("h", i + 1, n)).alias("run"), F.xxhash64(F.lit(n), F.slice("h2", i + 1, n)).alias("chk"), F.slice("places", i + 1, n).alias("at")))

        return F.struct(h(p).alias("finger"), F.get("h2", p).alias("finger2"), F.when(long(p), F.get("places", p)).alias("line"), F.concat(runs("three", RUN), runs("two", 2)).alias("runs"))

    places = F.filter(F.array_distinct(F.concat("three", "two", F.filter(T.upto(F.size("h")), long))), lambda p: p.isNotNull())
    # Put together before rows are made, so that no row carries the lines of its whole text.  explode_outer, because
    # explode adds a filter on its array, and Spark would write the arrays that it is made of into that filter's lambdas.
    fingers = chosen.select("doc_id", "tf_key__", F.transform(places, fingerprint).alias("all"))
    fingers = fingers.select("doc_id", "tf_key__", F.explode_outer("all").alias("x")).where("x IS NOT NULL").select("x.finger", "x.finger2", "doc_id", "tf_key__", "x.line", "x.runs")
    fingers = scratch.write(fingers, "fingers")
    often = fingers.groupBy("finger").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("finger")
    met = fingers.join(often.hint("merge"), "finger")
    single = F.when(F.col("line").isNotNull(), F.array(F.struct(F.xxhash64(F.array("finger")).alias("run"), F.xxhash64(F.lit(1), F.array("finger2")).alias("chk"), F.array("line").alias("at"))))
    met = met.select("doc_id", "tf_key__", F.explode(F.concat("runs", F.coalesce(single, F.slice("runs", 1, 0)))).alias("r")).select("doc_id", "tf_key__", "r.run", "r.chk", "r.at", F.get("r.at", F.lit(0)).alias("line"))
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), "tf_key__", "line")
    met = scratch.write(met.select("tf_key__", "run", "chk", "at", place.alias("place")), "runs")
    scratch.drop("fingers")
    # a run is named by two hashes, 128 bits
    first = met.groupBy("run", "chk").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "chk", "first")
    later = met.join(first.hint("merge"), ["run", "chk"]).where("place > first")
    gone = later.select("tf_key__", F.explode("at").alias("line")).groupBy("tf_key__").agg(F.collect_set("line").alias("tf_gone__"))
    return scratch.write(gone, "gone")


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without later repeated lines of ``WORDS`` or more words and later repeated runs; adds n_lines and n_removed (long).

    A run is ``RUN`` or more lines, or two lines of ``WORDS`` or more words
    together; so a repeated passage of ``WORDS`` words goes in texts of any
    number of lines, and single lines of fewer words stay.  Lines without a word
    are kept, and don't interrupt a run.  Null texts stay null, with 0 lines.  Rows with
    equal id and text are one document and get equal results; a null doc_id
    comes last in order.  Columns n_lines and n_removed of the input are
    replaced; all others stay.  An empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key, gone, lines = T.fresh(docs, "key", "gone", "lines")
    found = repeated_lines(docs.select("doc_id", "text")).select(F.col("tf_key__").alias(key), F.col("tf_gone__").alias(gone))
    both = docs.select(*names, T.row_key().alias(key)).join(found.hint("merge"), key, "left").select("*", F.split("text", "\n").alias(lines))
    kept = F.transform(F.array_except(T.upto(F.size(lines)), gone), lambda i: F.get(lines, i))
    return both.select(
        *[F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else c for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, line, txt, len(list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) AS j
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
  WHERE regexp_matches(txt, '[^\x20\x09-\x0D]')
), r AS (
  SELECT doc_id, line, j, w, txt, lead(w) OVER d AS w2, lead(txt) OVER d AS txt2, lead(txt, 2) OVER d AS txt3
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY line)
), runs AS (
  SELECT doc_id, line, j, 1 AS n, [txt] AS run FROM r WHERE w >= 5
  UNION ALL SELECT doc_id, line, j, 2, [txt, txt2] FROM r WHERE w + w2 >= 5
  UNION ALL SELECT doc_id, line, j, 3, [txt, txt2, txt3] FROM r WHERE txt3 IS NOT NULL
), f AS (
  SELECT doc_id, j, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, line) AS nth FROM runs
), gone AS (
  SELECT DISTINCT doc_id, j + k AS j FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1 AND k < n
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), kept AS (
  SELECT a.doc_id, count(*) AS n_lines, count(g.j) AS n_removed,
         coalesce(string_agg(a.txt, chr(10) ORDER BY a.line) FILTER (WHERE g.j IS NULL), '') AS text
  FROM lines a LEFT JOIN l USING (doc_id, line) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.j = l.j GROUP BY a.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, d.lang, d.source, d.n_chars,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
