"""Benchmark decontamination by spaced seeds (operator 2), built-in functions only.

A seed hashes the words at the ones of a fixed mask over consecutive words and
ignores the others, so that a substituted word under a zero doesn't hide a
match.  The masks for a length are such that, however the words that may differ
are placed, at least one seed has none of them.  Seeds of documents and of benchmark items are joined; around a
hit the item is laid beside the document and the equal words are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxflow.llm import text as T
from taxflow.llm.scratch import Scratch, narrow_side

#: Words of the stretch that is verified, and the least share of equal words in it.
STRETCH = 20
SHARE = 0.8
#: Fixed masks by words of the stretch, found by enumeration of all placements of a fifth of substituted words; shorter items
#: have none to spare and use a seed of all their words.
MASKS = {
    5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("111011", "11111"), 9: ("111011",), 10: ("11101", "1111"), 11: ("11101",),
    12: ("111011", "11111"), 13: ("111011", "11111"), 14: ("111011", "11111"), 15: ("111011", "11111"), 16: ("111011", "11111"),
    17: ("111011",), 18: ("111011", "11111"), 19: ("111011", "11111"), 20: ("111011", "11111"),
}
#: Seeds of the benchmark, and pairs to verify, that may be broadcast (48 bytes a seed; 10 words and shifts a pair on average).
BROADCAST_SEEDS = 200_000


def normal_words(text: Column) -> Column:
    """Lower-case words without punctuation."""
    return T.words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}" + T.SPACE + "]+", ""))


def _seeds(hashed: str, mask: str) -> Column:
    ones = [i for i, x in enumerate(mask) if x == "1"]
    return F.transform(T.upto(F.size(hashed) - (len(mask) - 1)), lambda i: F.xxhash64(F.lit(mask), *[F.get(hashed, i + j) for j in ones]))


def _with_seeds(df: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    staged = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"))
    return staged.select(*keep, F.explode(F.array(*[_seeds("hashed", m) for m in masks])).alias("seeds")).select(*keep, F.posexplode("seeds").alias("at", "seed"))


def masks_of(length: int) -> tuple[str, ...]:
    """Masks of the seeds of an item of ``length`` words."""
    return MASKS.get(min(length, STRETCH)) or ("1" * length,)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_matched, share): documents that hold a benchmark item, a row for each pair.

    A pair is reported when, at some alignment, the best stretch of min(20, item
    length) words of the item has at least 80 % equal words in the document.
    Words are compared in lower case and without punctuation.  n_matched and
    share are those of that stretch, at the best alignment.

    Null or empty texts on either side match nothing.  Rows with a repeated doc_id or
    item_id are joined each, and a pair of ids is reported once; null ids are
    reported as null.  Further columns are not read.  An empty table on either
    side gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.write(benchmark.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    width = F.least(F.lit(STRETCH), F.size("words"))
    widths = [r[0] for r in items.select(width).distinct().collect()]  # at most 20 numbers
    masks = sorted({m for n in widths for m in masks_of(n)}) or ["1"]
    seeds = _with_seeds(items.limit(0), ["1"], "item_id", "words")
    for n in sorted(widths):
        seeds = seeds.unionByName(_with_seeds(items.where(width == n), list(masks_of(n)), "item_id", "words"))
    seeds = scratch.write(seeds.select("seed", "item_id", F.col("at").alias("item_at"), F.xxhash64("words").alias("item_key")).distinct(), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", T.row_key().alias("tf_key__"), normal_words(F.col("text")).alias("words"))
    # seeds travel without the words, and what a document has of one item is one row
    met = _with_seeds(texts, masks, "tf_key__").join(F.broadcast(seeds) if small else seeds.hint("merge"), "seed")
    met = met.select("tf_key__", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    met = met.groupBy("tf_key__", "item_id", "item_key").agg(F.collect_list("shift").alias("shifts"))
    keyed = items.select(F.col("item_id").alias("item_"), F.xxhash64("words").alias("key_"), F.col("words").alias("item_words")).distinct()
    same_item = (F.col("item_key") == F.col("key_")) & F.col("item_id").eqNullSafe(F.col("item_"))
    met = met.join(F.broadcast(keyed) if small else keyed.hint("merge"), same_item)
    met = scratch.write(met.select("tf_key__", "item_id", "shifts", "item_words"), "met")
    n_met, n_words = met.agg(F.count(F.lit(1)), F.sum(F.size("shifts") + F.size("item_words"))).first()  # two numbers
    few = n_met <= BROADCAST_SEEDS and (n_words or 0) <= 10 * BROADCAST_SEEDS
    sized = texts.join(F.broadcast(met) if few else met.hint("merge"), "tf_key__")

    n, width = F.size("item_words"), F.least(F.lit(STRETCH), F.size("item_words"))

    def equal(shift: Column) -> Column:
        word = lambda i: F.get("words", F.when(i + shift >= 0, i + shift))
        return F.zip_with("item_words", T.upto(n), lambda w, i: F.coalesce(w == word(i), F.lit(False)).cast("int"))

    def best_stretch(found: Column) -> Column:
        return F.array_max(F.transform(T.upto(n - width + 1), lambda i: F.aggregate(F.slice(found, i + 1, width), F.lit(0), lambda a, x: a + x)))

    best = F.array_max(F.transform(F.transform("shifts", equal), best_stretch))
    scored = sized.select("doc_id", "item_id", n.alias("n"), width.alias("width"), best.alias("best"))
    scored = scored.where(F.col("best") >= F.ceil(F.lit(SHARE) * F.col("width")))
    top = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("best") / F.col("width")).alias("share"), "best", "n")).alias("x"))
    return top.select("doc_id", "item_id", F.col("x.n").cast("long").alias("n_item_words"), F.col("x.best").cast("long").alias("n_matched"), F.col("x.share").alias("share"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, with all their columns.

    Null and empty texts hold none.  Rows without a doc_id stay; of several rows
    with one doc_id all go if one of them holds an item.
    """
    found = contamination(docs, benchmark).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    found = Scratch(docs.sparkSession, "contaminated").write(found, "ids")
    return docs.join(narrow_side(found), "doc_id", "left_anti").select(*docs.columns)
