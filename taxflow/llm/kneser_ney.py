"""Quality classifier: an interpolated modified Kneser-Ney model of characters (operator 8).

Grams of ``ORDER`` characters of all trusted texts are counted; Spark joins the
counts of a gram, its context and its suffix, order by order, to interpolated
probabilities and back-off weights.  The different grams of bundles of texts are
scored by joins with these tables, and the scores joined back to the bundles.
A document is rejected if its log perplexity, or
that of its worst short stretch, is beyond a quantile of the same figure of
trusted held-out documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxflow.llm import text as T
from taxflow.llm.scratch import NARROW_ROWS, Scratch, narrow_side

ORDER = 5
#: Bytes of texts that are scored in one task, and of the compressed pieces in which they come.
BUNDLE_BYTES, PIECE_BYTES = 64 << 20, 2 << 20
#: Of trusted documents one in HELD_OUT is not trained on; those set the thresholds.
HELD_OUT = 5
QUANTILE = 0.99
#: A text counts as followed by so many characters of its language's median perplexity, so that short texts are judged with care.
PRIOR_CHARS = 64
#: Characters of the stretches whose worst is judged beside the whole text.
STRETCH = 5
#: Held-out documents from which on a language has its own threshold.
MIN_HELD_OUT = 40
SLICE_CHARS = 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each text after ORDER - 1 line feeds, white space as single spaces; and each text's start."""
    padded = ["\n" * (ORDER - 1) + " ".join((t or "").split()) for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.concatenate([[0], np.cumsum([len(p) for p in padded])]).astype(np.int64)


def slices(texts: list[str | None]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + ORDER
        if size >= SLICE_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def gram_keys(points: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of every run of ``length`` characters."""
    n = len(points) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, length, dtype=np.uint64)
    for i in range(length):
        key = (key ^ points[i : i + n].astype(np.uint64)) * _MULTIPLY
        key ^= key >> np.uint64(29)
    return key


def _inside(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the gram that starts here ends inside its text."""
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = np.searchsorted(starts, np.arange(len(points)), side="right")
    return doc[:n] == doc[ORDER - 1 :]


def _count_grams(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in slices(texts):
            points, starts = code_points(texts[lo:hi])
            at = np.flatnonzero(_inside(points, starts))
            keys = gram_keys(points, ORDER)[at]
            codes, distinct = pd.factorize(keys)
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = at[::-1]
            chars = np.ascontiguousarray(points[first[:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel() if len(first) else []
            yield pa.RecordBatch.from_arrays([pa.array([str(c) for c in chars], pa.string()), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], names=["gram", "c"])


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of an order from the numbers of grams seen once to four times."""
    row = counts.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [max(1, row[f"n{i}"]) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3)]


def _by_count(d: list[float], c: str) -> Column:
    return F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, length, gram, value): log probabilities ("p") of seen grams and log back-off weights ("g") of contexts."""
    top = texts.select("text").mapInArrow(_count_grams, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    counts = {ORDER: scratch.write(top, f"counts-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        shorter = counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        counts[k] = scratch.write(shorter, f"counts-{k}")
    alphabet = counts[1].agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).first()
    size, total = (alphabet["n"] or 0) + 1, max(1, alphabet["c"] or 0)
    d = _discounts(counts[1])
    spare = counts[1].agg(F.sum(_by_count(d, "c")).alias("x")).first()["x"] or float(total)
    prob = counts[1].select("gram", ((F.col("c") - _by_count(d, "c")) / total + spare / total / size).alias("p"))
    prob = scratch.write(prob, "p-1")
    empty = texts.sparkSession.range(1).select(F.lit("u").alias("kind"), F.lit(0).alias("length"), F.lit("").alias("gram"), F.log(F.lit(spare / total / size)).alias("value"))
    out = [empty, prob.select(F.lit("p").alias("kind"), F.lit(1).alias("length"), "gram", F.log("p").alias("value"))]
    for k in range(2, ORDER + 1):
        d = _discounts(counts[k])
        seen = counts[k].select("gram", "c", _by_count(d, "c").alias("cut"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        # a context has at most as many rows as there are characters, so its totals come from a window, by one exchange
        mine = Window.partitionBy("context")
        seen = seen.select("*", F.sum("c").over(mine).alias("total"), F.sum("cut").over(mine).alias("spared"), F.row_number().over(mine.orderBy("gram")).alias("nth"))
        lower = prob.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        seen = seen.withColumn("gamma", F.col("spared") / F.col("total")).join(narrow_side(lower), "suffix")
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("lower")
        prob = scratch.write(seen.select("gram", p.alias("p"), "context", F.when(F.col("nth") == 1, F.col("gamma")).alias("gamma")), f"p-{k}")
        out.append(prob.select(F.lit("p").alias("kind"), F.lit(k).alias("length"), "gram", F.log("p").alias("value")))
        first = prob.where("gamma IS NOT NULL")
        out.append(first.select(F.lit("g").alias("kind"), F.lit(k - 1).alias("length"), F.col("context").alias("gram"), F.log("gamma").alias("value")))
    return scratch.write(reduce(DataFrame.unionByName, out), "model")


def score_grams(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, value): the log probability of the last character of each of ``grams`` (gram: ORDER characters, each once) given the others.

    From the longest gram down, a join tells whether it was seen; where it wasn't, one with its context adds the back-off weight.
    """
    sizes = {(r["kind"], r["length"]): r["n"] for r in model.groupBy("kind", "length").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 * ORDER rows at most
    unseen = model.where("kind = 'u'").first()["value"]

    def entries(kind: str, length: int, key: str, value: str) -> DataFrame:
        mine = model.where((F.col("kind") == kind) & (F.col("length") == length)).select(F.col("gram").alias(key), F.col("value").alias(value))
        return F.broadcast(mine) if sizes.get((kind, length), 0) <= NARROW_ROWS else mine.hint("merge")

    out = grams.select("gram", F.lit(0.0).alias("value"), F.lit(True).alias("open"))
    for k in range(ORDER, 0, -1):
        own = out.withColumn("own", F.when(F.col("open"), F.substring("gram", ORDER - k + 1, k)))
        out = own.join(entries("p", k, "own", "p"), "own", "left").drop("own")
        if k > 1:
            own = out.withColumn("context", F.when(F.col("open") & F.col("p").isNull(), F.substring("gram", ORDER - k + 1, k - 1)))
            out = own.join(entries("g", k - 1, "context", "g"), "context", "left").drop("context")
            out = out.withColumn("value", F.col("value") + F.coalesce("p", "g", F.lit(0.0))).drop("g")
        else:
            out = out.withColumn("value", F.col("value") + F.coalesce("p", F.when(F.col("open"), F.lit(unseen)), F.lit(0.0)))
        out = out.withColumn("open", F.col("open") & F.col("p").isNull()).drop("p")
    return out.select("gram", F.col("value").cast("float").alias("value"))


def _rows_key(points: np.ndarray) -> np.ndarray:
    key = np.full(len(points), points.shape[1], dtype=np.uint64)
    for i in range(points.shape[1]):
        key = (key ^ points[:, i].astype(np.uint64)) * _MULTIPLY
        key ^= key >> np.uint64(29)
    return key


def _worst(value: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document the largest mean of -``value`` over STRETCH positions in a row; NaN under STRETCH positions."""
    worst = np.full(docs, np.nan)
    n = len(value) - STRETCH + 1
    if n > 0:
        sums = np.concatenate([[0.0], np.cumsum(-value)])
        at = np.flatnonzero(doc[:n] == doc[STRETCH - 1 :])
        if len(at):
            mine, mean = doc[at], (sums[at + STRETCH] - sums[at]) / STRETCH
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            worst[mine[first]] = np.maximum.reduceat(mean, first)
    return worst


class _Bundles:
    """Numbers for the texts of a task, in their order: about ``size`` bytes of texts in a row, or a single longer one, get the same."""

    def __init__(self, size: int):
        self.size, self.number, self.used = size, TaskContext.get().partitionId() << 32, 0

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(first row, end, bundle) of a batch, in pieces of PIECE_BYTES and no bundle's end inside."""
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        lo, piece = 0, 0
        for i, n in enumerate(lengths):
            if (full := bool(self.used) and self.used + n > self.size) or (i > lo and piece + n > PIECE_BYTES):
                if i > lo:
                    yield lo, i, self.number
                lo, piece = i, 0
                if full:
                    self.number, self.used = self.number + 1, 0
            self.used += n
            piece += n
        if len(lengths) > lo:
            yield lo, len(lengths), self.number


def _distinct(keys: list[np.ndarray], grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(np.concatenate(keys))
    first = np.zeros(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return found, np.concatenate(grams)[first]


def _grams_of_bundles(bundle_bytes: int):
    """(bundle, gram): the different grams of each bundle."""

    def rows(bundle, keys, grams):
        if keys:
            found = _distinct(keys, grams)[1]
            chars = pa.array(np.ascontiguousarray(found).view(f"<U{ORDER}").ravel().tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bundle)), chars], names=["bundle", "gram"])

    def run(batches):
        bundles, at_bundle, keys, grams = _Bundles(bundle_bytes), None, [], []
        for batch in batches:
            for lo, hi, bundle in bundles.parts(batch.column("text")):
                if bundle != at_bundle:
                    yield from rows(at_bundle, keys, grams)
                    at_bundle, keys, grams = bundle, [], []
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                for i, j in slices(texts):
                    points, starts = code_points(texts[i:j])
                    at = np.flatnonzero(_inside(points, starts))
                    if len(at):
                        mine, here = _distinct([gram_keys(points, ORDER)[at]], [at])
                        keys.append(mine)
                        grams.append(points[here[:, None] + np.arange(ORDER)])
                if sum(map(len, keys)) > 4_000_000:
                    one, other = _distinct(keys, grams)
                    keys, grams = [one], [other]
        yield from rows(at_bundle, keys, grams)

    return run


def _packed(bundle_bytes: int):
    """(bundle, blob): the rows of a bundle in compressed pieces."""

    def run(batches):
        bundles = _Bundles(bundle_bytes)
        for batch in batches:
            for lo, hi, bundle in bundles.parts(batch.column("text")):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(lo, hi - lo)]) for c in batch.columns], schema=batch.schema))
                yield pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bundle", "blob"])

    return run


def _score(pieces: pa.Table, scores: pa.Table) -> pa.Table:
    """Sum, number and worst stretch of each text of a bundle, from the values of all of its grams."""
    points = np.frombuffer("".join(scores.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, ORDER)
    keys = _rows_key(points)
    order = np.argsort(keys)
    keys, values = keys[order], scores.column("value").to_numpy()[order].astype(np.float64)
    out = []
    for blob in pieces.column("blob"):
        for batch in pa.ipc.open_stream(blob.as_buffer()):
            texts = batch.column("text").to_pylist()
            for lo, hi in slices(texts):
                points, starts = code_points(texts[lo:hi])
                at = np.flatnonzero(_inside(points, starts))
                codes, mine = pd.factorize(gram_keys(points, ORDER)[at])
                place = np.searchsorted(keys, mine)
                if len(mine) and (place.max() >= len(keys) or (keys[place] != mine).any()):
                    raise ValueError("a gram without a score: the documents were read in another order, write them out first")
                value = values[place][codes] if len(mine) else np.zeros(0)
                doc = np.searchsorted(starts, at, side="right") - 1
                total, n = np.bincount(doc, value, minlength=hi - lo), np.bincount(doc, minlength=hi - lo)
                columns = [pa.array(total, pa.float64()), pa.array(n, pa.int64()), pa.array(_worst(value, doc, hi - lo), pa.float64(), from_pandas=True)]
                out.append(pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("key_", "doc_id", "lang")), *columns], names=["key_", "doc_id", "lang", "total", "n", "worst"]))
    return pa.Table.from_batches(out)


def log_perplexity(docs: DataFrame, model: DataFrame, scratch: Scratch, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(key_, doc_id, lang, log_perplexity, n_scored, worst_stretch) of every document.

    Texts that lie in a row form bundles of bounded size.  The different grams of all bundles are scored by joins with the counts of the
    model, the scores joined to the bundles that have the grams, and each bundle scored in a task of its own with its own grams alone.  No table
    passes through the driver, and none is held whole by a task.  ``docs`` is read twice and must come in the same order, as tables do; else
    the second pass fails.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(T.row_key().alias("key_"), "doc_id", "lang", "text")  # the same columns both times, which repartition() goes by
    asked = scratch.write(rows.mapInArrow(_grams_of_bundles(bundle_bytes), "bundle long, gram string"), "asked")
    scores = scratch.write(score_grams(asked.select("gram").distinct(), model), "gram-scores")
    of_bundle = asked.join(scores.hint("merge"), "gram").select("bundle", "gram", "value")
    pieces = rows.mapInArrow(_packed(bundle_bytes), "bundle long, blob binary")
    scored = pieces.groupBy("bundle").cogroup(of_bundle.groupBy("bundle")).applyInArrow(_score, f"key_ binary, doc_id {kind}, lang string, total double, n long, worst double")
    return scored.select("key_", "doc_id", "lang", F.when(F.col("n") > 0, -F.col("total") / F.col("n")).alias("log_perplexity"), F.col("n").alias("n_scored"), F.col("worst").alias("worst_stretch"))


def classify(docs: DataFrame, labels: DataFrame, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """key_ and the columns of ``quality_classifier`` for every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "kneser-ney")
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("id_")).distinct()
    held_out = F.pmod(F.crc32(F.col("id_").cast("string")), F.lit(HELD_OUT)) == 0
    # written and read back: Spark broadcasts the ids only while their file is small
    fit = scratch.write(good.where(~held_out), "fit")
    held = scratch.write(good.where(held_out), "held")
    model = train(docs.select("doc_id", "text").join(fit, F.col("doc_id") == F.col("id_"), "left_semi"), scratch)
    scratch.drop(*[f"{t}-{k}" for k in range(1, ORDER + 1) for t in ("counts", "p")])
    scored = scratch.write(log_perplexity(docs, model, scratch, bundle_bytes), "scores")
    scratch.drop("model", "asked", "gram-scores")

    known = scored.join(held, F.col("doc_id") == F.col("id_"), "left_semi").where("log_perplexity IS NOT NULL")

    def quantile(column: str | Column, q: float) -> Column:
        return F.percentile_approx(column, F.lit(q), F.lit(10000))

    def with_medians(rows: DataFrame) -> DataFrame:
        both = rows.join(medians, F.col("lang").eqNullSafe(F.col("lang_")), "left").drop("lang_")
        usual = F.coalesce("median", F.lit(everywhere).cast("double"))
        tempered = (F.col("log_perplexity") * F.col("n_scored") + usual * PRIOR_CHARS) / (F.col("n_scored") + PRIOR_CHARS)
        return both.withColumn("tempered", tempered).drop("median")

    medians = known.groupBy(F.col("lang").alias("lang_")).agg(F.count(F.lit(1)).alias("n_held"), quantile("log_perplexity", 0.5).alias("median"))
    medians = scratch.write(medians.where(F.col("n_held") >= MIN_HELD_OUT).drop("n_held"), "medians")
    everywhere = known.agg(quantile("log_perplexity", 0.5)).first()[0]
    both = [quantile("tempered", QUANTILE).alias("threshold"), quantile("worst_stretch", QUANTILE).alias("stretch_threshold")]
    fences = with_medians(known).groupBy(F.col("lang").alias("lang_")).agg(F.count(F.lit(1)).alias("n_held"), *both)
    fences = scratch.write(fences.where(F.col("n_held") >= MIN_HELD_OUT).drop("n_held"), "fences")
    general = with_medians(known).agg(*both).first()  # two numbers
    judged = with_medians(scored).join(fences, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    limit, stretch = (F.coalesce(F.col(c), F.lit(general[c]).cast("double")) for c in ("threshold", "stretch_threshold"))
    kept = F.coalesce(F.col("tempered") <= limit, F.lit(True)) & F.coalesce(F.col("worst_stretch") <= stretch, F.lit(True))
    return judged.select("key_", "doc_id", "lang", "log_perplexity", "tempered", limit.alias("threshold"), "worst_stretch", stretch.alias("stretch_threshold"), "n_scored", kept.alias("kept"))


def quality_classifier(docs: DataFrame, labels: DataFrame, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """doc_id, lang, log_perplexity, tempered, threshold, worst_stretch, stretch_threshold, n_scored (long), kept of every document.

    ``docs``: doc_id, text, lang.  ``labels``: doc_id, quality, toxic; trusted
    are documents with quality 1 and toxic not 1.  Four fifths of them train the
    model, all of their text; of the others the QUANTILE of each language with at
    least ``MIN_HELD_OUT`` of them is its threshold.  Other languages, null among
    them, use the quantile of all held-out documents.  There are two thresholds:
    for ``tempered``, the log perplexity of the text with PRIOR_CHARS characters
    of its language's median after it, and for worst_stretch, the highest log
    perplexity of STRETCH characters in a row.  A document is kept if it is
    beyond neither.

    Null, empty and blank texts have no perplexity and are kept; texts under
    STRETCH characters have no stretch.  Without trusted held-out documents
    there is no threshold and all are kept.  Repeated rows are judged each;
    further columns are not read.  An empty table gives no rows.
    """
    return classify(docs, labels, bundle_bytes).drop("key_")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; null and empty texts, and rows of unknown language, as in ``quality_classifier``."""
    (key,) = T.fresh(docs, "key")
    bad = classify(docs, labels).where("NOT kept").select(F.col("key_").alias(key)).distinct()
    bad = Scratch(docs.sparkSession, "rejected").write(bad, "keys")
    return docs.withColumn(key, T.row_key()).join(narrow_side(bad), key, "left_anti").select(*docs.columns)
