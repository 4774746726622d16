"""Exact repeats of a fixed length across all documents, the part that operators 6 and 10 share.

Symbols are words or bytes.  A *window* is ``length`` consecutive symbols of
one document; it is repeated when the same symbols start anywhere else.  Not
every window is shuffled:

* In each window the least gram of ``gram`` symbols is chosen (winnowing).
  Equal windows choose the same gram, so a window can only be repeated if its
  gram is.  Consecutive windows with one chosen gram form a *range*; a range is
  known by its gram and by two independent 64-bit hashes of all symbols that its
  windows cover, so spans count as equal by 128 bits of their content.
* Where a range as a whole occurs twice, all of its windows are repeated.
* Other ranges of a repeated gram may be repeated in part.  One occurrence of
  each such range sends its content, and the operator finds out which of its
  windows are repeated (operator 6: edges of a de Bruijn graph, operator 10:
  common-prefix intervals of a suffix array).

Rows per key are bounded: a document sends each range once, equal ranges are
counted before they meet, and joins on a gram can be split by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxflow.llm import kernels as K
from taxflow.llm import text as T
from taxflow.llm.scratch import Scratch

#: Windows whose grams are searched at once.
_STEP = 1 << 22

#: Names of the two numbers of a document's key.
KEY = ["key1_", "key2_"]


@dataclass(frozen=True)
class Shape:
    """What a symbol is and how long windows and grams are."""

    unit: str  # "word" or "byte"
    length: int
    gram: int


@dataclass
class Ranges:
    """Ranges of a slice: first window, number of windows, index of the gram, text; and how to hash its symbols."""

    lo: np.ndarray
    count: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    gram: np.ndarray
    rid: np.ndarray
    chk: np.ndarray
    sums: np.ndarray
    second: np.ndarray  # sums of the other base
    first: np.ndarray  # index of each text's first symbol, and the end


def find_ranges(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> Ranges:
    if shape.unit == "word":
        words = K.Words(data, offsets)
        values, first, doc = words.hashes(), words.first, words.doc
    else:
        base = int(offsets[0])
        first = offsets - base
        values = K.byte_values(data[base : int(offsets[-1])])
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sums, second = K.prefix(values), K.prefix(K.mix(values + np.uint64(29)), 1)
    n, width = len(doc) - shape.length + 1, shape.length - shape.gram + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Ranges(none, none, none, none, *[none.view(np.uint64)] * 3, sums, second, first)
    grams = K.window_hash(sums, shape.gram)
    at = np.concatenate([K.winnow(grams[s : s + _STEP + width - 1], width) + s for s in range(0, n, _STEP)])
    valid = doc[:n] == doc[shape.length - 1 :]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (doc[1:n] != doc[: n - 1])
    lo = np.flatnonzero(opens)
    # a range ends before the next one, or where windows leave the document
    stop = np.append(lo[1:], n)
    last = first[doc[lo] + 1] - shape.length + 1
    count = np.minimum(stop, last) - lo
    gram = grams[at[lo]]
    end = lo + count - 1 + shape.length
    rid = K.mix(gram + np.uint64(11)) ^ K.span_hash(sums, lo, end)
    return Ranges(lo, count, at[lo], doc[lo], gram, rid, K.span_hash(second, lo, end, 1), sums, second, first)


def _slices(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Ranges]]:
    data, offsets = K.utf8(batch.column("text"))
    for lo, hi in K.slices(offsets):
        yield lo, hi, data, offsets[lo : hi + 1], find_ranges(data, offsets[lo : hi + 1], shape)


def _send_ranges(shape: Shape):
    """(gram, rid, chk, key1_, key2_, m): each distinct range of a document; m is 2 if the document has it more than once."""

    def run(batches):
        for batch in batches:
            key1, key2 = (batch.column(c).to_numpy() for c in KEY)
            for lo, _, _, _, r in _slices(batch, shape):
                order = np.lexsort((r.chk, r.rid, r.doc))
                rid, chk, doc, gram = r.rid[order], r.chk[order], r.doc[order], r.gram[order]
                new = np.ones(len(rid), bool)
                new[1:] = (rid[1:] != rid[:-1]) | (chk[1:] != chk[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                times = np.minimum(np.diff(np.append(begin, len(rid))), 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(K.signed(gram[begin])), pa.array(K.signed(rid[begin])), pa.array(K.signed(chk[begin])), pa.array(key1[lo + doc[begin]]), pa.array(key2[lo + doc[begin]]), pa.array(times, pa.int32())],
                    names=["gram", "rid", "chk", *KEY, "m"],
                )

    return run


def _chosen(batch: pa.RecordBatch, shape: Shape, column: str):
    """For each text with a list in ``column``: its ranges in that list and their entries."""
    lists = batch.column(column)
    for lo, hi, data, offsets, r in _slices(batch, shape):
        begin = np.searchsorted(r.doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            entries = lists[lo + i].as_py()
            if entries:
                found = {(e["rid"], e["chk"]): e for e in entries}
                a, b = int(begin[i]), int(begin[i + 1])
                mine = zip(range(a, b), zip(K.signed(r.rid[a:b]).tolist(), K.signed(r.chk[a:b]).tolist()))
                yield lo + i, data[offsets[i] : offsets[i + 1]], r, [(j, found[x]) for j, x in mine if x in found]


def _send_edges(shape: Shape, wide_only: bool):
    """(rid, chk, weight, edges, second): two hashes of each of a range's windows."""

    def run(batches):
        for batch in batches:
            rids, chks, weights, edges, second = [], [], [], [], []
            for _, _, r, chosen in _chosen(batch, shape, "asked"):
                done = set()
                for j, entry in chosen:
                    name = entry["rid"], entry["chk"]
                    if name not in done and (entry["wide"] or not wide_only):
                        done.add(name)
                        start = np.arange(r.lo[j], r.lo[j] + r.count[j])
                        rids.append(name[0])
                        chks.append(name[1])
                        second.append(K.signed(K.span_hash(r.second, start, start + shape.length, 1)))
                        weights.append(entry["times"])
                        edges.append(K.signed(K.span_hash(r.sums, start, start + shape.length)))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (edges, second)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (rids, chks, weights)), *lists], names=["rid", "chk", "weight", "edges", "second"])

    return run


def repeated_edges(asked_texts: DataFrame, shape: Shape, scratch: Scratch, wide_only: bool) -> DataFrame:
    """(rid, chk, parts): for ranges that occur once, which of their windows occur elsewhere.

    Every window of the ranges is an edge of the de Bruijn graph, named by both
    hashes of its symbols; an edge that occurs twice is repeated.  Counts are
    summed before the shuffle, so a common edge is no hot key.
    """
    sent = scratch.write(asked_texts.mapInArrow(_send_edges(shape, wide_only), "rid long, chk long, weight long, edges array<long>, second array<long>"), "edges")
    rows = sent.select("rid", "chk", "weight", F.posexplode(F.arrays_zip("edges", "second")).alias("off", "e")).select("rid", "chk", "weight", "off", F.col("e.edges").alias("edge"), F.col("e.second").alias("twin"))
    often = rows.groupBy("edge", "twin").agg(F.sum("weight").alias("n")).where("n > 1").select("edge", "twin")
    part = rows.where("weight = 1").join(often.hint("merge"), ["edge", "twin"]).groupBy("rid", "chk").agg(F.collect_set("off").alias("offs"))
    return part.select("rid", "chk", F.flatten(F.transform(F.array_sort("offs"), lambda o: F.array(o, o + 1))).alias("parts"))


def _finish(shape: Shape):
    """Digest columns of every text, given its repeated ranges."""

    def cover(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        for a, b in spans:
            edge[a] += 1
            edge[b] -= 1
        return np.cumsum(edge[:-1]) > 0

    def run(batches):
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            covered: dict[int, np.ndarray] = {}
            for i, _, r, chosen in _chosen(batch, shape, "repeated"):
                doc = r.doc[chosen[0][0]] if chosen else 0
                start, n = int(r.first[doc]), int(r.first[doc + 1] - r.first[doc])
                spans = []
                for j, entry in chosen:
                    parts = entry["parts"] or [0, int(r.count[j])]
                    for a, b in zip(parts[::2], parts[1::2]):
                        spans.append((int(r.lo[j]) - start + a, int(r.lo[j]) - start + b - 1 + shape.length))
                if spans:
                    covered[i] = cover(n, spans)
            total, removed, runs, digest = [], [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                gone = covered.get(i)
                if shape.unit == "word":
                    items = raw.tobytes().split()
                    kept = items if gone is None else list(compress(items, ~gone))
                    total.append(len(items))
                    removed.append(len(items) - len(kept))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    total.append(len(raw))
                    removed.append(0 if gone is None else int(gone.sum()))
                    digest.append(hashlib.sha256((raw if gone is None else raw[~gone]).tobytes()).hexdigest())
                runs.append(0 if gone is None else int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, shape: Shape, resolve: Callable[[DataFrame, Scratch], DataFrame], wide: int, label: str) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256) of every document.

    ``resolve`` gets the texts with the ranges that they are asked for and
    returns (rid, chk, parts).  ``wide``: a gram with more different ranges than that
    is marked wide.  Rows with equal doc_id and text are one document.
    """
    scratch = Scratch(docs.sparkSession, label)
    texts = docs.select("doc_id", *T.row_key_pair(), "text")
    sent = texts.select(*KEY, "text").mapInArrow(_send_ranges(shape), "gram long, rid long, chk long, key1_ long, key2_ long, m int")
    often = sent.groupBy("gram").agg(F.sum("m").alias("n")).where("n > 1").select("gram")
    met = scratch.write(sent.join(often.hint("merge"), "gram").distinct(), "met")

    ranges = met.groupBy("gram", "rid", "chk").agg(F.sum("m").alias("times"), F.min("key1_").alias("key1_"))
    ranges = scratch.write(ranges, "ranges")
    forks = ranges.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    asked = ranges.join(forks.hint("merge"), "gram").select("key1_", F.struct("rid", "chk", F.least("times", F.lit(2)).alias("times"), (F.col("n") > wide).alias("wide")).alias("e"))
    asked = scratch.write(asked.groupBy("key1_").agg(F.collect_list("e").alias("asked")), "asked")
    # Half of a key is enough to ask: a text answers for ranges that it has.  Repeated rows are one document: only one of
    # them answers, or its windows would meet themselves.
    asked_texts = texts.select(*KEY, "text").join(asked.hint("merge"), "key1_").dropDuplicates(KEY)
    parts = resolve(asked_texts, scratch)

    name = ["rid", "chk"]
    once = ranges.where("times = 1").select(*name).join(parts.hint("merge"), name)
    state = ranges.where("times > 1").select(*name, F.lit(None).cast("array<int>").alias("parts")).unionByName(once)
    state = met.select(*name, *KEY).distinct().join(state.hint("merge"), name)
    state = state.groupBy(*KEY).agg(F.collect_list(F.struct(*name, "parts")).alias("repeated"))
    state = scratch.write(state, "state")
    final = texts.join(state.hint("merge"), KEY, "left").select("doc_id", "text", "repeated")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return final.mapInArrow(_finish(shape), f"doc_id {kind}, n long, n_removed long, n_spans long, kept_sha256 string")
