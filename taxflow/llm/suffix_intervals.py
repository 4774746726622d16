"""Suffix-array dedup by common-prefix intervals (operator 10).

Suffixes that start at a repeated gram are grouped by it.  In a group the
suffixes are sorted, with the lengths of the common prefixes of neighbours
beside them (an enhanced suffix array).  A scan with a stack gives the tree of
common-prefix intervals: all occurrences of one right extension.  Within an
interval the left contexts are compared; where they differ the repeat is
maximal to the left.  Each occurrence takes its longest left match there, and
left and right match together are a maximal repeat.  See ``taxflow.llm.repeats``
for how grams are chosen and groups dealt out.  A group with more than ``WIDE``
different contexts isn't sorted in one task: its windows are joined as hashed
rows instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxflow.llm.repeats import Shape, _chosen, remove_repeats, repeated_edges
from taxflow.llm.scratch import Scratch, partitions

LENGTH = 400
GRAM = 120
#: Different contexts of one gram that a task sorts, about 10 MB; beyond, windows are joined as rows.
WIDE = 16384


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every common-prefix interval of a sorted list; lcp[i] is that of entries i-1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, left = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            yield length, left, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each occurrence its (left match, right match) pairs of ``length`` or more in all.

    ``lefts`` are reversed: they start beside the gram.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    rank = {x: i for i, x in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    lcp = [0] + [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    found: list[list[tuple[int, int]]] = [[] for _ in rights]
    for right, first, last in prefix_intervals(lcp):
        if right + max(len(lefts[x]) for x in order[first : last + 1]) < length:
            continue
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        beside = [0, *[common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:])], 0]
        for i, x in enumerate(members):
            left = max(beside[i], beside[i + 1])
            if left + right >= length:
                found[x].append((left, right))
    return found


def _send_contexts(shape: Shape):
    def run(batches):
        for batch in batches:
            rows = []
            for _, raw, r, chosen in _chosen(batch, shape, "asked"):
                done = set()
                for j, entry in chosen:
                    name = entry["rid"], entry["chk"]
                    if name not in done and not entry["wide"]:
                        done.add(name)
                        start = int(r.first[r.doc[j]])
                        a, b = int(r.lo[j]) - start, int(r.lo[j] + r.count[j]) - start - 1 + shape.length
                        rows.append((int(r.gram[j].view(np.int64)), *name, entry["times"], int(r.at[j] - r.lo[j]), raw[a:b].tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["gram", "rid", "chk", "times", "at", "content"])

    return run


def _resolve_groups(length: int):
    def group(rows) -> Iterator[tuple[int, int, list[int]]]:
        rights = [x[4][x[3] :] for x in rows]
        lefts = [x[4][: x[3]][::-1] for x in rows]
        for (rid, chk, times, at, content), pairs in zip(rows, maximal_repeats(rights, lefts, length)):
            if times == 1 and pairs:
                parts: list[int] = []
                for a, b in sorted((at - left, min(at + right, len(content)) - length + 1) for left, right in pairs):
                    if parts and a <= parts[-1]:
                        parts[-1] = max(parts[-1], b)
                    else:
                        parts += [a, b]
                yield rid, chk, parts

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for gram, *row in zip(*[batch.column(c).to_pylist() for c in ("gram", "rid", "chk", "times", "at", "content")]):
                if gram != key and held:
                    out += group(held)
                    held = []
                key = gram
                held.append(row)
            yield _parts(out)
        if held:
            yield _parts(list(group(held)))

    return run


def _parts(out: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))]
    return pa.RecordBatch.from_arrays(columns, names=["rid", "chk", "parts"])


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept_sha256 of every document.

    Removed is each UTF-8 byte that lies in a string of ``length`` bytes that
    also starts anywhere else in the table, the same document included and
    overlaps counted.  n_spans counts the maximal removed runs.

    Null and empty texts have no bytes and the digest of the empty string.  Rows
    with equal doc_id and text are one document, not repeats of each other;
    equal texts under different ids, null included, are repeats.  Further
    columns are not read.  An empty table gives no rows.
    """
    shape = Shape("byte", length, max(1, min(GRAM, length - 1)))

    def resolve(texts: DataFrame, scratch: Scratch) -> DataFrame:
        contexts = texts.mapInArrow(_send_contexts(shape), "gram long, rid long, chk long, times long, at int, content binary")
        dealt = contexts.repartition(partitions(texts.sparkSession), "gram").sortWithinPartitions("gram")
        narrow = scratch.write(dealt.mapInArrow(_resolve_groups(length), "rid long, chk long, parts array<int>"), "intervals")
        return narrow.unionByName(repeated_edges(texts, shape, scratch, wide_only=True))

    found = remove_repeats(docs, shape, resolve, wide, label="suffixes")
    return found.select("doc_id", found["n"].alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
