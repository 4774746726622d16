"""N-gram Jaccard join by group counts (operator 1).

A document's set is its distinct k-word shingles.  Shingles are hashed into
groups.  A document is a point: the number of its shingles in each of ``DIMS``
groups.  The sum of coordinate minima of two points bounds the size of the
intersection from above, for two rectangles of points the sum of minima of
their upper corners does.  An R-tree over the points prunes pairs by that
bound; pairs that survive are verified on the sets themselves.

Spark deals the points out so that no pair is lost.  For documents of similar
size the threshold allows at most T differing shingles, so of T + 1 groups at
least one has the same content in both.  Rows (content of a group, document)
are shuffled on the content; a block is the documents that share one.  Sizes
are cut into bands by the threshold, and each document takes part in the
scheme of its band and of the next.  Blocks are joined in two rounds:

1. every member is tried against the first documents of its blocks, and of
   those that its point allows the least is verified (a star, so the rows grow
   with the members, not with their square); verified links give components;
2. only in blocks that still span several components, members of different
   components are joined through the R-tree.  Members that share many blocks
   are a pair only in the least of them, as far as both know their least blocks.  Pairs inside one component need
   no test: they cannot change the result.

Documents with equal sets are one class and are joined once.  Points take a
byte a coordinate and come from the first pass over the texts; sets, which are
wide, are made only for the documents of pairs that the points allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxflow.llm import kernels as K
from taxflow.llm.components import connected_components
from taxflow.llm.scratch import Scratch, narrow_side, partitions

#: Coordinates of a point, and of the folded points that bound rectangles.
DIMS = 256
FOLDED = 32
#: Members of a block that are handled at once; larger blocks are cut into pairs of parts.
BLOCK = 4096
#: Entries of an R-tree leaf, nodes below an inner node, and pairs of nodes that are tried at once.
LEAF = 32
FAN = 8
TRIED = 4096
#: Members kept in one row.
CHUNK = 64
#: Least blocks of a member that travel with it, so that a pair which shares many blocks is found in one of them.
LEAST = 16
_NO_BLOCK = 2**63 - 1
#: Spare groups, as a share of T + 1, so that documents can leave out their empty groups.
SPARE = 0.04


def bands(threshold: Fraction, up_to: int) -> np.ndarray:
    """First sizes of the bands: a set links only within its band or the next one."""
    out = [1]
    while out[-1] <= up_to:
        out.append(int(Fraction(out[-1]) / threshold) + 1)
    return np.array(out, dtype=np.int64)


def allowance(threshold: Fraction, first: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    """T of a scheme: most differing shingles of a linked pair from its band and the band below."""
    last = first[1:] - 1
    upper = last[scheme]
    below = np.where(scheme > 0, last[np.maximum(scheme - 1, 0)], upper)
    return np.floor(float((1 - threshold) / (1 + threshold)) * (upper + below) + 1e-9).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, text): the distinct shingles of each text of a slice, sorted by text and value, in 48 bits."""
    words = K.Words(data, offsets)
    sums = K.prefix(words.hashes(lower=True))
    n = np.diff(words.first)
    grams = K.window_hash(sums, k)
    doc = words.doc[: len(grams)]
    inside = doc == words.doc[k - 1 : k - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = K.span_hash(sums, words.first[short], words.first[short + 1])
    hashes = np.concatenate([grams[inside], whole]) >> np.uint64(16)
    doc = np.concatenate([doc[inside], short]).astype(np.uint64)
    if len(n) > 1 << 15:
        raise ValueError("a slice holds too many texts")
    keys = np.unique((doc << np.uint64(48)) | hashes)
    return keys & np.uint64((1 << 48) - 1), (keys >> np.uint64(48)).astype(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.utf8(batch.column("text"))
    for lo, hi in K.slices(offsets):
        for at in range(lo, hi, 1 << 15):
            to = min(hi, at + (1 << 15))
            yield (at, to, *shingle_sets(data, offsets[at : to + 1], k))


def counts(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The points of ``n`` documents, given their shingles."""
    group = (K.mix(h + np.uint64(7)) % np.uint64(DIMS)).astype(np.int64)
    return np.bincount(doc * DIMS + group, minlength=n * DIMS).reshape(n, DIMS)


def _packed_point(point: np.ndarray) -> bytes:
    """A byte a coordinate, or four where one doesn't fit."""
    return point.astype(np.uint8 if point.max(initial=0) < 256 else "<u4").tobytes()


def _points(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), DIMS), np.int32)
    for i, x in enumerate(raw):
        out[i] = np.frombuffer(x, np.uint8 if len(x) == DIMS else "<u4")
    return out


def _sums(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that equal sets share."""
    once, twice = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(once, doc, K.mix(h + np.uint64(1)))
    np.add.at(twice, doc, K.mix(h ^ np.uint64(0x5555AAAA5555AAAA)))
    return once, twice


def _profiles(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("nid")
            for lo, hi, h, doc in _sets(batch, k):
                n = hi - lo
                size = np.bincount(doc, minlength=n)
                once, twice = _sums(h, doc, n)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(size, pa.int64()), pa.array(K.signed(once)), pa.array(K.signed(twice)), pa.array([_packed_point(x) for x in counts(h, doc, n)], pa.binary())],
                    names=["nid", "size", "s1", "s2", "point"],
                )

    return run


def _signatures(k: int, threshold: Fraction):
    """(sig, nid); of equal sets that one task meets only the first is dealt, so copies don't heap up under their signatures."""

    def run(batches):
        first = bands(threshold, 1 << 20)
        met: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("nid").to_numpy(zero_copy_only=False)
            for lo, hi, h, doc in _sets(batch, k):
                n = hi - lo
                once, twice = _sums(h, doc, n)
                if len(met) > 1 << 18:
                    met.clear()
                new = np.array([not (x in met or met.add(x)) for x in zip(once.tolist(), twice.tolist())], bool)
                h, doc = h[new[doc]], doc[new[doc]]
                size = np.bincount(doc, minlength=n)
                if size.max(initial=0) >= first[-2]:
                    first = bands(threshold, int(size.max()) * 2)
                mine = np.searchsorted(first, np.maximum(size, 1), side="right") - 1
                for scheme in (mine, mine + 1):
                    need = allowance(threshold, first, scheme) + 1
                    groups = need + np.ceil(SPARE * need).astype(np.int64) * (need > 8)
                    base = np.concatenate([[0], np.cumsum(groups)])
                    at = base[doc] + (K.mix(h + np.uint64(13)) % groups[doc].astype(np.uint64)).astype(np.int64)
                    content = np.zeros(base[-1], np.uint64)
                    np.add.at(content, at, K.mix(h + np.uint64(3)))
                    filled = np.bincount(at, minlength=base[-1]) > 0
                    owner = np.repeat(np.arange(n), groups)
                    full = np.add.reduceat(filled, base[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
                    # with T + 1 filled groups one of those is shared, so the empty ones are not needed
                    keep = (filled | (full < need)[owner]) & (size > 0)[owner]
                    place = np.arange(base[-1]) - base[:-1][owner]
                    salt = (scheme[owner] * (1 << 32) + place).astype(np.uint64)
                    sig = K.mix(content + K.mix(salt + np.uint64(1)))[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(sig)), pa.array(ids[lo:hi][owner[keep]], pa.int64())], names=["sig", "nid"])

    return run


def _blocks(batches):
    """From rows sorted by (sig, nid): the members of each sig with several, in chunks, with the block's first."""
    open_sig, hub, held = None, None, np.zeros(0, np.int64)
    seen: set[int] = set()

    def chunks(sig, nid, final):
        nonlocal open_sig, hub, held
        if open_sig is not None:
            sig = np.concatenate([np.full(len(held), open_sig), sig])
            nid = np.concatenate([held, nid])
        if not len(sig):
            return None
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        same = np.zeros(len(sig), bool)
        same[1:] = ~new[1:] & (nid[1:] == nid[:-1])
        sig, nid, new = sig[~same], nid[~same], new[~same]
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(sig)))
        hubs = nid[begin].copy()
        whole = np.ones(len(begin), bool)
        if open_sig is not None and sig[0] == open_sig and hub is not None:
            hubs[0], whole[0] = hub, False
        last = len(begin) - 1
        cut = 0 if final else length[last]
        next_sig, next_hub = sig[begin[last]], None
        if not final:
            # members of an open run beyond full chunks wait for the next batch
            ready = (length[last] - 1) // CHUNK * CHUNK
            if ready or not whole[last]:
                next_hub, whole[last] = hubs[last], False
            cut = length[last] - ready
        held = nid[len(nid) - cut :] if cut else np.zeros(0, np.int64)
        total = length.copy()
        length[last] -= cut
        pieces = -(-length // CHUNK)
        run = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = begin[run] + nth * CHUNK
        hi = np.minimum(lo + CHUNK, begin[run] + length[run])
        small = whole[run] & (total[run] <= CHUNK)
        use = (hi - lo >= 2) | ~small
        run, lo, hi, small = run[use], lo[use], hi[use], small[use]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(nid.view(np.uint64) + np.uint64(5)))])
        part = K.mix(sums[hi] - sums[lo] + (hi - lo).astype(np.uint64))
        block = np.where(small, part, K.mix(sig[begin[run]].view(np.uint64)))
        open_sig, hub = next_sig, next_hub
        if not len(run):
            return None
        fresh = [i for i, (b, p) in enumerate(zip(block.tolist(), part.tolist())) if not ((b ^ (p << 1)) in seen or seen.add(b ^ (p << 1)))]
        if len(seen) > 1 << 18:
            seen.clear()
        run, lo, hi, block, part = run[fresh], lo[fresh], hi[fresh], block[fresh], part[fresh]
        at = np.concatenate([[0], np.cumsum(hi - lo)])
        index = np.arange(at[-1]) - np.repeat(at[:-1] - lo, hi - lo)
        members = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(nid[index]))
        return pa.RecordBatch.from_arrays([pa.array(K.signed(block)), pa.array(K.signed(part)), pa.array(hubs[run]), members], names=["block", "part", "hub", "members"])

    for batch in batches:
        out = chunks(batch.column(0).to_numpy(), batch.column(1).to_numpy(), False)
        if out is not None and out.num_rows:
            yield out
    out = chunks(np.zeros(0, np.int64), np.zeros(0, np.int64), True)
    if out is not None and out.num_rows:
        yield out


def _possible(threshold: Fraction, common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether an intersection of ``common`` can reach the threshold for these sums of sizes."""
    p, q = threshold.numerator, threshold.denominator
    return common.astype(np.int64) * (p + q) >= p * sizes.astype(np.int64)


def _bounded(threshold: Fraction):
    """Pairs whose points allow a link."""

    def run(batches):
        for batch in batches:
            a, b = _points(batch.column("px")), _points(batch.column("py"))
            keep = _possible(threshold, np.minimum(a, b).sum(1), a.sum(1) + b.sum(1))
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    return run


class RTree:
    """A packed R-tree: entries in order of size and strongest coordinate, leaves of LEAF entries, inner nodes of FAN nodes.

    A node is the upper corner of its rectangle and its least size.  Level 0 has
    the entries themselves.
    """

    def __init__(self, points: np.ndarray):
        size = points.sum(1)
        self.order = np.lexsort((points.argmax(1), size))
        self.levels = [(np.zeros(0, np.int64), points[self.order], size[self.order])]  # first children, corners, sizes
        while len(self.levels) == 1 or len(self.levels[-1][1]) > 1:
            _, top, least = self.levels[-1]
            begin = np.arange(0, len(top), LEAF if len(self.levels) == 1 else FAN)
            self.levels.append((begin, np.maximum.reduceat(top, begin, axis=0), np.minimum.reduceat(least, begin)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, child one level down) of all children."""
        begin, below = self.levels[level][0], len(self.levels[level - 1][1])
        n = np.append(begin[1:], below)[nodes] - begin[nodes]
        place = np.repeat(np.arange(len(nodes)), n)
        return place, begin[nodes][place] + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)


def rtree_join(points: np.ndarray, other: np.ndarray, threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two point sets that the sum of coordinate minima doesn't rule out.

    Pairs of nodes are followed from the roots down, the higher one first; a
    pair is opened only if the bound of its corners allows a link.
    """
    if not len(points) or not len(other):
        return
    a, b = RTree(points), RTree(other)
    left, right = len(a.levels) - 1, len(b.levels) - 1
    open_ = [(left, right, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while open_:
        left, right, i, j = open_.pop()
        if len(i) > TRIED:
            open_ += [(left, right, i[TRIED:], j[TRIED:])]
            i, j = i[:TRIED], j[:TRIED]
        (_, ta, sa), (_, tb, sb) = a.levels[left], b.levels[right]
        ok = _possible(threshold, np.minimum(ta[i], tb[j]).sum(1), sa[i] + sb[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if left == right == 0:
            yield a.order[i], b.order[j]
        elif left >= right:
            at, i = a.children(left, i)
            open_.append((left - 1, right, i, j[at]))
        else:
            at, j = b.children(right, j)
            open_.append((left, right - 1, i[at], j))


def _least_blocks(column: pa.Array) -> np.ndarray:
    """A row of LEAST blocks for each list, filled up with the greatest number."""
    out = np.full((len(column), LEAST), _NO_BLOCK)
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out[np.arange(LEAST) < n[:, None]] = column.flatten().to_numpy()
    return out


def _met_before(block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two members' least blocks have one in common that is less than ``block``."""
    return ((a[:, :, None] == b[:, None, :]) & (a < block)[:, :, None]).any((1, 2))


def _cross(threshold: Fraction):
    """From rows sorted by (block, pb, qb): pairs of different components within a block.

    Nothing is left out in the least block that two members share, so every pair
    comes out at least once.
    """

    def emit(block, rows):
        cid, comp, side, fine, least = rows
        point = fine.reshape(len(fine), DIMS // FOLDED, FOLDED).sum(1)
        size = point.sum(1)
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        for i, j in rtree_join(point[left], point[right], threshold):
            i, j = left[i], right[j]
            keep = comp[i] != comp[j]
            if (side == 0).all():
                keep &= cid[i] < cid[j]
            i, j = i[keep], j[keep]
            keep = _possible(threshold, np.minimum(fine[i], fine[j]).sum(1), size[i] + size[j])
            i, j = i[keep], j[keep]
            keep = ~_met_before(block, least[i], least[j])
            a, b = cid[i][keep], cid[j][keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "pb", "qb")])
            rows = [batch.column(c).to_numpy() for c in ("cid", "comp", "side")] + [_points(batch.column("point")), _least_blocks(batch.column("least"))]
            begin = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if batch.num_rows else []
            for lo, hi in zip(begin, [*begin[1:], batch.num_rows]):
                now, part = tuple(keys[:, lo]), [x[lo:hi] for x in rows]
                if now != key and held:
                    yield from emit(key[0], [np.concatenate(x) for x in zip(*held)])
                    held = []
                key = now
                held.append(part)
        if held:
            yield from emit(key[0], [np.concatenate(x) for x in zip(*held)])

    return run


def _packed_sets(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("nid")
            for lo, hi, h, doc in _sets(batch, k):
                raw = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                at = np.searchsorted(doc, np.arange(hi - lo + 1)) * 6
                packed = [raw.reshape(-1)[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["cid", "shingles"])

    return run


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _verified(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def run(batches):
        for batch in batches:
            a, b, keep = batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), []
            for x, y in zip(a, b):
                both = np.concatenate([_unpack(x), _unpack(y)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(q * common >= p * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def ngram_jaccard_groups(docs: DataFrame, k: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """Sizes and components of the documents' shingle sets.

    ``docs``: doc_id long, text string (further columns are not read).
    Returns doc_id, n_shingles long, component_id long: the smallest doc_id
    reachable by links, itself included.  Two documents link when the Jaccard
    similarity of their sets is at least ``threshold``.

    Null or word-less text: n_shingles 0, component_id its own doc_id.  A text
    of fewer than ``k`` words has one shingle, the whole sequence.  Rows that
    share a doc_id each get a row; the id stands for all their texts.  A null
    doc_id takes part; component_id is null if no linked row has an id.  An
    empty table gives no rows.
    """
    threshold = Fraction(threshold)
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "ngram-join"), partitions(spark)
    # rows without an id get one that sorts after all others
    nid = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1) - F.shiftrightunsigned(F.xxhash64("text"), 3))
    narrow = docs.select(nid.alias("nid"), "text")

    profile = scratch.write(narrow.mapInArrow(_profiles(k), "nid long, size long, s1 long, s2 long, point binary"), "profile")
    filled = profile.where("size > 0")
    classes = scratch.write(filled.groupBy("size", "s1", "s2").agg(F.min("nid").alias("cid")), "classes")
    member_of = filled.select("nid", "size", "s1", "s2").join(classes.hint("merge"), ["size", "s1", "s2"]).select("nid", "cid").distinct()
    member_of = scratch.write(member_of, "members")

    dealt = narrow.mapInArrow(_signatures(k, threshold), "sig long, nid long").repartition(parts, "sig").sortWithinPartitions("sig", "nid")
    blocks = dealt.mapInArrow(_blocks, "block long, part long, hub long, members array<long>")
    blocks = scratch.write(blocks.dropDuplicates(["block", "part"]), "blocks")

    def as_class(df: DataFrame, column: str, name: str) -> DataFrame:
        to = member_of.select(F.col("nid").alias(column), F.col("cid").alias(name))
        return df.join(to.hint("merge"), column).drop(column)

    def with_point(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(profile.select(F.col("nid").alias(column), F.col("point").alias(name)).hint("merge"), column)

    placed = as_class(as_class(blocks.select("block", "hub", F.explode("members").alias("nid")).distinct(), "nid", "x"), "hub", "y")
    placed = scratch.write(placed.distinct(), "placed")
    scratch.drop("blocks")

    # first round: of each class the least hub that its point allows
    stars = with_point(with_point(placed.where("x <> y").select("x", "y").distinct(), "y", "py"), "x", "px")
    stars = stars.select("x", "y", "px", "py").mapInArrow(_bounded(threshold), "x long, y long").groupBy("x").agg(F.min("y").alias("y"))
    stars = scratch.write(stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "stars")

    def verify(pairs: DataFrame, label: str) -> DataFrame:
        """The links among written pairs, on sets from one pass over the texts."""
        wanted = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), f"wanted-{label}")
        sets = scratch.write(narrow.join(narrow_side(wanted), "nid").mapInArrow(_packed_sets(k), "cid long, shingles binary"), f"sets-{label}")
        one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.hint("shuffle_hash").join(one, "a").hint("merge").join(two, "b")
        links = scratch.write(both.select("a", "b", "sa", "sb").mapInArrow(_verified(threshold), "a long, b long"), f"links-{label}")
        scratch.drop(f"wanted-{label}", f"sets-{label}")
        return links

    links = verify(stars, "1")
    first = connected_components(links, scratch, "cc-1")

    # second round: blocks that span several components
    rows = placed.select("block", F.col("x").alias("cid")).distinct().join(first.select(F.col("node").alias("cid"), "component").hint("merge"), "cid", "left")
    rows = scratch.write(rows.select("block", "cid", F.coalesce("component", "cid").alias("comp")), "rows")
    open_blocks = rows.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"))
    open_blocks = open_blocks.where("x <> y").select("block", F.ceil(F.col("m") / BLOCK).cast("int").alias("n_parts"))
    rows = rows.join(open_blocks.hint("merge"), "block")
    mine = F.pmod(F.xxhash64("cid"), F.col("n_parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("block"))
    least = F.collect_list(F.when(F.col("nth") <= LEAST, F.col("block"))).over(Window.partitionBy("cid"))
    rows = rows.withColumn("nth", nth).withColumn("least", least)
    rows = with_point(rows, "cid", "point").select("block", "cid", "comp", "point", "least", mine.alias("p"), other.alias("o")).select(
        "block", F.least("p", "o").alias("pb"), F.greatest("p", "o").alias("qb"), F.signum(F.col("p") - F.col("o")).cast("int").alias("side"), "cid", "comp", "point", "least"
    )
    rows = rows.repartition(parts, "block", "pb", "qb").sortWithinPartitions("block", "pb", "qb")
    pairs = rows.mapInArrow(_cross(threshold), "a long, b long").distinct()
    pairs = scratch.write(pairs.join(stars.hint("merge"), ["a", "b"], "left_anti"), "pairs-2")
    scratch.drop("placed", "rows")
    final = connected_components(links.unionByName(verify(pairs, "2")), scratch, "cc-2")

    label = classes.join(final.select(F.col("node").alias("cid"), "component").hint("merge"), "cid", "left")
    label = label.select("size", "s1", "s2", F.coalesce("component", "cid").alias("component"))
    result = profile.select("nid", "size", "s1", "s2").join(label.hint("merge"), ["size", "s1", "s2"], "left")
    ids = F.coalesce("component", "nid")
    nameless = F.lit(2**63 - 1) - F.lit(2**61)
    return result.select(
        F.when(F.col("nid") < nameless, F.col("nid")).alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.when(ids < nameless, ids).alias("component_id"),
    )


def keep_one_of_each_group(docs: DataFrame, k: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the smallest doc_id stays.

    All columns are kept.  Rows without a doc_id and rows without words stay.
    Of several rows with one doc_id all stay or go together.
    """
    groups = ngram_jaccard_groups(docs, k, threshold)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    gone = Scratch(docs.sparkSession, "ngram-gone").write(gone, "gone")
    return docs.join(narrow_side(gone), "doc_id", "left_anti")
