"""Nearest neighbours by collision counting, with query-centred windows on sorted projections.

Every vector is projected on M random lines.  In one shard of rows the
projections on a line are a sorted array.  A query's windows are centred on its
own projections and widened level by level; a row that lies in L of the M
windows of a level is verified with the inner product.  A query is through
with a shard as soon as K verified rows are no farther than the level's radius:
a row within that radius has been verified with probability ``1 - MISS``.

Largest inner product is nearest distance once each vector gets a further
component that makes all of a shard equally long, and the query is scaled to
that length with 0 there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxflow.llm.scratch import Scratch

K = 20
#: Lines to project on, and half the width of a window of radius 1.
M, HALF_WIDTH = 40, 1.0
#: Probability that a row at the radius has fewer collisions than the threshold.
MISS = 0.01
#: Radii grow by this factor, from this part of the common length on.
GROWTH, FIRST_RADIUS = 1.15, 0.1
#: Rows of a shard and queries of a block, on average; a task holds one of each.
SHARD_ROWS, BLOCK_QUERIES = 32768, 1024
SEED = 42
_FOUND = "query_row bigint, query_id bigint, vec_id bigint, score double"


def threshold(m: int = M, miss: float = MISS, half_width: float = HALF_WIDTH) -> int:
    """The largest L with P(Binomial(m, p) < L) <= miss, p being the chance that a row at the radius lies in a window."""
    p = math.erf(half_width / math.sqrt(2))
    below, want = 0.0, 0
    while below <= miss:
        below += math.comb(m, want) * p**want * (1 - p) ** (m - want)
        want += 1
    return want - 1


def lines(d: int, m: int = M) -> np.ndarray:
    """``m`` lines in d + 1 dimensions; the same in every task."""
    return np.random.default_rng((SEED, d)).standard_normal((d + 1, m))


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so that equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(rows))
    for j in range(len(query)):
        out += rows[:, j] * query[j]
    return out


class Shard:
    """The sorted arrays of one shard of vectors, all of one length."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, m: int = M, miss: float = MISS):
        self.ids, self.keys, self.vectors = ids, keys, vectors
        self.want, self.m = threshold(m, miss), m
        norms = np.sqrt((vectors**2).sum(1))
        self.length = float(norms.max())
        steps = math.ceil(math.log(2 / FIRST_RADIUS, GROWTH))
        self.radii = FIRST_RADIUS * self.length * GROWTH ** np.arange(steps + 1)  # up to two lengths: no row is farther
        extra = np.sqrt(np.maximum(self.length**2 - norms**2, 0))
        self.rough = vectors.astype(np.float32)  # for choosing; what is returned is computed anew from the doubles
        self.lines = lines(vectors.shape[1], m)
        found = np.column_stack([vectors, extra]) @ self.lines
        self.order = np.ascontiguousarray(np.argsort(found, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(found.T, self.order, axis=1))

    def search_all(self, keys: list[int], queries: np.ndarray, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k nearest found for each query, without the row of its key; nearest first, ties by id."""
        scales = self.length / np.sqrt((queries**2).sum(1))
        centres = (queries * scales[:, None]) @ self.lines[:-1]
        # windows of all radii on each line, as ranges of the sorted array; one of radius 0 is empty
        reach = HALF_WIDTH * self.radii
        ends = np.concatenate([-reach[::-1], [0.0], reach])
        cuts = np.stack([np.searchsorted(line, centres[:, i, None] + ends) for i, line in enumerate(self.sorted)], axis=1)
        for key, query, scale, cut in zip(keys, queries, scales, cuts):
            yield self._search(key, query, float(scale), cut, k)

    def _search(self, key: int, query: np.ndarray, scale: float, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, rough = len(self.ids), query.astype(np.float32)
        last, zero = len(self.radii) - 1, len(self.radii)
        counts = np.zeros(n, dtype=np.int64)
        open_ = self.keys != key  # neither verified nor the query's own row
        near, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        for level, radius in enumerate(self.radii):
            # the windows of this radius without those of the one before, on both sides
            lo, hi = cut[:, zero - level - 1 : zero - level + 1].tolist(), cut[:, zero + level : zero + level + 2].tolist()
            new = [line[x[0] : x[1]] for sides in (lo, hi) for line, x in zip(self.order, sides) if x[0] < x[1]]
            if new:
                counts += np.bincount(np.concatenate(new), minlength=n)
            hit = np.flatnonzero(open_ if level == last else open_ & (counts >= self.want))
            if len(hit):
                open_[hit] = False
                near = np.concatenate([near, hit])
                found = (self.rough @ rough)[hit] if 3 * len(hit) > n else self.rough[hit] @ rough  # one product is cheaper than to gather many rows
                scores = np.concatenate([scores, found])
            # distance ** 2 is 2 * length ** 2 - 2 * scale * score
            if len(near) >= k and np.count_nonzero(2 * self.length**2 - 2 * scale * scores <= radius**2) >= k:
                break
        if len(near) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = near[scores >= least - 1e-5 * self.length * self.length / scale]  # more than rounding can shift
        scores = inner_products(self.vectors[near], query)
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near[best]], scores[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as integers; a null, which comes last among ties, as the largest."""
    return column.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _search(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(rows) and len(asked):
            shard = Shard(_ids(rows["vec_id"]), rows["row_id"].to_numpy(), _matrix(rows["vector"]))
            keys = asked["row_id"].to_pylist()
            for key, own, (ids, scores) in zip(keys, asked["vec_id"].to_pylist(), shard.search_all(keys, _matrix(asked["vector"]), k)):
                out[0].append(np.full(len(ids), key))
                out[1].append(np.full(len(ids), own))
                out[2].append(ids)
                out[3].append(scores)
        names = ("query_row", "query_id", "vec_id", "score")
        arrays = [pa.array(np.concatenate(x) if x else [], pa.float64() if c == "score" else pa.int64()) for c, x in zip(names, out)]
        last = arrays[2]
        arrays[2] = pc.if_else(pc.equal(last, np.iinfo(np.int64).max), pa.scalar(None, pa.int64()), last)
        return pa.Table.from_arrays(arrays, names=list(names))

    return run


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(table: DataFrame, queries: Column | None = None, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each query row.

    ``queries``: which rows of the table ask (default: ids divisible by 20).
    Candidates are all rows but the query's own; rows with other numbers of
    components than the query's are no candidates.  Scores are inner products of the
    vectors as given, in double precision; ties go to the smaller id, a null id last.

    Rows are dealt into shards by a hash of their place, each of which is met by
    each block of queries; only K rows a query and shard leave a task.  Vectors
    that are null, empty, zero, or hold null or non-finite components take no
    part.  Repeated rows are rows of their own: each is asked and found.  Fewer
    than k candidates give fewer rows, an empty table none.  Other columns are
    not read, whatever their names.
    """
    scratch = Scratch(table.sparkSession, "neighbours")
    asks = F.coalesce(F.col(id_column) % 20 == 0 if queries is None else queries, F.lit(False))
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), asks.alias("asks"))
    rows = rows.where(usable(F.col("vector"))).withColumn("row_id", F.monotonically_increasing_id()).withColumn("size", F.size("vector"))
    rows = scratch.write(rows, "rows")
    asked = rows.where("asks")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()  # two numbers
    n_shards, n_blocks = max(1, math.ceil(total["n"] / shard_rows)), max(1, math.ceil(total["q"] / block_queries))
    shard, block = F.pmod(F.xxhash64("row_id"), F.lit(n_shards)), F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(n_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    columns = ["row_id", "vec_id", "vector"]
    left = rows.select("size", shard.alias("shard"), every(n_blocks).alias("block"), *columns)
    right = asked.select("size", every(n_shards).alias("shard"), block.alias("block"), *columns)
    found = left.groupBy("size", "shard", "block").cogroup(right.groupBy("size", "shard", "block")).applyInArrow(_search(k), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
