"""Collision counting against brute force."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from taxflow.llm import collision_search as C

CLASH = ["row_id", "vector", "size", "shard", "block", "asks", "score", "rank", "query_id"]


def brute(rows, k=20):
    """{query place: [(vec_id, score)]} over usable rows."""
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for at, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            found = []
            for other, (j, x) in enumerate(good):
                if other != at and len(x) == len(q):
                    score = 0.0
                    for a, b in zip(x.tolist(), q.tolist()):
                        score += a * b
                    found.append((-score, j is None, j or 0))
            out[at] = (i, [(None if none else j, -s) for s, none, j in sorted(found)[:k]])
    return out


def test_threshold():
    assert C.threshold(1, 1e-9) == 0 and C.threshold(64, 0.01) < C.threshold(64, 0.1) < 64 * 0.6827
    p = 0.6826894921
    draws = np.random.default_rng(0).binomial(64, p, 200_000)
    assert (draws < C.threshold(64, 0.01)).mean() <= 0.0115


def test_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = {i: found for i, found in brute(rows).values()}
    for shard_rows, block in ((16384, 1024), (60, 7)):
        got = defaultdict(dict)
        for r in C.nearest_neighbours(frame, shard_rows=shard_rows, block_queries=block).collect():
            got[r.query_id][r["rank"]] = (r.vec_id, r.score)
        assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 21)) for g in got.values())
        hits = sum(len({j for j, _ in g.values()} & {j for j, _ in want[i]}) for i, g in got.items())
        assert hits >= 0.97 * 20 * len(want)


def test_odd_vectors(spark):
    some = np.random.default_rng(3)
    near = lambda: (some.standard_normal(8) * some.choice([0.1, 1, 30])).tolist()  # noqa: E731  very different lengths
    rows = [(i, near()) for i in range(200)]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)] + [(1000, [1.0] * 8)] * 2  # one very common vector, also as repeated rows
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0, None] * 4), (2080, [float("nan")] * 8), (2100, [float("inf")] * 8), (None, near()), (2120, [1.0, 2.0]), (2140, [5.0]), (3, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in CLASH}).repartition(5)
    want = sorted(repr((i, found)) for i, found in brute(rows).values() if found)
    for shard_rows in (16384, 50):
        got = defaultdict(list)
        for r in C.nearest_neighbours(frame, shard_rows=shard_rows).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        lists = []
        for i, found in got.items():
            n = sum(f[0] == 1 for f in found)  # repeated query rows answer alike
            places = sorted(found, key=lambda f: f[0])
            lists += [repr((i, [(j, s) for _, j, s in places[m::n]])) for m in range(n)]
        assert sorted(lists) == want
    assert C.nearest_neighbours(frame.limit(0)).count() == 0
    assert {r.query_id for r in C.nearest_neighbours(frame, F.col("vec_id") == 3, k=1).collect()} == {3}
