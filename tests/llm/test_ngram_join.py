import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxflow.llm.ngram_join import keep_one_of_each_group, ngram_jaccard_groups, rtree_join
from tests.llm.brute import jaccard_groups

SCHEMA = "doc_id long, text string"


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    hot = " ".join(rnd.choice(vocab) for _ in range(9))
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            w = (rnd.choice(rows)[1] or "x").split(" ")
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                j = rnd.randrange(len(w))
                w[j : j + rnd.randint(0, 1)] = [rnd.choice(vocab)]
            text = " ".join(w)
        else:
            text = " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 12, 40, 90, 200])))
        if rnd.random() < 0.2:
            text = hot + "\n" + text
        rows.append((i, text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one")]


@pytest.mark.parametrize("seed,k,t", [(1, 4, "0.85"), (2, 5, "0.8")])
def test_equals_brute_force(spark, seed, k, t):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), k, t).collect()}
    assert got == jaccard_groups(rows, k, t)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rtree_equals_all_pairs(seed):
    rnd = np.random.default_rng(seed)
    a = rnd.poisson(rnd.choice([1, 3, 9], (700, 1)), (700, 8)).astype(np.int32)
    b = np.concatenate([a[:300] + rnd.poisson(0.1, (300, 8)), rnd.poisson(4, (5, 8))]).astype(np.int32)
    threshold = Fraction("0.8")
    got = [p for i, j in rtree_join(a, b, threshold) for p in zip(i.tolist(), j.tolist())]
    least, sizes = np.minimum(a[:, None], b[None]).sum(2), a.sum(1)[:, None] + b.sum(1)[None]
    every = {(i, j) for i, j in zip(*map(list, np.nonzero(9 * least >= 4 * sizes)))}
    assert len(got) == len(set(got)) and set(got) == every and len(every) > 100
    assert not list(rtree_join(a, b[:0], threshold)) and len(list(rtree_join(a[:1], a[:1], threshold))) == 1


def test_many_exact_copies(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50_000 == 7, text + " end").otherwise(text).alias("text"))
    assert [tuple(r) for r in ngram_jaccard_groups(docs).groupBy("component_id").count().collect()] == [(0, 100_000)]


def test_edges(spark):
    assert ngram_jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(None, text, 1), (7, text, 2), (7, text, 2), (9, "b " * 90_000, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", nid int")
    got = sorted(ngram_jaccard_groups(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 56, 7), (7, 56, 7), (7, 56, 7), (9, 1, 9)]
    assert sorted(r.nid for r in keep_one_of_each_group(df).collect()) == [1, 2, 2, 3]
