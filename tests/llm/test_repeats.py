import random

import pytest

from taxflow.llm.debruijn import substring_dedup
from taxflow.llm.suffix_intervals import maximal_repeats, prefix_intervals, suffix_array_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(200)]
    shared = [[rnd.choice(vocab) for _ in range(rnd.choice([20, 34, 35, 36, 60, 150, 300]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.5:
                s = rnd.choice(shared)
                a = rnd.randrange(len(s))
                w += s[a : a + rnd.randint(10, 300)]
            else:
                w += [rnd.choice(vocab) for _ in range(rnd.randint(1, 80))]
        if w and rnd.random() < 0.2:
            w = w + w[: rnd.randint(1, len(w))]
        rows.append((i, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "is on " * 400), (n + 4, "on is " * 90), (n + 5, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {d: (a, b, h) for d, (a, b, _, h) in brute.remove_repeats(rows, 35, "word").items()}
    assert sum(b for _, b, _ in got.values()) > 1000


@pytest.mark.parametrize("wide", [256, 2])
def test_bytes(spark, wide):
    rows = corpus(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), wide=wide).collect()}
    assert got == brute.remove_repeats(rows, 400, "byte")
    assert sum(x[1] for x in got.values()) > 5000


@pytest.mark.parametrize("operator", [substring_dedup, suffix_array_dedup])
def test_edges(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"word{i}" for i in range(100))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, None)], SCHEMA + ", rid string")
    assert sorted(r.n_removed for r in operator(df).collect()) == [0, 0, 0]
    df = spark.createDataFrame([(None, text), (2, text)], SCHEMA)
    assert all(r.n_removed > 0 for r in operator(df).collect())


@pytest.mark.parametrize("wide", [16384, 1])
@pytest.mark.parametrize("operator", [substring_dedup, suffix_array_dedup])
def test_repeated_rows_with_a_fork(spark, operator, wide):
    # the third text shares a stretch with the first that holds chosen grams, but is shorter than a window
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(10))
    text = [word() for _ in range(400)]
    rows = [(1, " ".join(text)), (1, " ".join(text))]
    rows += [(2 + i, " ".join([word() for _ in range(60)] + text[a : a + 30] + [word() for _ in range(60)])) for i, a in enumerate(range(20, 360, 40))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = (operator(df) if operator is substring_dedup else operator(df, wide=wide)).collect()
    assert len(got) == len(rows) and {r.n_removed for r in got} == {0}


def test_passages_of_over_50_words(spark):
    # the contract counts bytes, not words: of passages of 52 words those of 400 bytes go and those of 399 stay
    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for size in (370, 399, 400, 401):
        passage = prose(52)
        passage += "q" * (size - len(passage))
        for ends in ("xy", "zv"):  # nothing beside the passages is equal
            want[len(rows)] = size if size >= 400 else 0
            rows.append((len(rows), prose(90) + ends[0] + passage + ends[1] + prose(90)))
    for _ in range(8):
        want[len(rows)] = 0
        rows.append((len(rows), prose(240)))
    got = suffix_array_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.n_removed for r in got} == want
    assert all(r.n_bytes == len(rows[r.doc_id][1]) and r.n_spans == (r.n_removed > 0) for r in got)


def test_intervals():
    assert sorted(prefix_intervals([0, 2, 2, 1])) == [(1, 0, 3), (2, 0, 2)]
    got = maximal_repeats([b"abcx", b"abcy", b"abz"], [b"qr", b"qs", b"qr"], 4)
    assert got == [[(2, 2)], [(1, 3)], [(2, 2)]] or got[0] == [(1, 3), (2, 2)]
