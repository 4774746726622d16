"""Merkle manifest and fill-in-the-middle against plain Python; both also have SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxflow.llm import fill_in_middle as fim
from taxflow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = ["g", "n", "pos", "raw", "item", "path", "members", "rid", "at", "now", "c0", "p1", "output", "form"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof digest and folded root of each row, with lists and loops."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(value, r))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = range(k // 3 * 3, min(k // 3 * 3 + 3, len(nodes)))
                paths[i].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
            nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [k // 3 for k in at]
        return (nodes or [""])[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, above = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), up in zip(trees, above):
        for r, path in zip(own, paths):
            cut = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = leaf((*r[:4], r[4].replace("\n", "")) if cut else r)
            for left, right in path + up:
                acc = h(left, acc, right)
            out.append((r[0], leaf(r), subroot, root, h(*[x for p in path + up for x in p]), acc, acc == root))
    return out


@pytest.mark.parametrize("n", [1, 4, 200])
def test_manifest(spark, n):
    some = random.Random(n)
    names = ["a", "a", "a", "é", "z", None, "", "lone"][: max(1, n)]
    rows = [(i // 2 if i % 5 else None, some.choice(names), some.choice(["en", None, ""]), some.choice([None, 7]), some.choice([None, "", "x\ny", "ü\n\n" * 3, "word " * i])) for i in range(n)]
    rows += rows[: n // 3]  # repeated rows
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in CLASH}).repartition(3)
    got = merkle.merkle_manifest(frame, merkle.tampered_text()).drop("proof").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_empty_and_unchanged(spark):
    frame = spark.createDataFrame([(i, "s", "en", 1, f"line\n{i}") for i in range(90)] + [(7, None, None, None, "x" * 3_000_000)], SCHEMA)
    assert merkle.merkle_manifest(frame.limit(0)).count() == 0
    assert {r.verified for r in merkle.merkle_manifest(frame).collect()} == {True}
    one = merkle.merkle_manifest(frame, F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text"))).where("NOT verified").collect()
    assert [r.doc_id for r in one] == [5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300), st.data())
def test_skip_list(widths, data):
    if widths:
        rank = data.draw(st.integers(0, len(widths)))
        assert fim.SkipList(np.array(widths)).chars_before(rank) == sum(widths[:rank])


def test_skip_list_is_short():
    widths = np.random.default_rng(1).integers(1, 9, 100_000)
    tokens, sums = fim.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    assert 6 <= len(tokens.lanes) <= 12
    assert all(tokens.chars_before(r) == sums[r] for r in (0, 1, 99_999, 100_000, 31_337))


def test_fill_in_middle(spark):
    texts = [None, "", " ", "\n\t \n", "one", " two words\n", "é à ü \x0b\x0c", "a <M> b", "x<P", "    nbsp", "😀 😀😀 end ", "same " * 40_000, "y" * 200_000, "l\n" * 30_000]
    rows = [(i + 100 * j, t) for j in range(8) for i, t in enumerate(texts)] + [(None, "no id"), (5, texts[5]), (5, texts[5])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH if c not in ("n", "output", "form")} | {"N": F.lit(3)})
    made = fim.fill_in_middle(frame).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = made.collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"} and all(r.path == 7 for r in got)
    import re

    for r in got:
        text = r.text or ""
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        assert r.back == text and r.n == len(tokens)
        key = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        a, b = sorted(int(key[k : k + 8], 16) % (len(tokens) + 1) for k in (0, 8))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[r.form]
        assert r.output == want
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if r.form == "plain" else (len(p), len(m)))
    assert fim.fill_in_middle(frame.limit(0)).count() == 0
