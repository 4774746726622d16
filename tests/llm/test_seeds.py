import itertools
import math
import random

import pytest

from taxflow.llm import decontaminate


@pytest.mark.parametrize("length", range(1, decontaminate.STRETCH + 1))
def test_masks_cover_all_substitutions(length):
    seeds = [{p + i for i, x in enumerate(m) if x == "1"} for m in decontaminate.masks_of(length) for p in range(length - len(m) + 1)]
    changed = length - math.ceil(decontaminate.SHARE * length)
    assert all(any(not s & set(c) for s in seeds) for c in itertools.combinations(range(length), changed))


def test_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    items = {i: [rnd.choice(vocab) for _ in range(n)] for i, n in enumerate([1, 3, 4, *range(5, 25), 11, 12, 12, 15, 30, 45])}
    docs = []
    for i in list(items) * 8:
        w = list(items[i])
        for j in rnd.sample(range(len(w)), min(len(w), len(w) // 5 + rnd.randint(0, 1))):
            w[j] = "other"
        docs.append([rnd.choice(vocab) for _ in range(rnd.randint(0, 30))] + w + [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))])
    docs.append(["other", *items[[i for i in items if len(items[i]) == 12][0]][1:]])

    def best(doc, item):
        width = min(decontaminate.STRETCH, len(item))
        top = 0
        for shift in range(-len(item) + 1, len(doc)):
            equal = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
            top = max(top, *(sum(equal[a : a + width]) for a in range(len(item) - width + 1)))
        return top, width

    expected = {}
    for d, doc in enumerate(docs):
        for i, item in items.items():
            n, width = best(doc, item)
            if n >= math.ceil(decontaminate.SHARE * width):
                expected[d, i] = n
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contamination(frame, bench).collect()}
    assert len(expected) > 100 and got == expected
