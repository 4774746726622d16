"""Brute-force versions that the operators are held against."""

import re
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_groups(rows, k, threshold):
    threshold = Fraction(threshold)
    sets = {d: shingles(t, k) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                both = len(x & y)
                if both >= threshold * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    up[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def remove_repeats(rows, length, unit):
    """{doc_id: (n, n_removed, n_spans, sha256)}; rows of distinct ids."""
    import hashlib
    from collections import Counter

    seqs = {d: (t or "").encode().split() if unit == "word" else list((t or "").encode()) for d, t in rows}
    count = Counter(tuple(s[i : i + length]) for s in seqs.values() for i in range(len(s) - length + 1))
    out = {}
    for d, s in seqs.items():
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(s, gone) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(s), sum(gone), spans, hashlib.sha256(b" ".join(kept) if unit == "word" else bytes(kept)).hexdigest())
    return out
