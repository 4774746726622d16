"""The five stages in a row on the smallest tables, each against plain Python or SQL on what its predecessor kept."""

import math
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from taxflow.llm import decontaminate, kneser_ney, line_dedup, mixing
from taxflow.llm.scratch import Scratch
from tests.llm import brute
from tests.llm.test_classifiers import kneser_ney_by_hand
from tests.llm.test_edges import CLASH

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quantile(values, q):
    """The least value that a share ``q`` of all doesn't exceed."""
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def kept_by_classifier(rows, labels):
    trusted = {d for d, quality, toxic in labels if quality == 1 and not toxic}
    held = {d for d in trusted if zlib.crc32(str(d).encode()) % kneser_ney.HELD_OUT == 0}
    n, p = kneser_ney.ORDER, kneser_ney_by_hand([r["text"] or "" for r in rows if r["doc_id"] in trusted - held], kneser_ney.ORDER)
    known, figures = {}, {}
    for r in rows:
        t = "\n" * (n - 1) + " ".join((r["text"] or "").split())
        grams = [t[i : i + n] for i in range(len(t) - n + 1)]
        losses = [known.setdefault(g, -math.log(p(g))) for g in grams]
        s = kneser_ney.STRETCH
        worst = max((sum(losses[i : i + s]) / s for i in range(len(losses) - s + 1)), default=None)
        figures[r["doc_id"]] = (sum(losses) / len(losses) if losses else None, len(losses), worst, r["lang"])
    mine = {d: f for d, f in figures.items() if d in held and f[0] is not None}
    size = Counter(f[3] for f in mine.values())
    of = lambda value, q, lang: quantile([value(f) for f in mine.values() if (lang is None or f[3] == lang) and value(f) is not None], q)
    lang_of = lambda lang: lang if size[lang] >= kneser_ney.MIN_HELD_OUT else None
    usual = {lang: of(lambda f: f[0], 0.5, lang_of(lang)) for lang in {f[3] for f in figures.values()}}
    tempered = lambda f: (f[0] * f[1] + usual[f[3]] * kneser_ney.PRIOR_CHARS) / (f[1] + kneser_ney.PRIOR_CHARS)
    out = set()
    for d, f in figures.items():
        lang = lang_of(f[3])
        good = f[0] is None or tempered(f) <= of(tempered, kneser_ney.QUANTILE, lang) * (1 + 1e-5)
        if good and (f[2] is None or f[2] <= of(lambda x: x[2], kneser_ney.QUANTILE, lang) * (1 + 1e-5)):
            out.add(d)
    return out


def contaminated(rows, items):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c for c in (t or "").lower() if c.isalpha() or c.isnumeric() or c in " \t\n\x0b\x0c\r"))
    asked = [w for w in map(words, items) if w]
    out = set()
    for r in rows:
        doc, at = words(r["text"]), {}
        for i, w in enumerate(doc):
            at.setdefault(w, []).append(i)
        for item in asked:
            width = min(decontaminate.STRETCH, len(item))
            hits = Counter()
            for i, w in enumerate(item):
                for j in at.get(w, ()):
                    hits[j - i] += 1
            for shift in [s for s, n in hits.items() if n >= decontaminate.SHARE * width]:
                equal = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
                if max(sum(equal[a : a + width]) for a in range(len(item) - width + 1)) >= decontaminate.SHARE * width:
                    out.add(r["doc_id"])
    return out


def by_sql(rows, sql):
    con = duckdb.connect()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    con.register("documents", pa.table({c: pa.array([r[c] for r in rows], k) for c, k in zip(COLUMNS, kinds)}))
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def test_all_stages_in_a_row(spark):
    scratch = Scratch(spark, "pipeline-test")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(7) for c in CLASH if c != "copy_no"})  # which the last stage adds
    rows = [r.asDict() for r in docs.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    key = lambda r: tuple(r[c] for c in COLUMNS)

    def run(i, docs):
        out = scratch.write(corpus_pipeline.STAGES[i][1](spark, docs, SF), f"stage-{i}")
        assert out.columns[: len(docs.columns)] == docs.columns
        got = [r.asDict() for r in out.collect()]
        assert all(r[c] == 7 for r in got for c in CLASH if c not in ("copy_no", "n_lines", "n_removed"))  # the operators say that they replace these
        return out, got

    docs, got = run(0, docs)
    good = kept_by_classifier(rows, labels)
    assert 0 < len(good) < len(rows) and sorted(map(key, got)) == sorted(key(r) for r in rows if r["doc_id"] in good)

    rows = got
    docs, got = run(1, docs)
    want = {}
    for r in by_sql(rows, line_dedup.ORACLE_SQL):
        if not (r["n_removed"] and not r["text"].strip()):
            want[r["doc_id"]] = (r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"]) if r["n_removed"] else r["n_chars"])
    assert sorted(map(key, got)) == sorted(want.values()) and any(r["text"] not in {x["text"] for x in rows} for r in got)

    rows = got
    docs, got = run(2, docs)
    groups = brute.jaccard_groups([(r["doc_id"], r["text"]) for r in rows], 5, "0.8")
    assert sorted(map(key, got)) == sorted(key(r) for r in rows if groups[r["doc_id"]][1] == r["doc_id"]) and len(got) < len(rows)

    rows = got
    docs, got = run(3, docs)
    bad = contaminated(rows, items)
    assert bad and sorted(map(key, got)) == sorted(key(r) for r in rows if r["doc_id"] not in bad)

    rows = got
    docs, got = run(4, docs)
    assert sorted((*key(r), r["copy_no"]) for r in got) == sorted((*key(r), r["copy_no"]) for r in by_sql(rows, mixing.ORACLE_SQL))
