import pytest
from pyspark.sql import functions as F

from taxflow.llm import decontaminate, line_dedup, mixing, quality_rules
from taxflow.llm import queries as Q
from tests.llm import brute
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    assert differences(spark, SF, name, Q.queries()[name], Q.oracle_sql()[name]) == ""


DOCS = "doc_id long, text string, source string, key_ int"


def test_edges(spark):
    rows = [(1, None, None, 1), (2, "", "a", 2), (3, "a\nb\nc\nd", "a", 3), (4, "x\n\na\nb\nc", None, 4), (3, "a\nb\nc\nd", "a", 5), (None, "b\nc\nd", "b", 6)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.key_: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got[1] == (None, 0, 0) and got[2] == ("", 1, 0) and got[3] == got[5] == ("a\nb\nc\nd", 4, 0)
    assert got[4] == ("x\n", 5, 3) and got[6] == ("", 3, 3)
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[1].n_words == 0 and rules[1].base_failed and not rules[1].kept
    for op in (line_dedup.line_dedup, quality_rules.quality_rules, mixing.mix_sources):
        assert op(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, weights={"a": 1.0}, size=300).where("source = 'a'").count() > 200


def test_short_runs_of_lines(spark):
    long, two = " ".join(f"w{i}" for i in range(60)), "one two\nthree four five"
    rows = [(1, long), (2, f"before\n{long}\nafter"), (3, two), (4, f"x\n\n{two}"), (5, "Yes."), (6, "Yes."), (7, "a\nb"), (8, "a\nb"), (9, "three four five\none two")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {2: "before\nafter", 4: "x\n"}


def test_rules_by_cost(spark):
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id").cast("string")) for i in range(30)]).alias("text"))
    third, sixth = (F.col("text").endswith(x) for x in ("0", "50"))
    rules = [
        quality_rules.Rule("dear", third, F.length("text")), quality_rules.Rule("cheap", third), quality_rules.Rule("inside", sixth), quality_rules.Rule("other", F.col("text").endswith("1")), quality_rules.Rule("never", F.length("text") < 0),
    ]
    for n, rows in ((1, 2000), (7, 2000), (7, 300)):
        found = quality_rules.order_rules(docs.repartition(n), rules, rows)
        # what "inside" rejects has gone by its turn, as has what the dear one would reject
        assert [r.name for r, _, _ in found][:2] in (["cheap", "other"], ["other", "cheap"]) and [r.name for r, _, _ in found][2:] == ["dear", "inside", "never"]
        assert [x > 0 for _, _, x in found] == [True, True, False, False, False] and max(c for _, c, _ in found) > 100 * min(c for _, c, _ in found) * 0.5
    got = quality_rules.quality_rules(docs.limit(200), rules)
    assert {(r.kept, r.rejected_by) for r in got.collect()} == {(False, "cheap"), (False, "other"), (True, None)}


def test_mix_rates(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("source"))
    got = dict(mixing.mix_sources(docs, weights={"small": 3, "big": 1}, size=4000).groupBy("source").count().collect())
    assert abs(got["small"] - 3000) < 300 and abs(got["big"] - 1000) < 150


def test_decontamination(spark):
    item = "the quick brown fox jumps over a lazy dog while nine bright birds sing above old stones near water every morning"
    w = item.split()
    changed = list(w)
    changed[4] = changed[13] = "other"
    rows = [(1, "before it " + item.upper() + "! after"), (2, " ".join(changed)), (3, " ".join(w[:9])), (4, None), (5, ""), (6, "hello big World, again"), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "Hello, big world")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == [(0, 7), (1, 7), (2, 7), (6, 9)]
    assert decontaminate.contamination(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0
    assert decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).count() == 0


def test_decontamination_finds_whole_items(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    texts = [(r.doc_id, " ".join(brute.words(r.text))) for r in docs.collect()]
    exact = {(d, b.item_id) for b in bench.collect() for d, t in texts if " ".join(brute.words(b.text)) in t}
    assert exact and exact <= found


def test_decontamination_of_large_benchmarks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert small and sorted(map(tuple, decontaminate.contamination(docs, bench).collect())) == small
