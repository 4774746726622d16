"""Mixing sources to target weights by Poisson replication (operator 5), built-in functions only.

A source with n documents and target share w of a mix of M documents has the
mean repetition rate w * M / n.  Each document draws its number of copies from
the Poisson distribution of that mean, by inverting the distribution function
at a number hashed from the seed and the document, so that a rerun draws the
same.  Copies are exploded and dealt out and ordered by a hash of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxflow.llm import text as T
from taxflow.llm.scratch import Scratch, partitions


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) hashed from the seed and the columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distributions(rates: DataFrame, by: str) -> DataFrame:
    """(by, n, rate, tf_cdf__): P(X <= k) of the Poisson distribution for k = 0 .. 40 beyond rate + 12 deviations."""
    top = F.when(F.col("rate") > 0, F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40)).otherwise(0).cast("int")
    rows = rates.withColumn("k", F.explode(F.sequence(F.lit(0), top)))
    w = Window.partitionBy(by).orderBy("k")
    rows = rows.withColumn("log_factorial", F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(w))
    rows = rows.withColumn("p", F.exp(F.coalesce(F.col("k") * F.ln("rate"), F.lit(0.0)) - F.col("rate") - F.col("log_factorial")))
    rows = rows.withColumn("c", F.sum("p").over(w))
    found = rows.groupBy(by, "n", "rate").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("all"))
    return found.select(by, "n", "rate", F.transform("all", lambda x: x["c"]).alias("tf_cdf__"))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, by: str = "source", size: int | None = None, temperature: float = 0.5) -> DataFrame:
    """(by, n, rate, tf_cdf__): the mean repetition rate of each source and its distribution.

    ``weights``: target shares; they are scaled to sum to 1, and a source that
    isn't named gets 0.  None: shares go with the number of documents to the
    power ``temperature``.  ``size``: documents in the mix, as many as now if None.
    """
    counts = docs.groupBy(F.col(by).alias(by)).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col(by) == name, F.lit(float(weight))).otherwise(share)
    counts = counts.withColumn("share", share)
    total = counts.agg(F.sum("share").alias("share"), F.sum("n").alias("n")).first()  # two numbers
    shares, wanted = float(total["share"] or 0.0), float((total["n"] or 0) if size is None else size)
    rates = counts.select(by, "n", (F.col("share") * F.lit(wanted) / (F.lit(shares or 1.0) * F.col("n"))).alias("rate"))
    return distributions(rates, by)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, by: str = "source", size: int | None = None, temperature: float = 0.5, seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated by its draw, in random order; column copy_no (int, from 1) is added.

    The draw depends on doc_id and the seed.  A null source is a source of its
    own.  Null doc_ids draw as one id, and rows that repeat a doc_id draw alike.
    Texts don't matter for the draw, null and empty ones neither; the order is a
    hash of the whole row.  An empty table stays empty.  A column copy_no of the
    input is replaced.  The mix has ``size`` documents in expectation.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "copy_no"]
    u, times, order, source, cdf = T.fresh(docs, "u", "times", "order", "source", "cdf")
    # written and read back: Spark broadcasts it only if the file is small, and else splits skewed partitions of a sort merge join
    rates = repetition_rates(docs, weights, by, size, temperature).select(F.col(by).alias(source), F.col("tf_cdf__").alias(cdf))
    rates = Scratch(spark, "mix-rates").write(rates, "rates")
    drawn = docs.select(*names, uniform(seed, "doc_id").alias(u)).join(rates, F.col(by).eqNullSafe(F.col(source)))
    drawn = drawn.select(*names, F.size(F.filter(cdf, lambda c: c <= F.col(u))).alias(times)).where(F.col(times) > 0)
    copies = drawn.select(*names, F.explode(F.sequence(F.lit(1), F.col(times))).alias("copy_no"))
    dealt = copies.withColumn(order, F.xxhash64(F.lit(seed), *names, "copy_no"))
    return dealt.repartition(partitions(spark), order).sortWithinPartitions(order).drop(order)


ORACLE_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) * (SELECT sum(n) FROM c) / ((SELECT sum(sqrt(n)) FROM c) * n) AS rate FROM c),
k AS (
  SELECT source, i, sum(CASE WHEN i = 0 THEN exp(-rate) ELSE exp(-rate + i * ln(rate) - lgamma(i + 1)) END)
         OVER (PARTITION BY source ORDER BY i) AS cdf
  FROM r, (SELECT unnest(generate_series(0, 120)) AS i)
),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('17|' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
t AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(k.i) AS times FROM u LEFT JOIN k ON u.source IS NOT DISTINCT FROM k.source AND k.cdf <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, times)) AS INTEGER) AS copy_no FROM t WHERE times > 0
"""
