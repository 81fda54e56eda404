"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source with target weight w and n of the N rows has mean repetition rate w * N / n. Each document draws a
uniform number from a hash of the seed and its id, inverts the Poisson distribution of its source's rate
there, and is repeated so often; every copy gets a hash of its own, by which all copies are dealt to
partitions and ordered inside them (a uniform global shuffle without a sampling pass).

Rates come from one count per source. Only the sources named in `weights` join it, so the broadcast has at
most len(weights) rows, whatever the data. Rows of other or null sources have the rate `other`. A null
doc_id draws as the id "null"; repeated rows draw alike; null and empty texts are rows like others; an
empty table gives none. Rates have no upper limit: one beyond PART_RATE is split into equal parts, whose counts
are drawn by numbers of their own and added (a sum of Poisson counts is one). Every column of the rows stays: where one
begins with the added columns' prefix, that gets further underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import table

SEED = 17
#: Rates up to this are drawn at once; exp(-rate) is far from underflow. The SQL twin says the same of them, not of greater ones.
PART_RATE = 128.0
#: Copies that one row lists at a time.
RUN = 4096
#: The query's targets: twenty sources with equal shares.
WEIGHTS = {f"src{i}": 0.05 for i in range(20)}


def poisson_cdf(rate: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... up to where nothing is left in double precision."""
    zero = F.exp(-rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(zero.alias("p"), zero.alias("sum"), F.array(zero).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def parts(rate: Column) -> Column:
    """Into how many equal parts a rate is split."""
    return F.greatest(F.lit(1), F.ceil(rate / PART_RATE)).cast("int")


def rates(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """mix_source, rate, cdf of one part of the rate, of the weighted sources that occur: at most len(weights) rows."""
    share = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    total = docs.agg(F.count(F.lit(1)).alias("n_all"))
    each = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n")).where(F.col("mix_source").isin(list(weights)))
    rate = share[F.col("mix_source")] * F.col("n_all") / F.col("n")
    return each.crossJoin(F.broadcast(total)).select("mix_source", rate.alias("mix_rate")).withColumn("mix_cdf", poisson_cdf(F.col("mix_rate") / parts(F.col("mix_rate"))))  # total is one row


def mixed_sources(docs: DataFrame, weights: dict[str, float], seed: int = SEED, other: float = 1.0) -> DataFrame:
    """`docs` repeated and shuffled, with mix_rate, mix_copy (from 1) and mix_key (the shuffle's order) after their columns."""
    if not weights or min(weights.values()) < 0 or not 0 <= other < float("inf"):
        raise ValueError("weights must be given and none negative")
    p = "mix"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    found = rates(docs, weights).select(*[F.col(f"mix_{c}").alias(f"{p}_{c}") for c in ("source", "rate", "cdf")])
    joined = docs.join(F.broadcast(found), F.col("source") == F.col(f"{p}_source"), "left")  # len(weights) rows at most
    rate = F.coalesce(F.col(f"{p}_rate"), F.lit(float(other)))
    cdf = F.coalesce(F.col(f"{p}_cdf"), poisson_cdf(F.lit(float(other)) / parts(F.lit(float(other)))))
    drawn = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1), parts(rate) - 1), F.lit(0), lambda n, j: n + drawn(uniform(F.lit(seed), F.col("doc_id"), j)))
    copies = drawn(F.col(f"{p}_u")) + F.when(parts(rate) > 1, more).otherwise(0)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(f"{p}_copy").cast("string")).cast("binary"))
    return (
        joined.withColumn(f"{p}_u", uniform(F.lit(seed), F.col("doc_id")))
        .withColumn(f"{p}_n", copies)
        .where(F.col(f"{p}_n") > 0)
        .withColumn(f"{p}_run", F.explode(F.sequence(F.lit(1), F.col(f"{p}_n"), F.lit(RUN))))
        .withColumn(f"{p}_copy", F.explode(F.sequence(F.col(f"{p}_run"), F.least(F.col(f"{p}_n"), F.col(f"{p}_run") + (RUN - 1)))))
        .select(*[F.col(f"`{c}`") for c in docs.columns], rate.alias(f"{p}_rate"), f"{p}_copy", key.alias(f"{p}_key"))
        .repartition(F.col(f"{p}_key"))
        .sortWithinPartitions(f"{p}_key")
    )


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS)
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("long").alias("copy"), F.round("mix_rate", 9).alias("rate"), F.col("mix_key").alias("shuffle_key"), "text")


OP2_SQL = f"""
WITH n AS (SELECT count(*) AS n_all FROM documents),
     s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     r AS (SELECT source, 0.05::DOUBLE * n_all / n AS rate FROM s, n
           WHERE source IN ({", ".join(f"'{x}'" for x in WEIGHTS)})),
     d AS (SELECT d.*, coalesce(r.rate, 1.0::DOUBLE) AS rate,
                  ('0x' || substring(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
           FROM documents d LEFT JOIN r ON d.source = r.source),
     k AS (SELECT unnest(range(0, {int(PART_RATE + 12 * PART_RATE**0.5 + 21)})) AS k),
     p AS (SELECT DISTINCT rate FROM d),
     c AS (SELECT rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY rate ORDER BY k) AS cdf FROM p, k)
SELECT d.doc_id, d.source, (c.k + 1)::BIGINT AS copy, round(d.rate, 9) AS rate,
       md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || (c.k + 1)) AS shuffle_key, d.text
FROM d JOIN c ON d.rate = c.rate AND c.cdf <= d.u AND c.k < d.rate + 12 * sqrt(d.rate) + 20
"""
