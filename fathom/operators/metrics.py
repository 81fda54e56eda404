"""Retrieval metrics from ranked lists (query_id, item_id, rank) and relevant pairs (query_id, item_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int, depth: int | None = None) -> DataFrame:
    """precision, recall, mrr, ndcg and hit of every query; 0 where nothing is relevant. mrr looks `depth` deep (max(k, 5))."""
    depth = depth or max(k, 5)
    sizes = relevant.groupBy("query_id").agg(F.countDistinct("item_id").alias("n_rel"))
    hits = ranked.where(F.col("rank") <= depth).join(relevant.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi")
    in_k = F.col("rank") <= k
    found = hits.groupBy("query_id").agg(F.sum(in_k.cast("int")).alias("n"), F.min("rank").alias("first"), F.sum(F.when(in_k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    q = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["n_rel", "n"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_rel"), F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.col("n_rel") > 0
    return q.select(
        "query_id",
        (F.col("n") / k).alias("precision"),
        F.when(some, F.col("n") / F.col("n_rel")).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(some, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
        (F.col("n") > 0).cast("double").alias("hit"),
    )


METRICS = ("precision", "recall", "mrr", "ndcg", "hit")


def means(rows: DataFrame, *groups: str) -> DataFrame:
    """The metrics' means over queries, by group."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def keyword_hits(ranked: DataFrame, texts: DataFrame, queries: DataFrame, k: int, across: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(query_id, hit): whether the keyword occurs in one of the first k texts, or (across) in their concatenation."""
    fold = (lambda c: c) if case_sensitive else F.lower
    top = ranked.where(F.col("rank") <= k).join(texts, "item_id").join(queries.select("query_id", "keyword"), "query_id")
    if across:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ")
        found = top.groupBy("query_id", "keyword").agg(F.contains(fold(joined), fold(F.col("keyword"))).alias("hit"))
    else:
        found = top.groupBy("query_id").agg(F.bool_or(F.contains(fold(F.col("text")), fold(F.col("keyword")))).alias("hit"))
    return queries.select("query_id").join(found.select("query_id", "hit"), "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))
