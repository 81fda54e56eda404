"""Document trees: an index of titled nodes and level-by-level descent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokens


def page_tree(pages: DataFrame) -> DataFrame:
    """(node_id, parent_id, level, title, text) of HTML pages: a page with its <title>, and below it each of its paragraphs."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    title = plain(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    top = pages.select(F.concat(F.lit("p"), "page_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).cast("long").alias("level"), title.alias("title"), F.lit("").alias("text"))
    parts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))).alias("i", "raw")).withColumn("text", plain(F.col("raw")))
    below = parts.select(F.concat(F.lit("p"), "page_id", F.lit("."), "i").alias("node_id"), F.concat(F.lit("p"), "page_id").alias("parent_id"), F.lit(2).cast("long").alias("level"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"), "text")
    return top.union(below)


def descend(tree: DataFrame, queries: DataFrame, levels: int = 2) -> DataFrame:
    """(query_id, level, node_id): at each level the node, below the one chosen before, that shares most words with the query.

    Nodes and queries meet on shared words, so a level is an equi-join; ties go to the smaller node_id. A query ends where
    no node shares a word.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    at, out = None, None
    for level in range(1, levels + 1):
        nodes = tree.where(F.col("level") == level).select("node_id", "parent_id", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "title", "text")))).alias("w"))
        pairs = nodes.join(asked, "w")
        if at is not None:
            pairs = pairs.join(at.select("query_id", F.col("node_id").alias("parent_id")), ["query_id", "parent_id"])
        shared = pairs.groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("query_id").orderBy(F.desc("n"), "node_id")
        at = shared.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", F.lit(level).cast("long").alias("level"), "node_id")
        out = at if out is None else out.union(at)
    return out
