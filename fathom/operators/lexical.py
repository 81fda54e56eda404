"""BM25 over token tables, or inside the items' rows for the best items alone."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokens
from fathom.sources.index_store import scope, stored

K1, B, EPSILON = 1.5, 0.75, 0.25


def _split(items: DataFrame, ids: list[str]) -> DataFrame:
    """The ids with the item's tokens (t) and their number (dl)."""
    return items.select(*ids, tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))


def _counts(split: DataFrame, by: list[str]) -> DataFrame:
    """(by, token, df, total): each token's items; the null token has the number of items and their length."""
    marked = split.select(*by, "dl", F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("token"))
    return marked.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def _terms(counted: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """(by, query_id, token, qtf, avgdl, idf) of the queries' tokens that items have."""
    size = counted.where("token IS NULL").select(*by, F.col("df").alias("n_items"), (F.col("total") / F.col("df")).alias("avgdl"))
    raw = F.log(F.col("n_items") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    words = counted.where("token IS NOT NULL").drop("total")
    weights = (words.join(F.broadcast(size), by) if by else words.crossJoin(F.broadcast(size))).withColumn("raw", raw)  # a row for each value of `by`
    mean = weights.groupBy(*by).agg(F.avg("raw").alias("mean"))
    wanted = weights.join(asked.select("token").distinct(), "token", "left_semi")
    wanted = wanted.join(F.broadcast(mean), by) if by else wanted.crossJoin(F.broadcast(mean))  # a row for each value of `by`
    wanted = wanted.select(*by, "token", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return asked.join(wanted, "token")


def bm25(items: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query_id, item_id, score) of the pairs that share a token; items are ranked within each value of the columns `by`.

    Repeated query tokens count repeatedly. A token in more than half of the items has a negative weight, which becomes
    EPSILON times the mean weight. Item ids are unique within `by`. One pass counts each token's items, its partial sums made
    before the shuffle; the number of items and their length ride along as the null token. A second pass keeps only
    the queries' tokens of each item, counts them, and is shuffled by token only if the queries' table is too large to broadcast.
    """
    by = list(by)
    split, asked = _split(items, [*by, "item_id"]), _asked(queries)
    terms = _terms(_counts(split, by), asked, by)
    posted = split.select(*by, "item_id", "dl", F.explode("t").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    posted = posted.groupBy(*by, "item_id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    pairs = posted.join(terms, [*by, "token"])
    return pairs.groupBy(*by, "query_id", "item_id").agg(F.round(F.sum(part), 6).alias("score"))


#: Query terms that bm25_top() gives to every task; with more of them it ranks bm25()'s pairs.
MOST_TERMS = 1_000_000
#: Tokens and queries that are scored at a time.
TOKEN_BLOCK, QUERY_BLOCK = 50_000, 64
#: Tokens whose counts a task holds between batches.
TOKENS_HELD = 200_000
#: Digits of a score, and what stands for a null id, which ranks last.
DIGITS, NULL_ID = 6, np.iinfo(np.int64).max


def bm25_top(items: DataFrame, queries: DataFrame, k: int, ids: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """(query_id, ids, score, rank) of each query's k best items by bm25(): score falling, then the ids rising.

    items (ids, text); the ids are whole numbers and unique together. Every item is scored, in Arrow batches against the
    queries' weighted terms, which the driver gathers (MOST_TERMS at most). A task keeps k items a query, so that
    the shuffle carries those, not the pairs that share a token. One pass counts tokens, a second one scores.
    """
    spark, ids = items.sparkSession, list(ids)
    low = items.select(*[F.col(c).cast("long") for c in ids], F.lower("text").cast("binary").alias("low")).where("low IS NOT NULL")
    with scope(spark):
        partial = low.select("low").mapInArrow(_counter, "token string, df long, total long")
        counted = stored(partial.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))
        found = _terms(counted, _asked(queries), []).select(F.col("query_id").cast("long"), "token", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl").limit(MOST_TERMS + 1).toArrow().combine_chunks()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.asc_nulls_last(c) for c in ids])
    if found.num_rows > MOST_TERMS:
        pairs = bm25(items.select(F.struct(*ids).alias("item_id"), "text"), queries)
        scored = pairs.select("query_id", *[F.col("item_id")[c].alias(c) for c in ids], "score")
    else:
        kinds = ", ".join(f"{c} long" for c in ids)
        scored = low.mapInArrow(_scorer(found, k, ids), f"query_id long, {kinds}, score double")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (low) to parts of _counts(). bytes.split() parts at the white space that tokens() parts at."""
    names, n, length, df = ["token", "df", "total"], 0, 0, Counter()

    def counts() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.binary()).cast(pa.string()), pa.array(df.values(), pa.int64()), pa.nulls(len(df), pa.int64())], names=names)

    for b in batches:
        for text in b.column(0).to_pylist():
            words = text.split()
            n, length = n + 1, length + len(words)
            df.update(set(words))
        if len(df) > TOKENS_HELD:
            yield counts()
            df.clear()
    yield counts()
    if n:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n]), pa.array([length])], names=names)


def _scorer(terms: pa.Table, k: int, ids: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (ids, low) to the k best of a task: (query_id, ids, score)."""
    one = lambda name: pa.array(terms[name].to_pylist(), terms[name].type)
    query, token = one("query_id"), one("token")
    asked, words = query.unique(), token.unique()
    q, t = (pc.index_in(x, value_set=u).to_numpy(zero_copy_only=False).astype(np.int64) for x, u in ((query, asked), (token, words)))
    w, positive = one("w").to_numpy(zero_copy_only=False), bool(pc.all(pc.greater(one("w"), 0), min_count=0).as_py())
    mean_length = terms["avgdl"][0].as_py() if terms.num_rows else 1.0
    number = {x.encode(): i for i, x in enumerate(words.to_pylist())}
    blocks = []
    for lo in range(0, len(asked), QUERY_BLOCK):
        mine = np.flatnonzero((q >= lo) & (q < lo + QUERY_BLOCK))
        mine = mine[np.argsort(t[mine], kind="stable")]
        n = np.bincount(t[mine], minlength=len(words))
        blocks.append((lo, min(QUERY_BLOCK, len(asked) - lo), n, np.cumsum(n) - n, q[mine] - lo, w[mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.full(size, -np.inf), [np.empty(0, np.int64), np.empty(0), *[np.empty(0, np.int64)] * len(ids)]) for _, size, *_ in blocks]
        for b in batches:
            lo, held, words = 0, [], 0
            for i, text in enumerate(b.column(len(ids)).to_pylist()):
                held.append(text.split())
                words += len(held[-1])
                if words > TOKEN_BLOCK or i == b.num_rows - 1:
                    score(b.slice(lo, len(held)), held, words, best)
                    lo, held, words = i + 1, [], 0
        for (start, *_), (_, (at, value, *keys)) in zip(blocks, best, strict=True):
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(at + start)), *[pa.array(x, mask=x == NULL_ID) for x in keys], pa.array(value)], names=["query_id", *ids, "score"])

    def score(part: pa.RecordBatch, texts: list[list[bytes]], many: int, best: list) -> None:
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        word = np.fromiter(map(number.get, chain.from_iterable(texts), repeat(-1)), np.int64, many)
        known = word >= 0
        cells, tf = np.unique(np.repeat(np.arange(len(length)), length)[known] * len(number) + word[known], return_counts=True)
        row, word = cells // max(1, len(number)), cells % max(1, len(number))
        below = tf + K1 * (1 - B + B * length[row] / mean_length)
        keys = [pc.fill_null(part.column(i), NULL_ID).to_numpy(zero_copy_only=False) for i in range(len(ids))]
        for i, (_, size, n, first, column, weight) in enumerate(blocks):
            each = n[word]
            pair = np.repeat(np.arange(len(word)), each)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each) + first[word[pair]]
            cell = row[pair] * size + column[at]
            sums = np.bincount(cell, weight[at] * tf[pair] * (K1 + 1) / below[pair], len(length) * size)
            least, held = best[i]
            near = sums >= np.tile(least - 10.0**-DIGITS, len(length))
            near &= sums > 0 if positive else np.bincount(cell, minlength=len(sums)) > 0
            if len(new := np.flatnonzero(near)):
                value = np.floor(np.abs(sums[new]) * 10**DIGITS + 0.5) / 10**DIGITS * np.sign(sums[new])
                held = [np.concatenate(x) for x in zip(held, [new % size, value, *[x[new // size] for x in keys]], strict=True)]
                held = [x[np.lexsort((*held[:1:-1], -held[1], held[0]))] for x in held]
                start = np.searchsorted(held[0], np.arange(size))
                held = [x[np.arange(len(held[0])) - start[held[0]] < k] for x in held]
                start, many = np.searchsorted(held[0], np.arange(size)), np.bincount(held[0], minlength=size)
                least = np.full(size, -np.inf)
                least[many >= k] = held[1][start[many >= k] + k - 1]
                best[i] = least, held

    return run


def full_ranks(scored: DataFrame, items: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """The first `depth` of every item's rank per query, items without a common token scoring 0.

    Only the `depth` smallest ids can fill up from the zero scores, so the rest of the corpus is not paired with queries.
    """
    from fathom.operators.vector import ranked

    fill = items.select("item_id").orderBy("item_id").limit(depth)
    zero = queries.select("query_id").crossJoin(F.broadcast(fill)).join(scored, ["query_id", "item_id"], "left_anti").withColumn("score", F.lit(0.0))  # depth rows
    return ranked(scored.where("score > 0").union(zero), depth)
