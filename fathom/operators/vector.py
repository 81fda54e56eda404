"""Vector search: exact top-k in blocks, inverted files, diversity, quantisation, late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import vectors as V

#: Rows of the corpus and queries that one matrix product takes.
BLOCK, QUERY_BLOCK = 2048, 256
#: Scores are compared and reported to so many digits, so that equal vectors tie in any order of summation.
DIGITS = 9


def _packed(rows: DataFrame, key: str, vec: str, size: int, prefix: str) -> DataFrame:
    """Rows packed into blocks: (prefix_ids, prefix_vecs), vectors one after the other."""
    names = [f"{prefix}_ids", f"{prefix}_vecs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                ids, flat = part.column(0), part.column(1).flatten()
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([one(ids), one(flat)], names=names)

    return rows.select(F.col(key).cast("long"), F.col(vec).cast("array<double>")).where(F.col(vec).isNotNull()).mapInArrow(run, f"{names[0]} array<long>, {names[1]} array<double>")


def top_k(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", skip_self: bool = False, width: int = 0) -> DataFrame:
    """(query_id, item_id, score, rank) of each query's k best items: score falling, then id.

    items (item_id, vec), queries (query_id, qvec). metric: cosine, dot, or max_sim, where vectors are sequences of
    parts of `width` numbers and the score sums each query part's largest dot product with an item part. Both sides are packed into blocks; each pair of blocks is one
    matrix product that returns its k best per query, so that the shuffle carries k rows a query and block, and
    no task holds more than two blocks. The pairs of blocks are those of an exhaustive search: for large tables use probe().
    Items and queries must be vectors of one length.
    """
    if metric not in ("cosine", "dot", "max_sim") or (metric == "max_sim" and width < 1):
        raise ValueError(f"unknown metric {metric}, or no width")
    blocks = _packed(items, "item_id", "vec", BLOCK, "i").crossJoin(_packed(queries, "query_id", "qvec", QUERY_BLOCK, "q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, x, qids, q = (b.column(c)[r].values.to_numpy() for c in range(4))
                if len(x) % len(ids) or len(q) % len(qids) or len(x) // len(ids) != len(q) // len(qids):
                    raise ValueError("vectors differ in length")
                x, q = x.reshape(len(ids), -1), q.reshape(len(qids), -1)
                if metric == "max_sim":
                    s = (q.reshape(-1, width) @ x.reshape(-1, width).T).reshape(len(qids), -1, len(ids), x.shape[1] // width).max(3).sum(1)
                else:
                    s = q @ x.T
                if metric == "cosine":
                    s = s / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1)) + V.EPSILON)
                s = np.round(s, DIGITS)
                if skip_self:
                    s[qids[:, None] == ids] = -np.inf
                best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                score = np.take_along_axis(s, best, 1)
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, keep.sum(1))), pa.array(ids[best[keep]]), pa.array(score[keep])], names=["query_id", "item_id", "score"])

    scored = blocks.mapInArrow(run, "query_id long, item_id long, score double")
    return ranked(scored, k)


def similar_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b, of all items (item_id, vec) whose cosine reaches the threshold, by pairs of blocks as in top_k()."""
    blocks = _packed(items, "item_id", "vec", BLOCK, "i").crossJoin(_packed(items, "item_id", "vec", QUERY_BLOCK, "q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, x, qids, q = (b.column(c)[r].values.to_numpy() for c in range(4))
                x, q = x.reshape(len(ids), -1), q.reshape(len(qids), -1)
                s = np.round(q @ x.T / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1)) + V.EPSILON), DIGITS)
                i, j = np.nonzero((s >= threshold) & (qids[:, None] < ids))
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["a", "b", "sim"])

    return blocks.mapInArrow(run, "a long, b long, sim double")


def ranked(scored: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The rows with rank (from 1) by score falling and id rising, the first k of them."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "item_id")))
    return (out.where(F.col("rank") <= k) if k else out).withColumn("rank", F.col("rank").cast("long"))


def matching(items: DataFrame, wanted: dict) -> DataFrame:
    """The items whose columns equal all wanted values; an unknown column matches nothing."""
    for name, value in wanted.items():
        items = items.where(F.col(name) == F.lit(value)) if name in items.columns else items.where(F.lit(False))
    return items


def centroids(items: DataFrame, group: str) -> DataFrame:
    """(group, centroid): the mean vector, not normalised."""
    dims = items.select(group, F.posexplode("vec").alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("centroid"))


#: Cells that an index may have: their centroids go to every task as one row.
MOST_CELLS = 65_536


def with_cells(items: DataFrame, centres: DataFrame, vec: str = "vec", n: int = 1, name: str = "cell") -> DataFrame:
    """Each row with its n nearest cells, nearest first (one row a cell). centres: (cell, centroid), MOST_CELLS at most; more are an error."""
    if centres.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    one = centres.agg(F.collect_list(F.struct("cell", F.col("centroid").alias("c"))).alias("cells__"))  # MOST_CELLS at most, by the check above
    near = F.transform("cells__", lambda m: F.struct((-F.round(V.cosine(F.col(vec), m["c"]), DIGITS)).alias("d"), m["cell"].alias("cell")))
    found = items.crossJoin(F.broadcast(one)).withColumn("near__", F.slice(F.array_sort(near), 1, n))  # one row
    return found.withColumn(name, F.explode(F.transform("near__", lambda x: x["cell"]))).drop("near__", "cells__")


def probe(items: DataFrame, queries: DataFrame, centres: DataFrame, n_probe: int, k: int) -> DataFrame:
    """Inverted-file search: top k among the items of each query's n_probe nearest cells (an equi-join on the cell)."""
    filed = with_cells(items, centres)
    asked = with_cells(queries, centres, "qvec", n_probe)
    scored = filed.join(asked, "cell").select("query_id", "item_id", F.round(V.cosine(F.col("qvec"), F.col("vec")), DIGITS).alias("score"))
    return ranked(scored, k)


def k_means_cells(items: DataFrame, cells: int, seed: int = 0) -> DataFrame:
    """(cell, centroid) from the library's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(items.select(array_to_vector("vec").alias("f")))
    return items.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centroid array<double>")


def list_count(n_rows: int) -> int:
    """Lists of an inverted file: one for each thousand rows."""
    return max(1, n_rows // 1000)


def diverse(candidates: DataFrame, items: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance among candidates (query_id, item_id, score): (query_id, item_id, pick).

    Greedy, one join of the chosen vectors per pick: the first pick is the most relevant, the next maximise
    weight * relevance - (1 - weight) * largest similarity to a pick.
    """
    pool = candidates.select("query_id", "item_id", "score").join(items.select("item_id", "vec"), "item_id").withColumn("near", F.lit(None).cast("double"))
    chosen = None
    for pick in range(1, k + 1):
        gain = F.col("score") if pick == 1 else F.round(weight * F.col("score") - (1 - weight) * F.col("near"), DIGITS)
        best = pool.groupBy("query_id").agg(F.max_by(F.struct("item_id", "vec"), F.struct(gain, -F.col("item_id"))).alias("b")).select("query_id", F.col("b.item_id").alias("picked"), F.col("b.vec").alias("pvec"))
        row = best.select("query_id", F.col("picked").alias("item_id"), F.lit(pick).cast("long").alias("pick"))
        chosen = row if chosen is None else chosen.union(row)
        pool = pool.join(best, "query_id").where("item_id <> picked").withColumn("near", F.greatest(F.col("near"), F.round(V.cosine(F.col("vec"), F.col("pvec")), DIGITS))).drop("picked", "pvec")
    return chosen


def quantised(items: DataFrame) -> DataFrame:
    """(item_id, code): per dimension 256 equal steps between its least and largest value, minus 128."""
    long = items.select("item_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    ends = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / 255
    code = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / step + 0.5)).otherwise(F.lit(0)) - 128
    coded = long.join(F.broadcast(ends), "dim").select("item_id", "dim", code.cast("int").alias("c"))  # a row a dimension
    return coded.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda x: x["c"]).alias("code"))


def signs(items: DataFrame) -> DataFrame:
    """(item_id, code): packed sign bits."""
    return items.select("item_id", V.packed_signs(F.col("vec")).alias("code"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of packed codes (an extension: the plain comparison is cosine over codes)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count((x + 128).bitwiseXOR(y + 128))), F.lit(0), lambda s, v: s + v)


def storage_kb(items: DataFrame, bytes_per_value: float, vec: str = "vec") -> DataFrame:
    return items.agg((F.sum(F.size(vec)) * F.lit(float(bytes_per_value)) / 1024).alias("kb"))


def sparse_dot(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of token weights (item_id, token, w) and (query_id, token, qw)."""
    return items.join(queries, "token").groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
