"""Near-duplicate vectors by search over a robust-pruned flat graph.

1. Equal vectors become one node with a count.
2. Cells: spherical k-means on a sample (CELL_SAMPLE vectors a cell, by a hash of their bytes) with about CELL_ROWS
   rows to a cell, MAX_CELLS at most. Every node is in its OVERLAP nearest cells. A cell of more than SHARD_ROWS nodes
   is dealt into several shards by hash.
3. Graph: within a shard, each node's CANDIDATES nearest nodes are pruned robustly (a candidate goes if an
   already chosen neighbour is closer to it by the factor ALPHA) to DEGREE neighbours; LONG random neighbours
   and at most DEGREE edges the other way round are added, so that tight groups are reached from outside; a
   node's lists of all its shards are united into one flat graph. Shards end here. A united list keeps the NEAR nearest
   nodes and FAR others, dealt by hash, which lead away from tight groups.
4. Search: neighbouring cells are packed into regions of about REGION_ROWS nodes at home (whose nearest cell is theirs).
   A region holds the part of the united graph that touches its cells, edges between shards included; a table of up to
   REGION_ROWS nodes is one region, so one graph. A node asks every region of its cells: a beam of BEAM starts
   at the region's medoids and walks greedily along the graph, then the search expands along all nodes within the range
   until none is new. A node found counts in its home region alone, so no pair counts twice.
5. Links found are verified in double precision; nothing below the threshold is linked. Only counts and a
   spanning forest of each task's links leave it, so groups of near copies never expand into pairs of rows.
6. Audit: nodes in the order of a hash are compared with all nodes exactly, in blocks: AUDIT_ROWS, and four times as many
   until they have AUDIT_LINKS links or AUDIT_MOST are compared. While fewer than AUDIT_RECALL of their links
   were found, 2-5 run again with twice the overlap; once it covers all cells, every node asks every region.

Null ids, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing
and are kept. Shorter vectors count as padded with zeros. Repeated rows are copies. Labels and other columns are not
read. Ties go to the smaller id. An empty table gives none. A cell of more than REGION_ROWS nodes (near copies by the
thousands) is searched in hashed parts of SHARD_ROWS: its counts need a comparison of each two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import mixed, reachable, stored, table
from fathom.llm.components import components
from fathom.operators.graph import looked_up

THRESHOLD = 0.9
OVERLAP, CELL_ROWS, MAX_CELLS, CELL_SAMPLE = 4, 1000, 16_384, 4
SHARD_ROWS, CANDIDATES, DEGREE, LONG, ALPHA = 4096, 32, 12, 4, 1.2
NEAR, FAR = 24, 8
REGION_ROWS, QUERY_ROWS, MOST_TASKS = 16_384, 8192, 20_000
BEAM, MEDOIDS, QUERY_BLOCK = 32, 16, 256
AUDIT_ROWS, AUDIT_MOST, AUDIT_LINKS, AUDIT_RECALL = 256, 16_384, 100, 0.98


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision; shorter ones padded."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    if len(lengths) and (lengths == width).all():
        out = flat.reshape(-1, width).copy()
    else:
        out = np.zeros((len(lengths), width))
        out[np.arange(width) < lengths[:, None]] = flat
    out /= np.maximum(np.abs(out).max(1, keepdims=True), 5e-324)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    n, out = min(n, len(centres)), []
    for lo in range(0, max(1, len(x)), 1024):
        near = x[lo : lo + 1024] @ centres.T
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def k_means(x: np.ndarray, k: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Spherical k-means centres of unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def pruned_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours of each row among all rows, -1 where there are no more."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int32)
    if k < 1:
        return out  # a row alone
    x = x.astype(np.float32)
    for lo in range(0, n, 512):
        sims = x[lo : lo + 512] @ x.T
        rows = np.arange(len(sims))
        sims[rows, lo + rows] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        far = 1 - np.take_along_axis(sims, near, 1)
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        among = 1 - np.einsum("ikd,ild->ikl", x[near], x[near], optimize=True)
        alive = np.ones(near.shape, bool)
        for slot in range(DEGREE):
            pick = np.argmax(alive, axis=1)
            some = alive[rows, pick]
            out[lo + rows[some], slot] = near[rows[some], pick[some]]
            alive &= ~((ALPHA * among[rows, pick] <= far) & some[:, None])
            alive[rows, pick] = False
            if not alive.any():
                break
    return joined(out, n)


def joined(near: np.ndarray, n: int) -> np.ndarray:
    """The graph with LONG random neighbours a row and DEGREE reversed edges at most."""
    rng = np.random.default_rng(2)
    far = rng.integers(0, n, (n, LONG)).astype(np.int32)
    forward = np.concatenate([near, np.where(far == np.arange(n)[:, None], -1, far)], 1)
    row, to = np.broadcast_to(np.arange(n)[:, None], forward.shape)[forward >= 0], forward[forward >= 0]
    deal = rng.permutation(len(row))
    row, to = row[deal], to[deal]
    order = np.argsort(to, kind="stable")
    count = np.bincount(to, minlength=n)
    rank = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
    back = np.full((n, DEGREE), -1, np.int32)
    kept = order[rank < DEGREE]
    back[to[kept], rank[rank < DEGREE]] = row[kept]
    return np.concatenate([forward, back], 1)


def shortened(near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """The distinct nodes of a united list, cut to the NEAR nearest and FAR of the others in the order of a hash."""
    ids, first = np.unique(near, return_index=True)
    if len(ids) <= NEAR + FAR:
        return ids
    order = np.argsort(-sims[first], kind="stable")
    others = ids[order[NEAR:]]
    return np.concatenate([ids[order[:NEAR]], others[np.argsort(mixed(others.view(np.uint64), 6))[:FAR]]])


def medoids(x: np.ndarray) -> np.ndarray:
    """The row nearest the mean of all, and of each of MEDOIDS - 1 groups."""
    rng = np.random.default_rng(1)
    starts = x[rng.choice(len(x), min(len(x), MEDOIDS - 1), replace=False)]
    group = nearest(x, starts, 1)[:, 0]
    means = [x.mean(0), *(x[group == g].mean(0) for g in np.unique(group))]
    return np.unique([int(np.argmax(x @ m)) for m in means])


def range_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs found with a similarity of at least `least`, in single precision."""
    n, b = len(x), len(queries)
    seen = np.zeros((b, n), bool)
    every = np.arange(b)
    ids = np.tile(entry, (b, 1))
    sims = queries @ x[entry].T
    seen[:, entry] = True
    width = max(BEAM, len(entry))
    if ids.shape[1] < width:
        ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, width - sims.shape[1])), constant_values=-2)
    opened = np.zeros(ids.shape, bool)
    found_q, found_x = [], []

    def note(q: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = s >= least
        found_q.append(q[hit])
        found_x.append(r[hit])
        return q[hit], r[hit]

    note(np.repeat(every, len(entry)), np.tile(entry, b), (queries @ x[entry].T).ravel())
    live = every
    while len(live):
        waiting = np.where(opened[live] | (ids[live] < 0), -3, sims[live])
        best = waiting.argmax(1)
        more = waiting[np.arange(len(live)), best] > -3
        live, best = live[more], best[more]
        if not len(live):
            break
        opened[live, best] = True
        step = graph[ids[live, best]]
        new = (step >= 0) & ~seen[live[:, None], np.maximum(step, 0)]
        q = np.broadcast_to(live[:, None], step.shape)[new]
        r = step[new]
        seen[q, r] = True
        score = np.full(step.shape, -2, np.float32)
        score[new] = np.einsum("ij,ij->i", queries[q], x[r])
        note(q, r, score[new])
        all_ids = np.concatenate([ids[live], np.where(new, step, -1)], 1)
        all_sims = np.concatenate([sims[live], score], 1)
        all_open = np.concatenate([opened[live], np.zeros(step.shape, bool)], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], opened[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_open))
    front = np.concatenate(found_q), np.concatenate(found_x)
    last = np.empty((b, n), np.int32)
    while len(front[0]):  # expand along the range, one column of the lists at a time
        new_q, new_r = [], []
        for k in range(graph.shape[1]):
            q, r = front[0], graph[front[1], k]
            fresh = np.flatnonzero((r >= 0) & ~seen[q, np.maximum(r, 0)])
            q, r = q[fresh], r[fresh]
            last[q, r] = np.arange(len(q))
            once = last[q, r] == np.arange(len(q))
            q, r = q[once], r[once]
            seen[q, r] = True
            new_q.append(q)
            new_r.append(r)
        q, r = np.concatenate(new_q), np.concatenate(new_r)
        score = np.concatenate([np.einsum("ij,ij->i", queries[q[lo : lo + 100_000]], x[r[lo : lo + 100_000]]) for lo in range(0, len(q), 100_000)] or [np.zeros(0, np.float32)])
        front = note(q, r, score)
    return np.concatenate(found_q), np.concatenate(found_x)


def regions_of(centres: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first region, number of regions) of each cell, by the cells' nodes at home; neighbouring cells share a region while they fit.

    A cell of more than REGION_ROWS has regions of its own, SHARD_ROWS each.
    """
    coarse = k_means(centres, max(1, min(len(centres), int(home.sum() // REGION_ROWS))))
    order = np.lexsort((np.arange(len(centres)), nearest(centres, coarse, 1)[:, 0]))
    first, count, at, held = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), 0, 0
    for cell in order.tolist():
        n = int(home[cell])
        if n > REGION_ROWS:
            at += held > 0
            first[cell], count[cell], held = at, -(-n // SHARD_ROWS), 0
            at += int(count[cell])
            continue
        if held and held + n > REGION_ROWS:
            at, held = at + 1, 0
        first[cell], held = at, held + max(1, n)
    return first, count


def spanning(a: np.ndarray, b: np.ndarray, head: np.ndarray) -> np.ndarray:
    """`head`, whose entries point at the smallest row joined so far, after the pairs (a, b) have joined theirs."""
    while True:
        low = np.minimum(head[a], head[b])
        before = head.copy()
        np.minimum.at(head, a, low)
        np.minimum.at(head, b, low)
        np.minimum.at(head, before[a], low)
        np.minimum.at(head, before[b], low)
        while (head[head] != head).any():
            head = head[head]
        if (head == before).all():
            return head


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Slices whose first two columns are equal, which lie together; a group may come in several slices."""
    for b in batches:
        if not b.num_rows:
            continue
        cell, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]) | (shard[1:] != shard[:-1])) + 1, [b.num_rows]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield (int(cell[lo]), int(shard[lo])), b.slice(lo, hi - lo)


def cells_of(nodes: DataFrame, width: int, n_nodes: int, overlap: int) -> np.ndarray:
    """Centres of cells with about CELL_ROWS of the nodes each, overlap included."""
    cells = int(min(MAX_CELLS, n_nodes, max(1, n_nodes * overlap // CELL_ROWS)))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(max(4096, CELL_SAMPLE * cells)).select("vec")
    x = np.concatenate([matrix(b.column(0), width) for b in sample.toArrow().to_batches()])  # CELL_SAMPLE * MAX_CELLS rows at most
    return k_means(x, min(cells, len(x)))


def flat_graph(members: DataFrame, width: int) -> DataFrame:
    """(node, near, sims): every node's lists of all its shards, one after the other. members: (cell, node, vec)."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    dealt = members.join(F.broadcast(sizes), "cell").withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))  # MAX_CELLS rows at most

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def graph_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = np.concatenate([p.column(2).to_numpy() for p in parts])
            x = np.concatenate([matrix(p.column(3), width) for p in parts])
            near = pruned_graph(x)
            good, x = near >= 0, x.astype(np.float32)
            sims = np.concatenate([np.einsum("ikd,id->ik", x[near[lo : lo + 512]], x[lo : lo + 512]) for lo in range(0, len(x), 512)])
            ends = pa.array(np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (ids[near[good]], sims[good]))], names=["node", "near", "sims"])

        at, parts = None, []
        for key, part in _streamed(batches):
            if key != at and parts:
                yield graph_of(parts)
                parts = []
            at = key
            parts.append(part)
        if parts:
            yield graph_of(parts)

    tasks = min(MOST_TASKS, 2 * members.agg(F.countDistinct("cell")).first()[0])
    lists = dealt.select("cell", "shard", "node", "vec").repartition(tasks, "cell", "shard").sortWithinPartitions("cell", "shard").mapInArrow(build, "node long, near array<long>, sims array<float>")
    both = lists.groupBy("node").agg(F.collect_list(F.struct("near", "sims")).alias("all"))  # overlap lists of at most 2 * DEGREE + LONG
    return both.select("node", F.flatten("all.near").alias("near"), F.flatten("all.sims").alias("sims"))


def found_links(nodes: DataFrame, width: int, n_nodes: int, overlap: int, threshold: float) -> tuple[DataFrame, bool]:
    """(a, b, n) and whether all was compared: rows with b null say that node a has n rows linked, the others are links that span all found.

    nodes: (node, copies, vec).
    """
    spark = nodes.sparkSession
    centres = cells_of(nodes, width, n_nodes, overlap)
    shared = spark.sparkContext.broadcast(centres)  # MAX_CELLS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = nearest(matrix(b.column(2), width), shared.value, overlap).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["node", "copies", "vec", "cells"])

    placed = stored(nodes.select("node", "copies", "vec").mapInArrow(assign, "node long, copies long, vec array<double>, cells array<int>"))
    at_home = np.zeros(len(centres), np.int64)
    for r in placed.groupBy(F.col("cells")[0].alias("cell")).count().collect():  # MAX_CELLS rows at most
        at_home[r["cell"]] = r["count"]
    first, count = regions_of(centres, at_home)
    plan = spark.sparkContext.broadcast((first, count))  # MAX_CELLS rows at most
    lists = flat_graph(placed.select(F.explode("cells").alias("cell"), "node", "vec"), width)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = plan.value
        for b in batches:
            if b.num_rows:
                own = mixed(b.column(0).to_numpy().view(np.uint64), 5)
                cells = b.column(5).flatten().to_numpy().reshape(b.num_rows, -1)
                near = [shortened(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(b.column(3), b.column(4), strict=True)]
                inside = first[cells] + (own[:, None] % count[cells].astype(np.uint64)).astype(np.int64)
                asks = [np.unique(np.concatenate([np.arange(f, f + c) for f, c in zip(first[row], count[row], strict=True)])) for row in cells]
                columns = [inside[:, 0], [np.unique(r) for r in inside], asks]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near, pa.list_(pa.int64())), pa.array(columns[0]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[1:])], names=["node", "copies", "vec", "near", "home", "inside", "asks"])

    routed = stored(placed.join(lists, "node").select("node", "copies", "vec", "near", "sims", "cells").mapInArrow(route, "node long, copies long, vec array<double>, near array<long>, home long, inside array<long>, asks array<long>"))
    asked = routed.select(F.explode("asks").alias("region"), "node", "vec")
    parts = stored(asked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts")))
    tasks = min(MOST_TASKS, 2 * parts.agg(F.sum("parts")).first()[0])
    nothing = F.array().cast("array<long>")
    base = routed.select(F.explode("inside").alias("region"), "node", "vec", "near", (F.col("home") == F.col("region")).alias("own"), "copies").withColumn("copies", F.when(F.col("own"), F.col("copies")).otherwise(0)).join(F.broadcast(parts), "region")
    base = base.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "node", "vec", "near", "copies")
    queries = asked.join(F.broadcast(parts), "region").select("region", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "node", "vec", nothing.alias("near"), F.lit(0).cast("long").alias("copies"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prepared(held: list[pa.RecordBatch]) -> tuple:
            ids = np.concatenate([p.column(3).to_numpy() for p in held])
            x = np.concatenate([matrix(p.column(4), width) for p in held])
            n = np.concatenate([p.column(5).value_lengths().to_numpy() for p in held])
            flat = np.concatenate([p.column(5).flatten().to_numpy() for p in held]) if n.sum() else np.zeros(0, np.int64)
            order = np.argsort(ids)
            where = np.minimum(np.searchsorted(ids[order], flat), len(ids) - 1)
            inside = ids[order][where] == flat
            row, to = np.repeat(np.arange(len(ids)), n)[inside], order[where][inside]
            n = np.bincount(row, minlength=len(ids))
            graph = np.full((len(ids), max(1, int(n.max()))), -1, np.int32)
            graph[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = to
            return ids, x, x.astype(np.float32), graph, medoids(x), np.concatenate([p.column(6).to_numpy() for p in held])

        def forest(ids: np.ndarray, asked: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            names = np.unique(np.concatenate([ids, *asked]))
            head = np.arange(len(names))
            for a, b in pairs:
                head = spanning(np.searchsorted(names, a), np.searchsorted(names, b), head)
            some = np.flatnonzero(head != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[head[some]]), pa.nulls(len(some), pa.int64())], names=["a", "b", "n"])

        at, held, ready, asked, pairs = None, [], None, [], []
        for key, part in _streamed(batches):
            if key != at:
                if ready:
                    yield forest(ready[0], asked, pairs)
                at, held, ready, asked, pairs = key, [], None, [], []
            split = int((part.column(2).to_numpy() == 0).sum())
            if split:
                held.append(part.slice(0, split))
            part = part.slice(split)
            if not part.num_rows or not held:
                continue
            ready = ready or prepared(held)
            ids, x, single, graph, entry, copies = ready
            for lo in range(0, part.num_rows, QUERY_BLOCK):
                block = part.slice(lo, QUERY_BLOCK)
                mine, vec = block.column(3).to_numpy(), matrix(block.column(4), width)
                q, r = range_search(single, graph, entry, vec.astype(np.float32), np.float32(threshold - 1e-5))
                good = np.concatenate([np.einsum("ij,ij->i", vec[q[k : k + 100_000]], x[r[k : k + 100_000]]) for k in range(0, len(q), 100_000)] or [np.zeros(0)]) >= threshold
                good &= mine[q] != ids[r]
                q, r = q[good], r[good]
                linked = np.bincount(q, copies[r], len(mine)).astype(np.int64)
                some = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(mine[some]), pa.nulls(len(some), pa.int64()), pa.array(linked[some])], names=["a", "b", "n"])
                a, b = mine[q], ids[r]
                if len(a):  # a forest of the block's links stands for them
                    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
                    head = spanning(index[: len(a)], index[len(a) :], np.arange(len(names)))
                    some = np.flatnonzero(head != np.arange(len(names)))
                    asked.append(mine)
                    pairs.append((names[some], names[head[some]]))
        if ready:
            yield forest(ready[0], asked, pairs)

    rows = base.union(queries).repartition(tasks, "region", "part").sortWithinPartitions("region", "part", "role")
    return stored(rows.mapInArrow(search, "a long, b long, n long")), overlap >= len(centres)


def audited(nodes: DataFrame, counted: DataFrame, width: int, threshold: float) -> tuple[int, int]:
    """(links found, links there are) of the nodes audited, all compared with all nodes exactly. counted: (node, n)."""
    spark, rows = nodes.sparkSession, AUDIT_ROWS
    while True:
        sample = nodes.orderBy(F.xxhash64("node", F.lit(9)), "node").limit(rows).select("node", "vec").toArrow().to_batches()  # AUDIT_MOST rows at most
        ids = np.concatenate([b.column(0).to_numpy() for b in sample])
        shared = spark.sparkContext.broadcast((ids, np.concatenate([matrix(b.column(1), width) for b in sample])))  # AUDIT_MOST rows at most

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, x = shared.value  # noqa: B023
            total = np.zeros(len(own), np.int64)
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    near = x @ matrix(part.column(1), width).T >= threshold
                    near &= own[:, None] != part.column(0).to_numpy()
                    total += near @ part.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(own[total > 0]), pa.array(total[total > 0])], names=["node", "true"])

        true = nodes.select("node", "vec", "copies").mapInArrow(exact, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
        got = true.join(counted, "node", "left").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), "true")).alias("hit"), F.sum("true").alias("n")).first()
        if (got["n"] or 0) >= AUDIT_LINKS or len(ids) < rows or rows >= AUDIT_MOST:
            return got["hit"] or 0, got["n"] or 0
        rows *= 4


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    report receives what the audit measured: found and true links of its nodes (none true: recall is unknown), overlap.
    """
    reachable(vectors.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    good = usable(vec) & F.col("vec_id").isNotNull()
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, vec).alias("vec"))
    rows = stored(cast.withColumns({"node": F.xxhash64("vec"), "check": F.xxhash64(F.lit(1), "vec"), "good": F.col("vec").isNotNull()}))
    nodes = stored(rows.where("good").groupBy("node", "check").agg(F.min("vec_id").alias("label"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not size["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    overlap, whole = OVERLAP, False
    while True:
        links, whole = found_links(nodes, size["width"], size["n"], overlap, threshold)
        counted = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        hit, true = audited(nodes, counted, size["width"], threshold)
        if hit >= AUDIT_RECALL * true or whole:
            break
        overlap *= 2
    if report is not None:
        report.update(found=hit, true=true, overlap=overlap)
    ends = components(links.where("b IS NOT NULL").select("a", "b"))
    labelled = stored(nodes.select("node", "label", "copies").join(ends, "node", "left").select("node", "label", "copies", F.coalesce("comp", "node").alias("comp")))
    smallest = stored(labelled.groupBy(F.col("comp").alias("node")).agg(F.min("label").alias("to"), F.count(F.lit(1)).alias("count")))
    placed = looked_up(labelled, "comp", "node", smallest, size["n"], "component", smallest).join(counted, "node", "left")
    of_node = placed.select("node", F.struct("component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")).alias("to"))
    slim = rows.select("vec_id", "good", F.when(F.col("good"), F.col("node")).otherwise(F.xxhash64("vec_id")).alias("node"), F.xxhash64("vec_id").alias("deal"))
    out = looked_up(slim, "node", "deal", stored(of_node), rows.count(), "found")
    component = F.when(F.col("good"), F.col("found.component")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("good"), F.col("found.n_links")).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP5_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS n FROM embeddings),
 g AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
   AND list_sum(list_transform(list_zip(a.x, b.x), lambda y: y[1] * y[2])) / (a.n * b.n) >= 0.9::DOUBLE),
 r(node, other) AS (SELECT a, b FROM g UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM g WHERE g.a = v.vec_id) AS n_links, least(v.vec_id, coalesce(m.low, v.vec_id)) AS component_id, v.vec_id <= coalesce(m.low, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT node, min(other) AS low FROM r GROUP BY 1) m ON m.node = v.vec_id
"""
