"""Property multigraphs: nodes (node) and edges (src, dst, relationship, source_chunk)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.sources.index_store import stored
from fathom.sources.tables import reachable


def built(triples: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Edges of triples (s, r, o, source_chunk); names (name, canonical) replace node names. Parallel edges stay."""
    e = triples.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("r").alias("relationship"), "source_chunk")
    if names is None:
        return e
    for end in ("src", "dst"):
        e = e.join(names.select(F.col("name").alias(end), F.col("canonical").alias(f"c_{end}")), end, "left").withColumn(end, F.coalesce(f"c_{end}", end)).drop(f"c_{end}")
    return e.select("src", "dst", "relationship", "source_chunk")


def neighbourhood(edges: DataFrame, seeds: DataFrame, n_hops: int = 1) -> DataFrame:
    """Distinct edges within n_hops of each query's seeds (query_id, node): (query_id, src, dst, relationship, source_chunk)."""
    frontier, found = seeds.select("query_id", "node").distinct(), None
    for hop in range(n_hops):
        out = edges.join(frontier.withColumnRenamed("node", "src"), "src")
        into = edges.join(frontier.withColumnRenamed("node", "dst"), "dst")
        found = out.unionByName(into).select("query_id", "src", "dst", "relationship", "source_chunk").distinct()
        if hop + 1 < n_hops:
            frontier = frontier.union(found.select("query_id", "src")).union(found.select("query_id", "dst")).distinct()
    return found


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b), a <= b; parallel edges collapse without weights."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


#: A key is looked up by broadcast if it has more than HUB_ROWS rows and more than one in HUBS of all rows: fewer than HUBS keys.
HUB_ROWS, HUBS = 256, 10_000
#: So many edges between 64-bit nodes are joined in one task (a megabyte) instead of by rounds of Spark jobs.
TASK_EDGES = 1 << 16


def looked_up(rows: DataFrame, key: str, other: str, pairs: DataFrame, n: int, name: str, counts: DataFrame | None = None) -> DataFrame:
    """`rows` (n of them) with `name`: the `to` of their key in pairs (node, to), each node once, or null.

    Rows of frequent keys get theirs by broadcast, and are dealt by `other` (a column of the key's type) meanwhile, so
    that no key gathers its rows in one task. counts (node, count) are the keys' numbers of rows, if they are known.
    Whether there are frequent keys is asked first: each broadcast costs the driver memory and threads.
    """
    plain = lambda: rows.join(pairs.select(F.col("node").alias(key), F.col("to").alias(name)), key, "left").select(*rows.columns, name)
    if n <= HUB_ROWS:
        return plain()
    known = rows.groupBy(F.col(key).alias("node")).count() if counts is None else counts
    often = known.where(F.col("count") > max(HUB_ROWS, n // HUBS)).select(F.col("node").alias("hub__"))  # fewer than HUBS
    often = stored(often) if counts is None else often
    if not often.count():
        return plain()
    images = pairs.join(F.broadcast(often), F.col("node") == F.col("hub__")).select(F.col("node").alias("at__"), F.col("to").alias("hub_to__"))
    hubs = often.join(F.broadcast(images), F.col("hub__") == F.col("at__"), "left").select("hub__", "hub_to__")
    marked = rows.join(F.broadcast(hubs), F.col(key) == F.col("hub__"), "left").withColumn("is_hub__", F.col("hub__").isNotNull())
    dealt = marked.withColumn("deal__", F.when(F.col("is_hub__"), F.col(other)).otherwise(F.col(key)))
    light = pairs.select(F.col("node").alias("deal__"), F.lit(False).alias("is_hub__"), F.col("to").alias("to__"))
    found = dealt.join(light, ["deal__", "is_hub__"], "left")
    return found.select(*rows.columns, F.when(F.col("is_hub__"), F.col("hub_to__")).otherwise(F.col("to__")).alias(name))


def _moved(rows: DataFrame, key: str, other: str, pairs: DataFrame, n: int) -> DataFrame:
    found = looked_up(rows, key, other, pairs, n, "image__")
    return found.select(*[F.coalesce("image__", key).alias(c) if c == key else F.col(c) for c in rows.columns])


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges (a, b), and of each the smallest node reachable."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        x, y = low[x], low[y]
        x, y = np.minimum(x, y), np.maximum(x, y)
        x, y = x[x < y], y[x < y]
        if not len(x):
            return names, names[low]
        np.minimum.at(low, y, x)
        while (low[low] != low).any():
            low = low[low]


def _rooted_in_task(edges: DataFrame) -> DataFrame:
    """(node, comp) of TASK_EDGES edges (a, b) at most, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_reachable(*map(np.concatenate, zip(*ends, strict=True)))], names=["node", "comp"])

    reachable(edges.sparkSession)
    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, comp long")


def rooted(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); comp is the smallest node reachable, in the order of the node's type.

    Each round hooks every node to its smallest neighbour if that is smaller, halves the hooks' paths by pointer
    jumping until all point at their roots, and contracts the edges to roots; it ends when no edge is left. A path in
    order of its names takes one round of log2(length) jumps; among names in random order (see components) every round
    leaves a constant share of the nodes. Nothing is collected, and no node gathers its edges in one task, but when
    TASK_EDGES edges or fewer are left, whatever their nodes: one task joins these.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(ends.distinct())
    limit = TASK_EDGES if dict(rest.dtypes)["a"] == "bigint" else 0
    if limit and rest.count() <= limit:
        return stored(_rooted_in_task(rest))
    nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    labels, n_labels = stored(nodes.withColumn("comp", F.col("node"))), None
    while n := rest.count():
        n_labels = n_labels or labels.count()
        if n <= limit:
            return stored(_moved(labels, "comp", "node", stored(_rooted_in_task(rest)).withColumnRenamed("comp", "to"), n_labels))
        hooks = stored(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        n_hooks, open_ = hooks.count(), True
        while open_:
            jumped = stored(looked_up(hooks, "to", "node", hooks, n_hooks, "top"))
            open_ = jumped.where("top IS NOT NULL").limit(1).count() > 0
            hooks = jumped.select("node", F.coalesce("top", "to").alias("to")) if open_ else hooks
        moved = _moved(_moved(rest, "a", "b", hooks, n), "b", "a", hooks, n).where("a <> b")
        rest = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = stored(_moved(labels, "comp", "node", hooks, n_labels))
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, of every end of the edges (src, dst).

    Nodes work under their hash (with the name behind it, so that equal hashes stay apart): no order of names is slow.
    """
    name = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = rooted(edges.select(name("src").alias("a"), name("dst").alias("b")))
    smallest = labels.groupBy(F.col("comp").alias("node")).agg(F.min("node.n").alias("to"))
    found = looked_up(labels, "comp", "node", smallest, labels.count(), "least").select(F.col("node.n").alias("node"), F.col("least").alias("comp"))
    return ends.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def inner_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with both ends in one community (node, community)."""
    a = communities.select(F.col("node").alias("src"), "community")
    b = communities.select(F.col("node").alias("dst"), "community")
    return edges.join(a, "src").join(b, ["dst", "community"]).select("community", "src", "relationship", "dst")


def summaries(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, summary): its edges as lines, or its names where it has none."""
    line = F.concat("src", F.lit(" -> "), "relationship", F.lit(" -> "), "dst")
    lines = inner_edges(edges, communities).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    names = communities.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("names"))
    return names.join(lines, "community", "left").select("community", F.coalesce("lines", "names").alias("summary"))


def louvain_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Communities of an unweighted graph by local moves and aggregation, nodes in order, ties to the smallest label."""
    label_of = np.arange(n)
    weights: dict[tuple[int, int], float] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        weights[min(x, y), max(x, y)] = 1.0
    size = n
    while True:
        near: list[dict[int, float]] = [{} for _ in range(size)]
        degree, total = np.zeros(size), 0.0
        for (x, y), w in weights.items():
            total += w
            degree[x] += w
            degree[y] += w
            if x != y:
                near[x][y] = near[x].get(y, 0) + w
                near[y][x] = near[y].get(x, 0) + w
        comm, mass, improved = list(range(size)), degree.copy(), False
        moved = total > 0
        while moved:
            moved = False
            for v in range(size):
                own = comm[v]
                mass[own] -= degree[v]
                links: dict[int, float] = {}
                for u, w in near[v].items():
                    links[comm[u]] = links.get(comm[u], 0) + w
                gain = lambda c: links.get(c, 0.0) - mass[c] * degree[v] / (2 * total)  # noqa: B023, E731
                best = min([own, *links], key=lambda c: (-round(gain(c), 12), c != own, c))  # noqa: B023
                if best != own and gain(best) > gain(own) + 1e-12:
                    comm[v], moved, improved = best, True, True
                mass[comm[v]] += degree[v]
        if not improved:
            return label_of
        dense = {c: i for i, c in enumerate(sorted(set(comm)))}
        label_of = np.array([dense[comm[x]] for x in label_of.tolist()])
        merged: dict[tuple[int, int], float] = {}
        for (x, y), w in weights.items():
            p, q = sorted((dense[comm[x]], dense[comm[y]]))
            merged[p, q] = merged.get((p, q), 0) + w
        weights, size = merged, len(dense)


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community), each community named by its smallest node.

    Components are communities' upper bounds, so each component is one group; nodes without edges stay alone.
    """
    comps = components(edges)
    pairs = undirected(edges).join(comps.withColumnRenamed("node", "a"), "a")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([group["a"].to_numpy(), group["b"].to_numpy()]))
        labels = louvain_labels(np.searchsorted(names, group["a"]), np.searchsorted(names, group["b"]), len(names))
        first = {c: names[i] for i, c in reversed(list(enumerate(labels.tolist())))}
        return pd.DataFrame({"node": names, "community": [first[c] for c in labels.tolist()]})

    kind = dict(comps.dtypes)["node"]
    return pairs.select("comp", "a", "b").groupBy("comp").applyInPandas(run, f"node {kind}, community {kind}")


def leaders(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """The greedy fold over items (item_id) in order of id: an item joins the most similar earlier leader, or leads itself.

    pairs (a, b, sim), a < b, are those similar enough. An item leads if no earlier neighbour leads, which rounds of
    joins settle from the first items on: (item_id, leader, sim).
    """
    state = stored(items.select("item_id", F.lit(None).cast("boolean").alias("leads")))
    edges = stored(pairs.select("a", "b", "sim"))
    while True:
        before = edges.join(state.select(F.col("item_id").alias("a"), F.col("leads").alias("la")), "a").groupBy(F.col("b").alias("item_id"))
        seen = before.agg(F.bool_or(F.coalesce("la", F.lit(False))).alias("led"), F.bool_or(F.col("la").isNull()).alias("open"))
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = stored(state.join(seen, "item_id", "left").select("item_id", decided.alias("leads")))
        if not state.where("leads IS NULL").limit(1).count():
            break
    firsts = state.where("leads").select(F.col("item_id").alias("a"))
    order = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
    best = edges.join(firsts, "a").withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("b").alias("item_id"), F.col("a").alias("leader"), "sim")
    return state.join(best, "item_id", "left").select("item_id", F.when(F.col("leads"), F.col("item_id")).otherwise(F.col("leader")).alias("leader"), F.when(~F.col("leads"), F.col("sim")).alias("sim"))
