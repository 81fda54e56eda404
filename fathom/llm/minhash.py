"""Near-duplicate documents by SetSketch registers over word shingles.

A register holds floor(1 - log_b x) of the smallest of a set's exponential variates x, cut to 0 .. LIMIT: a
truncated minimum on an exponential scale. Sketches of a union are registers' maxima (merged), and equal
registers are as likely as sets are similar. Work runs in these steps:

1. every text is hashed into its set of shingles; sets get an exact 128-bit fingerprint and a sketch;
2. equal sets become one node, so that exact copies cost one row each from here on;
3. registers are banded, BANDS of ROWS; the members of a band's bucket are tied to its first member, and the
   components of these ties are clusters: two nodes that share a band are in one cluster;
4. a cluster is a group, dealt into blocks of BLOCK nodes and BLOCK_BYTES of sets at most (on average), and each two of
   its blocks meet in one task. In a cluster of more than BANDS blocks, where that would copy a text more often than
   its bands do, every node is first verified against the likeliest head of its buckets, which joins groups of near
   copies in linear work, and then each bucket whose nodes are not joined yet is a group;
5. within a group, pairs that share a band and fit by size are estimated jointly from all registers and both set
   sizes by maximum likelihood; those more than SIGMAS standard errors below the threshold are dropped, the others
   verified on full sets, likelier ones first, unless verified links join them already; what leaves a group is a
   spanning forest, so groups of copies never expand into pairs of rows;
6. the links' components are the result.

A pair at the threshold misses all bands with probability (1 - t^ROWS)^BANDS: 8e-7 for 0.85, 7e-5 for 0.8.

Rows with a null id or without words (null, empty or blank text) have an empty or unlinked set: they link
with nothing and are kept. Repeated rows are copies. An empty table gives none. Very long texts are hashed in pieces
(work arrays take some 16 bytes a byte of text). Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import LOWERED, blocks, mixed, reachable, span_hashes, stored, table, utf8, word_spans
from fathom.llm.components import components
from fathom.operators.graph import HUB_ROWS, looked_up

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
SCALE_BASE, RATE, LIMIT = 1.001, 20.0, 65535
SIGMAS = 5.0
#: Nodes of a block and bytes of their sets; two blocks meet in one task at a time.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Blocks of a cluster that is one group.
MOST_BLOCKS = BANDS
_FACTORS = mixed(np.arange(REGISTERS), 7) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct shingle hashes, row after row, and where each row starts (n+1 offsets)."""
    text = LOWERED[data[offsets[0] : offsets[-1]]]
    n = len(offsets) - 1
    first, end, row = word_spans(data, offsets)
    words = span_hashes(text, first, end)
    count = np.bincount(row, minlength=n)
    if not len(words):
        return words, np.zeros(n + 1, np.int64)
    size = np.minimum(width, count)[row]
    start = np.cumsum(count) - count
    place = np.arange(len(words)) - start[row]
    heads = np.flatnonzero(place + size <= count[row])
    hashes = mixed(words[heads], 10)
    for j in range(1, width):
        more = np.flatnonzero(size[heads] > j)
        with np.errstate(over="ignore"):
            hashes[more] = mixed(hashes[more] + words[heads[more] + j] * np.uint64(2 * j + 1), 10 + j)
    owner = row[heads]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    fresh = np.ones(len(hashes), bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            part = np.sort(hashes[a:b])
            hashes[a:b] = part
            fresh[a + 1 : b] = part[1:] != part[:-1]
    kept = np.concatenate([[0], np.cumsum(fresh)])[cuts]
    return hashes[fresh], kept


def registers(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sketches of non-empty sets, one row each."""
    low = np.empty((len(cuts) - 1, REGISTERS), np.uint64)
    with np.errstate(over="ignore"):
        for i, factor in enumerate(_FACTORS):
            low[:, i] = np.minimum.reduceat(sets * factor, cuts[:-1])
    u = (low >> np.uint64(11)).astype(np.float64) * 2.0**-53
    x = -np.log1p(-u) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(x) / math.log(SCALE_BASE))
    return np.clip(k, 0, LIMIT).astype("<u2")


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of sketch pairs whose set sizes are known."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - up - down
    u, v = na / (na + nb), nb / (na + nb)
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (SCALE_BASE - 1) / SCALE_BASE) / math.log(SCALE_BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = chance(u - v * j), chance(v - u * j)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave: narrow around its top
        third = (high - low) / 3
        better = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(better, low + third, low), np.where(better, high, high - third)
    return (low + high) / 2


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, node (64 bits of the set's fingerprint), check (64 more), n_shingles and regs of every row; empty sets have null regs."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            for lo, hi in blocks(offsets):
                sets, cuts = shingle_sets(data, offsets[lo : hi + 1], width)
                size = np.diff(cuts)
                full = np.flatnonzero(size)
                node, check = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                regs: list[bytes | None] = [None] * (hi - lo)
                if len(full):
                    own = np.concatenate([cuts[full], cuts[-1:]])
                    with np.errstate(over="ignore"):
                        node[full], check[full] = (np.add.reduceat(mixed(sets, s), own[:-1]) for s in (20, 21))
                        node[full] = mixed(node[full] + size[full].astype(np.uint64), 22)
                    for i, r in zip(full.tolist(), registers(sets, own), strict=True):
                        regs[i] = r.tobytes()
                own = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "text_hash", "node", "check", "n_shingles", "regs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, check long, n_shingles long, regs binary")


def band_keys(regs: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(i), F.substring(regs, 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])


def floor_of(least: tuple[int, int]) -> float:
    """The least estimate of a pair that is verified: SIGMAS standard errors below the threshold."""
    threshold = least[0] / least[1]
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def linked(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sorted sets are as similar as the threshold."""
    where = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[where] == b).sum())
    return least[1] * common >= least[0] * (len(a) + len(b) - common)


def spanning_links(regs: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], block: np.ndarray, comp: np.ndarray, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join the rows as all verified links would: likelier pairs first, pairs already joined (equal comp) are skipped.

    Pairs share a band, fit by size, and lie in different blocks if there are two.
    """
    threshold, floor = least[0] / least[1], floor_of(least)
    with np.errstate(over="ignore"):
        bands = (regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64) * (mixed(np.arange(ROWS), 8) | np.uint64(1))).sum(2, dtype=np.uint64)
    together = np.zeros((len(regs), len(regs)), bool)
    for k in range(BANDS):
        together |= bands[:, k, None] == bands[:, k]
    together &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes) - 1e-9
    together &= comp[:, None] != comp
    if block.min() != block.max():
        together &= block[:, None] != block
    x, y = np.nonzero(np.triu(together, 1))
    score = np.concatenate([similarity(regs[x[k : k + 20_000]], regs[y[k : k + 20_000]], sizes[x[k : k + 20_000]], sizes[y[k : k + 20_000]]) for k in range(0, len(x), 20_000)]) if len(x) else np.zeros(0)
    order = np.argsort(-score, kind="stable")
    order = order[score[order] >= floor]
    head, out = np.unique(comp, return_index=True)[1][np.unique(comp, return_inverse=True)[1]].tolist(), []

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        p, q = root(i), root(j)
        if p == q:
            continue
        if linked(sets[i], sets[j], least):
            head[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def _sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    data, offsets = utf8(column)
    out = []
    for lo, hi in blocks(offsets):
        own, cuts = shingle_sets(data, offsets[lo : hi + 1], width)
        out += [own[c:d] for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def verified(rows: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) that span what the verified links of each group of (grp, blocks, node, comp, n_shingles, regs, text) join.

    A group's nodes are dealt into blocks by hash and every two blocks meet in one task at a time, so that a group of
    any size spreads over tasks and no pairs leave a task but links of a spanning forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            column = lambda k: np.concatenate([p.column(k).to_numpy() for p in parts])
            node, out = column(4), []
            if len(node) > 1:
                regs = np.frombuffer(b"".join(x for p in parts for x in p.column(7).to_pylist()), "<u2").reshape(-1, REGISTERS)
                out = spanning_links(regs, column(6).astype(float), [x for p in parts for x in _sets_of(p.column(8), width)], column(3), column(5), least)
            return pa.RecordBatch.from_arrays([pa.array([node[x[k]] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        at, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            group = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [b.num_rows]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(group[lo]) != at and parts:
                    yield links(parts)
                    parts = []
                at = tuple(group[lo])
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield links(parts)

    own = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = met.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n_shingles", "regs", "text")
    return groups.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, "a long, b long")


def likeliest_heads(ties: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): each node b of the ties (node, head) with the head a whose sketch says that they are likeliest linked, if any may be."""
    n = ties.count()
    mine = ties.join(nodes.select("node", F.struct("n_shingles", "regs").alias("own")), "node")
    both = looked_up(stored(mine), "head", "node", nodes.select("node", F.struct("n_shingles", "regs").alias("to")), n, "its")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, threshold = floor_of(least), least[0] / least[1]
        for b in batches:
            if b.num_rows:
                sizes = [b.column(k).to_numpy().astype(float) for k in (2, 4)]
                regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (3, 5)]
                score = similarity(*regs, *sizes)
                good = (score >= floor) & (np.minimum(*sizes) >= threshold * np.maximum(*sizes) - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[good]), pa.array(b.column(1).to_numpy()[good]), pa.array(score[good])], names=["node", "head", "score"])

    scored = both.select("node", "head", "own.n_shingles", "own.regs", F.col("its.n_shingles").alias("n2"), F.col("its.regs").alias("regs2")).mapInArrow(run, "node long, head long, score double")
    return scored.groupBy("node").agg(F.max_by("head", F.struct("score", "head")).alias("a")).select("a", F.col("node").alias("b"))


def joined_to_heads(pairs: DataFrame, texts: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are links on their full sets. A frequent a is dealt into parts of HUB_ROWS pairs, each with its text."""
    pairs = stored(pairs)
    counts = stored(pairs.groupBy(F.col("a").alias("node")).count())
    parts = lambda n: F.ceil(F.col(n) / HUB_ROWS).cast("int")
    dealt = looked_up(pairs, "a", "b", counts.select("node", F.col("count").alias("to")), pairs.count(), "n", counts)
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), parts("n")).cast("int").alias("part"), F.col("b").alias("node"))
    heads = counts.join(texts, "node").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), parts("count") - 1)).alias("part"), F.col("text").alias("head_text"))
    rows = dealt.join(texts, "node").join(heads.hint("merge"), ["a", "part"]).select("a", "node", "head_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for b in batches:
            a, node, good = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            for i in range(b.num_rows):
                if a[i] != at:
                    at, own = a[i], _sets_of(b.column(2).slice(i, 1), width)[0]
                good.append(linked(own, _sets_of(b.column(3).slice(i, 1), width)[0], least))
            good = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(node[good])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _blocks(n: str, bytes_: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(bytes_) / BLOCK_BYTES)).cast("int")


def _links(docs: DataFrame, nodes: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """Verified links (a, b) that join the nodes (node, label, n_shingles, regs) as all links would."""
    bands = nodes.select("node", F.explode(band_keys(F.col("regs"))).alias("key"))
    buckets = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("to")).where("count > 1").withColumnRenamed("key", "node"))
    members = stored(looked_up(bands, "key", "node", buckets, nodes.count() * BANDS, "head", buckets).where("head IS NOT NULL"))
    ties = stored(members.where("node <> head").select("node", "head").distinct())
    clusters = components(ties.select(F.col("head").alias("a"), F.col("node").alias("b"))).select("node", F.col("comp").alias("cluster"))
    sized = clusters.join(nodes.select("node", "n_shingles"), "node")
    sizes = stored(sized.groupBy(F.col("cluster").alias("node")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("n_shingles") * 8).alias("bytes")).withColumn("to", _blocks("count", "bytes")))
    placed = stored(looked_up(clusters, "cluster", "node", sizes, clusters.count(), "blocks", sizes))
    wanted = placed.join(nodes.select("node", "label", "n_shingles", "regs"), "node")
    ids = wanted.select(F.col("label.id").alias("doc_id"), F.col("label.t").alias("t"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").join(ids.hint("merge"), ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"])
    large = placed.where(F.col("blocks") > MOST_BLOCKS).select("node")
    some_large = large.limit(1).count() > 0
    texts = stored(texts) if some_large else texts
    group = ["grp", "blocks", "node", "comp", "n_shingles", "regs", "text"]
    small = wanted.where(F.col("blocks") <= MOST_BLOCKS).select(F.col("cluster").alias("grp"), "blocks", "node", F.col("node").alias("comp"), "n_shingles", "regs")
    links = verified(small.join(texts, "node").select(group), width, least)
    if not some_large:
        return links
    first = stored(joined_to_heads(likeliest_heads(ties.join(large, "node", "left_semi"), nodes, least), texts, width, least))
    inside = members.join(large, "node", "left_semi").join(components(first), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")).join(nodes.select("node", "n_shingles"), "node")
    inside = stored(inside)
    open_ = stored(inside.groupBy(F.col("key").alias("node")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("n_shingles") * 8).alias("bytes"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").withColumn("to", _blocks("count", "bytes")))
    rest = looked_up(inside, "key", "node", open_, inside.count(), "blocks", open_).where("blocks IS NOT NULL")
    rest = rest.join(nodes.select("node", "regs"), "node").join(texts, "node").withColumnRenamed("key", "grp").select(group)
    return links.union(first).union(verified(rest, width, least))


def grouped(docs: DataFrame, width: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, text_hash, n_shingles and component (the smallest (id, text hash) reachable; null if nothing is linked) of every row."""
    rows = stored(sketched(docs, width))
    live = rows.where(F.col("regs").isNotNull() & F.col("doc_id").isNotNull())
    label = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("t"))
    nodes = stored(live.groupBy("node", "check", "n_shingles").agg(F.min(label).alias("label"), F.first("regs").alias("regs")))
    final = components(_links(docs, nodes, width, least))
    labelled = stored(nodes.select("node", "label").join(final, "node", "left").select("node", "label", F.coalesce("comp", "node").alias("comp")))
    smallest = stored(labelled.groupBy(F.col("comp").alias("node")).agg(F.min("label").alias("to"), F.count(F.lit(1)).alias("count")))
    of_node = looked_up(labelled, "comp", "node", smallest, labelled.count(), "component", smallest).select("node", F.col("component").alias("to"))
    slim = rows.select("doc_id", "text_hash", "n_shingles", "node", (F.col("regs").isNotNull() & F.col("doc_id").isNotNull()).alias("live"))
    found = looked_up(slim, "node", "text_hash", of_node, rows.count(), "component")
    return found.select("doc_id", "text_hash", "n_shingles", F.when(F.col("live"), F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`.

    Documents are linked if least[1] * intersection >= least[0] * union of their sets of `width`-word shingles.
    """
    out = grouped(docs, width, least).select("doc_id", "n_shingles", F.coalesce("component.id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, width: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `docs` that are kept: of each group the row with the smallest id (and text hash), of its repetitions
    the first by the other columns that have an order; rows with a null id all stay."""
    mine = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("t"))
    heads = grouped(docs, width, least).where(F.col("doc_id").isNotNull() & F.coalesce(mine == F.col("component"), F.lit(True)))
    kept = stored(heads.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct())
    at = [F.col("doc_id").cast("long") == F.col("kept_id"), F.xxhash64("text") == F.col("kept_hash")]
    named = docs.join(kept.hint("merge"), at, "left_semi")
    others = [f.name for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))]
    first = Window.partitionBy(F.col("doc_id").cast("long"), F.xxhash64("text")).orderBy(*[F.col(f"`{c}`") for c in others])
    rank = next(f"nth{i}" for i in range(len(docs.columns) + 1) if f"nth{i}" not in docs.columns)
    return named.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(docs.columns).union(docs.where("doc_id IS NULL"))


def op1_setsketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, (85, 100))


OP1_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 i AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], chr(1))) AS s FROM i),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(node, other) AS (SELECT a, b FROM g UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS low FROM r GROUP BY 1) m USING (doc_id)
"""
