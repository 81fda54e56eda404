"""Passages that documents share, by sparse suffix arrays.

Of all suffixes (one per word) those at minimisers are kept: in each window of LENGTH words, the leftmost start
of the KEY-word sequence with the least hash. The choice depends on the window's words alone, so two equal
passages of LENGTH words keep suffixes at the same place in them. Kept suffixes whose KEY words occur in one
document only cannot be shared and go. The others are sorted by key, what follows it, and what precedes it, read
backwards; each is compared with its nearest neighbours from other documents on both sides, and the match is
extended to the left and right, CONTEXT words at most: longer passages keep further suffixes, whose matches
adjoin. Neighbours alone can miss a window of LENGTH words that is shared with a document further off, so the
windows around each key are also counted exactly: a window with `a` words ahead of its key can be shared only if
some other document agrees on `a` words ahead, which the nearest neighbour tells; each such window gets a hash,
and hashes of two documents or more are matches. Matches of LENGTH words or more are joined to passages.

The order is cut into ranges of rows, so a frequent key takes several tasks. The neighbours of a range's first and
last document are in other tasks; all windows around their keys are counted instead.

Words are compared by hashes (24 bits each beyond the key's 64). Texts with fewer than LENGTH words, null or
empty texts, and null ids have no passages; rows that repeat an id are one document; repetition inside one
document does not count. An empty table gives no passages. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import LOWERED, blocks, mixed, powers, reachable, span_hashes, stored, table, utf8, word_spans

LENGTH, KEY = 50, 25
CONTEXT = LENGTH - KEY
#: Suffixes whose contexts are made at a time, whatever the text's length.
SLICE = 8192
_PLACE = np.uint64(28)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows (letter case ignored) and where each row starts."""
    first, end, row = word_spans(data, offsets)
    words = span_hashes(LOWERED[data[offsets[0] : offsets[-1]]], first, end)
    return words, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))]).astype(np.int64)


def key_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of the KEY words from each word on."""
    if len(words) < KEY:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
        return mixed((sums[KEY:] - sums[:-KEY]) * down[: len(words) - KEY + 1], 30)


def kept_suffixes(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes and the hashes of their keys."""
    hashes = key_hashes(words)
    span = LENGTH - KEY + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = hashes >> _PLACE << _PLACE | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: -(span - size)], low[span - size :])
    inside = np.zeros(len(words) + 1, np.int64)  # windows from starts that reach a row's end are none
    ends = cuts[1:]
    np.add.at(inside, np.maximum(cuts[:-1], ends - LENGTH + 1), 1)
    np.add.at(inside, ends, -1)
    whole = np.cumsum(inside)[: len(low)] == 0
    places = np.unique(low[whole] & np.uint64((1 << 28) - 1)).astype(np.int64)
    return places, hashes[places]


def anchors(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos) of every kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            ids = b.column(0).to_numpy()
            for lo, hi in blocks(offsets):
                words, cuts = words_of(data, offsets[lo : hi + 1])
                places, keys = kept_suffixes(words, cuts)
                row = np.searchsorted(cuts, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[lo + row]), pa.array((places - cuts[row]).astype(np.int32))], names=["key", "doc_id", "pos"])

    return docs.mapInArrow(run, "key long, doc_id long, pos int")


def _packed(words: np.ndarray, start: np.ndarray, step: int, n: np.ndarray) -> pa.Array:
    """24 bits of each of the n words from start on, in steps of 1 or -1; CONTEXT words wide, the rest 0."""
    out = np.zeros((len(start), CONTEXT, 3), np.uint8)
    for k in range(CONTEXT):
        have = np.flatnonzero(n > k)
        w = words[start[have] + step * k]
        for byte, shift in enumerate((56, 48, 40)):
            out[have, k, byte] = (w >> np.uint64(shift)).astype(np.uint8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(3 * CONTEXT), len(start), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def contexts(docs: DataFrame) -> DataFrame:
    """(key, ahead, behind, n_ahead, n_behind, doc_id, pos) of the suffixes at `places` of (doc_id, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ahead", "behind", "n_ahead", "n_behind", "doc_id", "pos"]
        for b in batches:
            data, offsets = utf8(b.column(1))
            ids = b.column(0).to_numpy()
            for lo, hi in blocks(offsets):
                words, cuts = words_of(data, offsets[lo : hi + 1])
                hashes = key_hashes(words)
                part = b.column(2).slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                pos = part.flatten().to_numpy()
                good = np.flatnonzero(cuts[row] + pos + KEY <= cuts[row + 1])  # rows that repeat an id may be shorter
                for a in range(0, len(good), SLICE):
                    r, p = row[good[a : a + SLICE]], pos[good[a : a + SLICE]].astype(np.int64)
                    at = cuts[r] + p
                    n_ahead, n_behind = np.minimum(CONTEXT, cuts[r + 1] - at - KEY), np.minimum(CONTEXT, p)
                    columns = [pa.array(hashes[at].view(np.int64)), _packed(words, at + KEY, 1, n_ahead), _packed(words, at - 1, -1, n_behind), pa.array(n_ahead.astype(np.int32)), pa.array(n_behind.astype(np.int32)), pa.array(ids[lo + r]), pa.array(p.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, "key long, ahead binary, behind binary, n_ahead int, n_behind int, doc_id long, pos int")


def _common(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words the contexts share from the key on."""
    same = (a.reshape(-1, CONTEXT, 3) == b.reshape(-1, CONTEXT, 3)).all(-1)
    return np.minimum(n, np.where(same.all(1), CONTEXT, same.argmin(1)))


def _prefix_hashes(context: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the first 0, 1, ... CONTEXT words of each context."""
    parts = context.reshape(-1, CONTEXT, 3).astype(np.uint64)
    words = parts[:, :, 0] << np.uint64(16) | parts[:, :, 1] << np.uint64(8) | parts[:, :, 2]
    terms = mixed(words | np.arange(CONTEXT, dtype=np.uint64) << np.uint64(24), salt)
    return np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def _settled(t: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of a table sorted by (key, ahead, behind, doc_id) whose windows the neighbour comparison has all found.

    These are both rows of a group of two, and rows between the first and the last of equal contexts in several
    documents (those two stand for them). What lies beyond the table's ends is unknown and settles nothing.
    """
    key, doc, n = t["key"], t["doc_id"], len(t["key"])
    begins = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, n))
    pair = size == 2
    pair[0] = pair[-1] = False
    pair[pair] = doc[first[pair]] != doc[first[pair] + 1]
    same = ~begins[1:]
    for c in ("ahead", "behind"):
        same &= (t[c][1:] == t[c][:-1]).all(1)
    for c in ("n_ahead", "n_behind"):
        same &= t[c][1:] == t[c][:-1]
    kind = np.concatenate([[0], np.cumsum(~same)])
    edge = np.flatnonzero(np.concatenate([[True], ~same]))
    several = doc[edge] != doc[np.append(edge[1:], n) - 1]
    return np.repeat(pair, size) | (np.concatenate([[False], same]) & np.concatenate([same, [False]]) & several[kind])


def _windows(t: dict[str, np.ndarray], i: np.ndarray, agreed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of the windows around the keys of rows i that have at most `agreed` words ahead."""
    low = CONTEXT - t["n_behind"][i].astype(np.int64)
    n = np.maximum(0, agreed - low + 1)
    hashes = t["key"][i].view(np.uint64)[:, None], _prefix_hashes(t["ahead"][i], 31), _prefix_hashes(t["behind"][i], 32)
    at = np.repeat(np.arange(len(i)), n)
    ahead = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[at]
    window = mixed(hashes[0][at, 0] + mixed(hashes[1][at, ahead], 33) + mixed(hashes[2][at, CONTEXT - ahead], 34), 35)
    return i[at], t["pos"][i[at]] - (CONTEXT - ahead), window


def matches(sorted_rows: DataFrame) -> DataFrame:
    """(doc_id, first, last, window) of the matches of sorted suffixes with their neighbours; last is exclusive.

    Also the windows that may be shared, by their hashes; window is null in matches. Partitions may begin and end
    anywhere in the order: a suffix whose neighbour lies beyond its partition asks for every window around its key.
    Any suffix between it and a match in another partition agrees with both as far as they do, or ends its
    partition too, so both sides of a shared window ask for it.
    """

    def compared(t: dict[str, np.ndarray], upto: int, start: int) -> pa.RecordBatch:
        key, doc, n = t["key"], t["doc_id"], len(t["key"])
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
        run_of = np.cumsum(np.bincount(edge, minlength=n)) - 1
        out = []
        mine = np.arange(start, upto)
        agreed = np.full(upto - start, -1, np.int64)
        for other in (edge[run_of[mine]] - 1, np.append(edge, n)[run_of[mine] + 1]):
            ok = (other >= 0) & (other < n)
            agreed[~ok] = t["n_ahead"][mine[~ok]]
            i, j = mine[ok], other[ok]
            i, j = i[key[i] == key[j]], j[key[i] == key[j]]
            ahead = _common(t["ahead"][i], t["ahead"][j], np.minimum(t["n_ahead"][i], t["n_ahead"][j]))
            behind = _common(t["behind"][i], t["behind"][j], np.minimum(t["n_behind"][i], t["n_behind"][j]))
            agreed[i - start] = np.maximum(agreed[i - start], ahead)
            long = behind + KEY + ahead >= LENGTH
            i, ahead, behind = i[long], ahead[long], behind[long]
            out.append((doc[i], t["pos"][i] - behind, t["pos"][i] + KEY + ahead, np.zeros(len(i), np.uint64), np.ones(len(i), bool)))
        ask = np.flatnonzero(~_settled(t)[start:upto] & (agreed >= 0))
        i, first, window = _windows(t, mine[ask], agreed[ask])
        out.append((doc[i], first, first + LENGTH, window, np.zeros(len(i), bool)))
        columns = [np.concatenate([o[c] for o in out]) for c in range(5)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].view(np.int64), mask=columns[4])], names=["doc_id", "first", "last", "window"])

    def table_of(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        plain = {c: b.column(c).to_numpy() for c in ("key", "n_ahead", "n_behind", "doc_id", "pos")}
        return plain | {c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 3 * CONTEXT) for c in ("ahead", "behind")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = table_of(b)
            t = {c: np.concatenate([held[c], t[c]]) for c in t} if held else t
            change = np.flatnonzero((t["key"][1:] != t["key"][:-1]) | (t["doc_id"][1:] != t["doc_id"][:-1])) + 1
            last = int(change[-1]) if len(change) else 0  # the last document's run may go on in the next batch
            if last > start:
                yield compared(t, last, start)
                start = last
            keep = max(0, start - 1)
            held, start = {c: v[keep:] for c, v in t.items()}, start - keep
        if held and len(held["key"]) > start:
            yield compared(held, len(held["key"]), start)

    return sorted_rows.mapInArrow(run, "doc_id long, first int, last int, window long")


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word) of each maximal stretch of a document that shared passages cover; ends are exclusive."""
    reachable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    kept = stored(anchors(rows))
    # stored, so that the join's sides have exchanges of their own and a frequent key can be split
    shared = stored(kept.groupBy("key").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 <> d1").select("key"))
    places = kept.join(shared, "key").groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("places"))  # one document's at a time
    suffixes = stored(contexts(rows.join(places, "doc_id").select("doc_id", "text", "places")))
    order = ["key", "ahead", "behind", "doc_id", "pos"]
    asked = stored(matches(suffixes.repartitionByRange(*order).sortWithinPartitions(*order)))
    windows = asked.where("window IS NOT NULL")
    common = windows.groupBy("window").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 <> d1").select("window")
    span = ["doc_id", "first", "last"]
    found = asked.where("window IS NULL").select(span).union(windows.join(common, "window", "left_semi").select(span))
    by = Window.partitionBy("doc_id").orderBy("first", F.desc("last"))
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.distinct().withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("first")).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("first").alias("start_word"), F.max("last").alias("end_word")).drop("island")


def op8_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"), (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"))


OP8_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
 i AS MATERIALIZED (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50),
 g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM i),
 h AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
 c AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g SEMI JOIN h USING (h)),
 k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + 50)::BIGINT AS end_word, (max(i) + 50 - min(i))::BIGINT AS n_words FROM k GROUP BY doc_id, island
"""
