"""Shard assignment by jump consistent hashing.

A key walks through ever larger shard counts and jumps to the last shard that it would move to; no ring
table is kept, and growing from n to n+1 shards moves only the rows that land in the new shard.

Slots number the rows of a shard from 0 without gaps. No shard is gathered in one task: rows are ordered
inside (shard, cell) groups, cells being dealt by a hash of the key and the text's checksum (CELLS a shard, and
more, in powers of two, so that a cell holds some CELL_ROWS of many rows), and the cells' counts give each group its first slot.

Null keys share one fixed key, so one shard, over its cells; null texts have 8 bytes of size and crc 0; repeated rows get
separate slots of the same shard; empty texts are texts of no bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import mixed, reachable, stored, table

SHARDS = 24
CELLS, CELL_ROWS = 1024, 65_536
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard in [0, shards) of each 64-bit key."""
    key = keys.astype(np.uint64).copy()
    at, nxt = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = nxt[live]
            key[live] = key[live] * _STEP + np.uint64(1)
            nxt[live] = ((at[live] + 1) * (2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[nxt[live] < shards]
    return at.astype(np.int32)


def with_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """`docs` with shard and grown_shard (of one shard more), functions of the key and the shard count alone, and place, a
    64-bit hash of the key. Columns of these names are replaced."""
    reachable(docs.sparkSession)
    docs = docs.drop(*({"shard", "grown_shard", "place"} - {key}))
    at = docs.columns.index(key)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(at)
            raw = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.uint64(0x5EED), mixed(raw, 1))
            more = [jump_hash(keys, shards), jump_hash(keys, shards + 1), keys.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=[*b.schema.names, "shard", "grown_shard", "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(add, f"{kinds}, shard int, grown_shard int, place long")


def with_cells(placed: DataFrame, cells: int) -> DataFrame:
    """`placed` with cell: the hash of place and text_crc32, modulo `cells`, instead of place."""
    at = [placed.columns.index(c) for c in ("place", "text_crc32")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, crc = (b.column(i).to_numpy().view(np.uint64) for i in at)
            cell = (mixed(place ^ crc, 2) % np.uint64(cells)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell) if i == at[0] else c for i, c in enumerate(b.columns)], names=b.schema.names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    return placed.mapInArrow(add, kinds).withColumnRenamed("place", "cell")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs`."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    cells = CELLS * 2 ** max(0, math.ceil(math.log2(max(1, docs.count()) / (CELLS * CELL_ROWS * shards))))
    placed = stored(with_cells(with_shards(rows, shards), cells))
    counts = placed.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # `cells` rows
    first = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("n", F.row_number().over(inside)).join(first, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), SHARDS)


_M = "18446744073709551616::UHUGEINT"
_GOLD = 0x9E3779B97F4A7C15


def _mixed_sql(source: str, column: str, salt: int, name: str) -> str:
    """CTEs after which {name} has column m: the mixed value of `column` of `source`."""
    c = (salt * _GOLD + _GOLD) % 2**64
    return f"""
 {name}1 AS (SELECT *, ({column}::UHUGEINT + {c}::UHUGEINT) % {_M} AS m1 FROM {source}),
 {name}2 AS (SELECT *, (xor(m1, m1 // {2**30}::UHUGEINT) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {_M} AS m2 FROM {name}1),
 {name}3 AS (SELECT *, (xor(m2, m2 // {2**27}::UHUGEINT) * {0x94D049BB133111EB}::UHUGEINT) % {_M} AS m3 FROM {name}2),
 {name} AS MATERIALIZED (SELECT * EXCLUDE (m1, m2, m3), xor(m3, m3 // {2**31}::UHUGEINT) AS m FROM {name}3)"""


def _jump_sql(name: str, shards: int) -> str:
    return f""" {name}(k, key, b, j) AS (SELECT k, k, -1::BIGINT, 0::BIGINT FROM keys
   UNION ALL SELECT k, key2, j, floor((j + 1) * (2147483648::DOUBLE / ((key2 // {2**33}::UHUGEINT)::DOUBLE + 1)))::BIGINT
     FROM (SELECT *, (key * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % {_M} AS key2 FROM {name} WHERE j < {shards}))"""


#: The checksum byte by byte from a table of 256, the hash and the jumps in 128-bit integers; ids of 0 and more.
OP9_SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)::BIGINT AS v FROM range(0, 256) r(i))),
 hx AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 bytes_of AS MATERIALIZED (SELECT doc_id, length(x) // 2 + 8 AS size, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::BIGINT) AS b FROM hx),
 crc AS MATERIALIZED (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c // 256, tab.t[xor(c % 256, y) + 1])), 4294967295)::BIGINT AS text_crc32 FROM bytes_of, tab),
 {_mixed_sql("crc", "coalesce(doc_id, 0)", 1, "mk").lstrip()},
 kk AS MATERIALIZED (SELECT * EXCLUDE (m), CASE WHEN doc_id IS NULL THEN {0x5EED}::UHUGEINT ELSE m END AS k FROM mk),
 {_mixed_sql("kk", "xor(k, text_crc32::UHUGEINT)", 2, "mc").lstrip()},
 keys AS MATERIALIZED (SELECT DISTINCT k FROM kk),
{_jump_sql("ja", SHARDS)},
{_jump_sql("jb", SHARDS + 1)},
 sa AS (SELECT k, max(b) AS shard FROM ja GROUP BY k), sb AS (SELECT k, max(b) AS grown FROM jb GROUP BY k)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
 (row_number() OVER (PARTITION BY shard ORDER BY m % {CELLS}::UHUGEINT, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM mc JOIN sa USING (k) JOIN sb USING (k)
"""
