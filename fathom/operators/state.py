"""Time and state: nearest-in-time join, caches, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars per million tokens and the cache's multipliers.
INPUT_PRICE, OUTPUT_PRICE, WRITE_FACTOR, READ_FACTOR = 2.0, 10.0, 1.25, 0.1


def nearest_in_time(left: DataFrame, right: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Each row of left (id, ts) with the row of right (rid, rts) nearest in time; ties go to the earlier one, then the smaller rid.

    Both sides are sorted within time buckets only. What a bucket needs from outside is the last right row before
    it and the first after it, which come from one row per bucket, so no task sees all rows and nothing is crossed.
    """
    at = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp_ltz")) / F.lit(bucket_s * 1_000_000)).cast("long")
    l, r = left.select("id", "ts", at("ts").alias("bucket")), right.select("rid", "rts", at("rts").alias("bucket"))  # noqa: E741
    spot = F.struct("rts", "rid")
    ends = r.groupBy("bucket").agg(F.min(spot).alias("first"), F.max_by(spot, F.struct("rts", (-F.col("rid")).alias("o"))).alias("last"))
    every = l.select("bucket").union(r.select("bucket")).distinct().join(ends, "bucket", "left")
    super_bucket = F.floor(F.col("bucket") / 1024)
    grouped = every.withColumn("big", super_bucket)
    inside = Window.partitionBy("big").orderBy("bucket")
    near = grouped.withColumn("prev", F.last("last", True).over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.first("first", True).over(inside.rowsBetween(1, Window.unboundedFollowing)))
    bigs = grouped.groupBy("big").agg(F.min("first").alias("bf"), F.max("last").alias("bl"))
    over = Window.orderBy("big")  # one row for each 1024 buckets
    carry = bigs.select("big", F.last("bl", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("bp"), F.first("bf", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("bn"))
    near = near.join(carry, "big").select("bucket", F.coalesce("prev", "bp").alias("prev"), F.coalesce("next", "bn").alias("next"))
    rows = l.select("bucket", F.col("ts").alias("t"), "id", F.lit(None).cast("struct<rts:timestamp_ntz,rid:bigint>").alias("r")).union(r.select("bucket", "rts", F.lit(None).cast("long"), spot))
    forth = Window.partitionBy("bucket").orderBy(F.col("t"), F.col("id").asc_nulls_first(), F.col("r.rid").desc())
    back = Window.partitionBy("bucket").orderBy(F.col("t").desc(), F.col("id").asc_nulls_first(), F.col("r.rid").desc())
    filled = rows.withColumn("b", F.last("r", True).over(forth.rowsBetween(Window.unboundedPreceding, 0))).withColumn("f", F.last("r", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    both = filled.where("id IS NOT NULL").join(near, "bucket").select("id", "t", F.coalesce("b", "prev").alias("b"), F.coalesce("f", "next").alias("f"))
    gap = lambda c: F.abs(F.unix_micros(F.col("t").cast("timestamp_ltz")) - F.unix_micros(F.col(f"{c}.rts").cast("timestamp_ltz")))
    pick = F.when(F.col("f").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("f")).when(gap("f") < gap("b"), F.col("f")).otherwise(F.col("b"))
    return both.select("id", pick["rid"].alias("rid"), F.when(pick["rid"].isNotNull(), F.abs(F.unix_micros(F.col("t").cast("timestamp_ltz")) - F.unix_micros(pick["rts"].cast("timestamp_ltz")))).alias("gap_us"))


def cost(input_tokens: Column, written: Column, read: Column, output_tokens: Column) -> Column:
    """Dollars of one call."""
    million = 1_000_000
    return input_tokens / million * INPUT_PRICE + written / million * INPUT_PRICE * WRITE_FACTOR + read / million * INPUT_PRICE * READ_FACTOR + output_tokens / million * OUTPUT_PRICE


def cache_events(calls: DataFrame, key: str, ttl_s: int = 300) -> DataFrame:
    """Calls (key, id, ts) labelled WRITE (first, or the cache has expired) or READ; every use renews the cache."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "id"))
    gap = F.timestamp_diff("MICROSECOND", before, F.col("ts"))
    return calls.withColumn("cache", F.when(before.isNull() | (gap > ttl_s * 1_000_000), "WRITE").otherwise("READ"))


def shares(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's share of its group's total; 0 for a total of 0."""
    total = F.sum(value).over(Window.partitionBy(group))
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)))
