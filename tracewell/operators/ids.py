"""Consecutive ids without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(rows: DataFrame, key: str, count: str, bucket: Column, name: str = "start") -> DataFrame:
    """Adds the sum of count over all rows before this one, in (bucket, key) order.

    Sums go per bucket first: only one row a bucket is ordered in one place, and
    that many rows are ordered at once. key is unique within its bucket."""
    rows = rows.withColumn("_bucket", bucket)
    whole = rows.groupBy("_bucket").agg(F.sum(count).alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(whole, "_bucket").withColumn(name, (F.col("_base") + F.coalesce(F.sum(count).over(inside), F.lit(0))).cast("long")).drop("_bucket", "_base")


def allocate(requests: DataFrame, high_water: DataFrame | None = None) -> DataFrame:
    """requests: (business, day, seq, count). Adds start_index: ranges of one (business,
    day) follow each other in seq order from its high-water mark (business, day, next)
    or 0. A count under 1 is 1, a null day today; no business is an error."""
    clean = requests.select(
        F.coalesce("business", F.raise_error(F.lit("business is required"))).alias("business"),
        F.coalesce("day", F.date_format(F.current_date(), "yyyyMMdd")).alias("day"), "seq",
        F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).cast("long").alias("count"),
    )
    w = Window.partitionBy("business", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = clean.withColumn("start_index", F.coalesce(F.sum("count").over(w), F.lit(0)).cast("long"))
    if high_water is not None:
        out = out.join(high_water, ["business", "day"], "left").withColumn("start_index", F.col("start_index") + F.coalesce("next", F.lit(0))).drop("next")
    return out


def new_high_water(allocated: DataFrame) -> DataFrame:
    return allocated.groupBy("business", "day").agg(F.max(F.col("start_index") + F.col("count")).alias("next"))
