"""Key-value metadata as a table (meta_type, business, key, value, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multi_get(store: DataFrame, keys: DataFrame) -> DataFrame:
    """keys: (key). key and its value in base64; empty where there is none."""
    return keys.join(store.select("key", "value"), "key", "left").select("key", F.base64(F.coalesce("value", F.lit("")).cast("binary")).alias("value"))


def get(store: DataFrame, key: str) -> DataFrame:
    return store.where(F.col("key") == key).select("value")


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The last value of each key by seq, of equals the greatest; one sum-like aggregate, no sort."""
    last = F.max_by(F.struct("value", "seq"), F.struct("seq", "value")).alias("x")
    return store.select("key", "value", "seq").unionByName(changes.select("key", "value", "seq")).groupBy("key").agg(last).select("key", "x.value", "x.seq")


def parse_set(body: DataFrame) -> DataFrame:
    """body: (line), key, tab or space, base64 value. Any malformed line is an error for all."""
    parts = F.split("line", "[\t ]", 2)
    value = F.try_to_binary(F.get(parts, F.lit(1)), F.lit("base64"))
    bad = (F.size(parts) < 2) | (F.get(parts, F.lit(0)) == "") | value.isNull()
    return body.where(F.col("line") != "").select(F.when(bad, F.raise_error(F.concat(F.lit("malformed row: "), "line"))).otherwise(F.get(parts, F.lit(0))).alias("key"), value.cast("string").alias("value"))


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key").distinct(), "key", "left_anti")


def from_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """rows: (value), "id\\tpayload" lines of a metadata file: (key, value); shorter rows are dropped."""
    parts = F.split("value", "\t")
    return rows.where(F.size(parts) >= 2).select(F.concat(F.lit(prefix), F.get(parts, F.lit(0))).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def from_shard_rows(rows: DataFrame, field: str, day: str) -> DataFrame:
    """rows: (value), "shard\\tfile\\toffset\\tlength": key and its place as JSON."""
    parts = F.split("value", "\t")
    n = lambda i: F.get(parts, F.lit(i))
    place = F.to_json(F.struct(n(1).alias("path"), n(2).cast("long").alias("offset"), n(3).cast("int").alias("length")))
    return rows.where(F.size(parts) >= 4).select(F.concat(F.lit(field + day), n(0)).alias("key"), place.alias("value"))


class Stores:
    """(meta_type, business) -> store; others are an error."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], DataFrame] = {}

    def register(self, meta_type: str, business: str, store: DataFrame) -> None:
        if meta_type not in ("doc", "index"):
            raise ValueError(f"no such kind of metadata: {meta_type}")
        self._known[meta_type, business] = store

    def __getitem__(self, at: tuple[str, str]) -> DataFrame:
        if at not in self._known:
            raise KeyError(f"no store for {at}")
        return self._known[at]
