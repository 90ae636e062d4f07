"""Hashes, keys and scalar helpers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import hashing, text


def reference_murmur3(data: bytes, seed: int = 0) -> int:
    """The published algorithm."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    mixed = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    for i in range(0, len(data) // 4 * 4, 4):
        h = (turn(h ^ mixed(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    tail = data[len(data) // 4 * 4 :]
    if tail:
        h ^= mixed(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


WORDS = ["", "a", "ab", "abc", "abcd", "hello", "日本語", "é", "the quick brown fox", "x" * 101]


def test_murmur3(spark):
    got = {r.w: (r.h, r.t) for r in spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", hashing.murmur3(F.col("w")).alias("h"), hashing.token_hash(F.col("w")).alias("t")).collect()}
    assert got["hello"][0] == 613153351 and got["abcd"][0] == 1139631978
    for w in WORDS:
        h = reference_murmur3(w.encode())
        assert got[w] == (h, abs(h - 2**32 if h >= 2**31 else h))


def test_shard_and_file(spark):
    def string_hash(s):
        h = 1
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return (h & 0x7FFFFFFF) % 1000

    rows = spark.createDataFrame([(0,), (199,), (200,), (2**31 - 1,)], "h long").select(hashing.shard_id(F.col("h")).alias("s"))
    for r in rows.select("s", hashing.file_number(F.col("s")).alias("f")).collect():
        assert len(r.s) == 8 and r.f == string_hash(r.s)
    assert [r.s for r in rows.collect()] == ["00000000", "00000000", "00000001", "10737418"]


def test_names_and_times(spark):
    row = spark.createDataFrame([("/x/info.2016-01-08-13.gz", "/x/info.2016-01-08-13-07.gz", "/x/none")], "a string, b string, c string")
    got = row.select(*[text.file_time(F.col(c)).alias(c) for c in "abc"], text.date_path(text.file_time(F.col("b")), "Y/m/d/H/i:5").alias("p")).first()
    assert (got.a, got.b, got.c) == (datetime.datetime(2016, 1, 8, 13), datetime.datetime(2016, 1, 8, 13, 7), None)
    assert got.p == "2016/01/08/13/05"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(text.is_url(F.lit(u))) for u in ("ab://active/?sid=%s", "//active/?sid=%s", "https://active/?sid=%s")] == [True, False, True]
    assert one(text.pick_columns(F.lit("a|b|c"), r"\|", [2, 0, 5])) == "c|a|"
    assert one(text.pick_row(F.lit("a\nb"), F.lit(1))) == "b"
    assert one(text.pick_row(F.lit("a\nb"), F.lit(7))) == "a\nb"
    assert one(text.symbol_ratio(F.lit("a-b-"))) == 0.5
    assert one(text.symbol_ratio(F.lit(""))) is None
    assert one(text.trim_chars(F.lit("xxaxx"), "x")) == "a"


@pytest.mark.parametrize("names", [["b", "a", "c"]])
def test_new_files(names, spark):
    from tracewell.sources.registry import CheckpointError, new_files, new_files_table, queue, source

    assert new_files(names, None) == ["a", "b", "c"]
    assert new_files(names, None, hold_newest=True) == ["a", "b"]
    assert new_files(names, "a") == ["b", "c"]
    assert new_files(names, "aa") == ["a", "b", "c"]  # the checkpoint's file is gone
    assert new_files([], "a") == []
    with pytest.raises(CheckpointError):
        new_files(names, "d")
    found = new_files_table(spark.createDataFrame([("d", n) for n in names], "dir string, name string"), "a", True)
    assert [r.name for r in found.collect()] == ["b"]
    take = queue(iter(["x"]))
    assert (take(), take()) == (["x"], [])
    with pytest.raises(KeyError):
        source("nobody")
