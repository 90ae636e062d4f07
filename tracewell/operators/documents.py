"""From source messages and files to numbered lines and documents."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import file_time
from tracewell.operators.ids import starts
from tracewell.session import bounded_batches, small
from tracewell.sources.files import gunzip

SHORTEST_PATH = 20
#: Rows of two numbers that are sent to all tasks; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def parse_messages(messages: DataFrame, idc: str) -> DataFrame:
    """messages: (message). (category, id, content, path) of every record: lines of one
    column, the path, or three, id, host and path; others and short paths are dropped."""
    record = F.split(F.col("record"), "\t")
    path = F.trim(F.when(F.size(record) == 1, F.get(record, F.lit(0))).otherwise(F.get(record, F.lit(2))))
    host = F.when(F.size(record) == 3, F.trim(F.get(record, F.lit(1)))).otherwise("")
    key = F.when(F.size(record) == 3, F.trim(F.get(record, F.lit(0)))).otherwise("")
    rows = messages.select(F.explode(F.split("message", "\n")).alias("record"))
    rows = rows.where(F.size(record).isin(1, 3)).select(F.lit(idc).alias("content"), key.alias("key"), host.alias("host"), path.alias("path"))
    return rows.where(F.length("path") >= SHORTEST_PATH).select(F.when(F.col("key") == "", F.concat("host", F.lit(":"), "path")).otherwise(F.col("key")).alias("id"), "content", "path")


def gather(files: DataFrame, minutes: int) -> DataFrame:
    """files: (path, size, idc). One row for each window of file time and idc.

    Empty files and those without a time in their name are left out."""
    if not 1 <= minutes <= 59 or 60 % minutes:
        raise ValueError("minutes divides 60")
    timed = files.where("size > 0").withColumn("at", file_time(F.col("path"))).where("at is not null")
    return timed.groupBy(F.window("at", f"{minutes} minutes").start.alias("window"), "idc").agg(
        F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.sort_array(F.collect_list("path")).alias("paths")
    )


def flush_by_size(files: DataFrame, minutes: int, limit: int) -> DataFrame:
    """Adds flush, the number of the output that a file goes to within its (window,
    idc): files add up in path order; the file that reaches limit closes the output."""
    timed = files.where("size > 0").withColumn("at", file_time(F.col("path"))).where("at is not null")
    timed = timed.withColumn("window", F.window("at", f"{minutes} minutes").start).select("window", "idc", "path", "size")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["path", "size"], kind="stable")
        flush, total, out = 0, 0, []
        for size in rows["size"]:
            out.append(flush)
            total += size
            if total >= limit:
                flush, total = flush + 1, 0
        return rows.assign(flush=out)

    return timed.groupBy("window", "idc").applyInPandas(split, "window timestamp, idc string, path string, size long, flush long")


def due(windows: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Windows whose time to flush has come, oldest first."""
    return windows.where(now >= F.col("window") + F.expr(f"interval {minutes} minutes")).orderBy("window", "idc")


def _lines(text: str) -> Column:
    """A final line end begins no line."""
    whole = F.col(text)
    return F.split(F.when(F.endswith(whole, F.lit("\n")), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole), "\n")


def lines_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line): the lines of whole texts, numbered from 0."""
    return files.select(key, F.posexplode(_lines(text)).alias("n", "line"))


def line_counts(files: DataFrame, *keys: str) -> DataFrame:
    """(keys without the last, n_lines) of whole texts, the last key; nulls have no lines. No line is made a row."""
    *keys, text = keys
    return files.where(F.col(text).isNotNull()).select(*keys, F.size(_lines(text)).cast("long").alias("n_lines"))


def numbered_lines(files: DataFrame, begun: DataFrame, key: str, text: str, lines_per_doc: int) -> DataFrame:
    """files: (key, text), begun: (key, begin). (key, n, line, doc_id, row_index) of the files that have
    a begin. It meets whole files, not lines, and is sent to them where files are few."""
    placed = files.select(key, text).join(small(begun.select(key, "begin"), MOST_BROADCAST), key)
    return placed.select(key, "begin", F.posexplode(_lines(text)).alias("n", "line")).select(
        key, "n", "line", (F.col("begin") + F.floor(F.col("n") / lines_per_doc)).cast("long").alias("doc_id"), (F.col("n") % lines_per_doc).cast("int").alias("row_index")
    )


def pack_groups(files: DataFrame, groups: list[str], path: str, text: str, lines_per_doc: int, bucket: Column, first: int = 0) -> DataFrame:
    """files: (groups, path, text). (groups, doc_id, row_index, line): all lines of a group, file after file in the
    order of their paths, cut into documents across files; a group's last document may be short. Groups follow each
    other in (bucket, groups) order. Only counts are windowed and shuffled."""
    counts = line_counts(files, *groups, path, text)
    before = Window.partitionBy(*groups).orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).cast("long"))
    whole = counts.groupBy(*groups).agg(F.sum("n_lines").alias("n_lines")).withColumn("_group", F.struct(*groups))
    begun = starts(whole.withColumn("n_docs", F.ceil(F.col("n_lines") / lines_per_doc).cast("long")), "_group", "n_docs", bucket, "begin")
    placed = counts.join(begun.select(*groups, "begin"), groups).select(*groups, path, "before", "begin")
    rows = files.select(*groups, path, text).join(small(placed, MOST_BROADCAST), [*groups, path])
    rows = rows.select(*groups, "begin", "before", F.posexplode(_lines(text)).alias("_n", "line")).withColumn("n", F.col("before") + F.col("_n"))
    return rows.select(
        *groups, (F.col("begin") + first + F.floor(F.col("n") / lines_per_doc)).cast("long").alias("doc_id"), (F.col("n") % lines_per_doc).cast("int").alias("row_index"), "line"
    )


def plain_concat(files: DataFrame, group: str, path: str, text: str, folder: str) -> None:
    """Without documents: the lines of each group's files, file after file, as text under folder/group=.../.
    Range partitions keep the order over the names of a large group's files."""
    rows = files.select(group, F.col(path).alias("_path"), F.posexplode(_lines(text)).alias("_n", "value"))
    rows = rows.repartitionByRange(group, "_path", "_n").sortWithinPartitions(group, "_path", "_n")
    rows.select(group, "value").write.partitionBy(group).option("lineSep", "\n").text(folder)


def rezip(files: DataFrame, zip: bool, unzip: bool) -> DataFrame:
    """files: (path, content). Packed, or unpacked, by the end of their names; both or neither changes nothing."""
    if zip == unzip:
        return files
    bounded_batches(files.sparkSession)
    packed = F.col("path").endswith(".gz")
    if zip:
        return files.select(F.when(packed, F.col("path")).otherwise(F.concat("path", F.lit(".gz"))).alias("path"), F.when(packed, F.col("content")).otherwise(gzip_bytes("content")).alias("content"))
    return files.select(F.regexp_replace("path", r"\.gz\z", "").alias("path"), F.when(packed, gunzip(F.col("content"))).otherwise(F.col("content")).alias("content"))


def doc_meta_rows(members: DataFrame) -> DataFrame:
    """members: (path, doc_id, offset, length). (value): "doc_id\\tplace" lines, the place as base64 of JSON."""
    place = F.to_json(F.struct("path", F.col("offset").cast("long"), F.col("length").cast("int")))
    return members.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.base64(place.cast("binary"))).alias("value"))


def number_documents(counts: DataFrame, key: str, lines_per_doc: int, bucket: Column, first: int = 0) -> DataFrame:
    """counts: (key, n_lines). Adds n_docs and begin, the file's first doc_id."""
    docs = counts.withColumn("n_docs", F.ceil(F.col("n_lines") / lines_per_doc).cast("long"))
    return starts(docs, key, "n_docs", bucket, "begin").withColumn("begin", F.col("begin") + first)


def number_lines(lines: DataFrame, files: DataFrame, key: str, lines_per_doc: int) -> DataFrame:
    """lines: (key, n, line, ...), files: (key, begin). Adds doc_id and row_index;
    lines of files without begin are left out."""
    return (
        lines.join(files.select(key, "begin"), key)
        .withColumn("doc_id", (F.col("begin") + F.floor(F.col("n") / lines_per_doc)).cast("long"))
        .withColumn("row_index", (F.col("n") % lines_per_doc).cast("int"))
        .drop("begin")
    )


def first_doc_ids(doc_meta: DataFrame, key: str) -> DataFrame:
    """doc_meta: (key, line_no, doc_id). The doc_id of each file's first row."""
    return doc_meta.groupBy(key).agg(F.min_by("doc_id", "line_no").alias("begin"))


def documents(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_id, n_rows, text): lines of each document in order, each with its line end."""
    rows = lines.groupBy(*keys, "doc_id").agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list(F.struct("row_index", "line"))).alias("rows"))
    return rows.select(*keys, "doc_id", "n_rows", F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


@F.pandas_udf(T.BinaryType())
def gzip_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda x: gzip.compress(bytes(x), mtime=0), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def gzip_member(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode(), mtime=0), na_action="ignore")


def gz_documents(docs: DataFrame, key: str) -> DataFrame:
    """docs: (key, doc_id, text). One gzip member a document, and where it lies in its file."""
    members = docs.withColumn("member", gzip_member("text")).withColumn("length", F.length("member").cast("long"))
    before = Window.partitionBy(key).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("text")
