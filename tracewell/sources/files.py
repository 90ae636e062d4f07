"""Lines and byte ranges of stored files."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file whose ranges one task reads.
STRIPE = 256 * 1024 * 1024


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line) of plain and gzip files, of one path, a list, or comma-separated
    globs. Only a line feed ends a line. Files that are gone or broken are passed over."""
    if isinstance(paths, str):
        paths = [p for p in paths.split(",") if p]
    options = {"lineSep": "\n", "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    return spark.read.options(**options).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files that need their line order, gzip by name."""
    rows = spark.read.format("binaryFile").load(paths).where("length > 0")
    plain = F.when(F.col("path").endswith(".gz"), gunzip(F.col("content"))).otherwise(F.col("content"))
    return rows.select("path", F.make_valid_utf8(plain.cast("string")).alias("text"))


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a stored text index; rows whose token is empty or over 256 long are dropped."""
    at = F.instr("value", "\t") - 1
    return spark.read.option("lineSep", "\n").text(path).where(at.between(1, 256))


@F.pandas_udf(T.BinaryType())
def gunzip(data: pd.Series) -> pd.Series:
    """Every gzip member up to the first that is broken; null if the first is."""

    def one(raw):
        out, raw = [], bytes(raw)
        while raw:
            d = zlib.decompressobj(31)
            try:
                part = d.decompress(raw)
            except zlib.error:
                break
            out.append(part)
            raw = d.unused_data
        return b"".join(out) if out else None

    return data.map(one, na_action="ignore")


def _ranges(batches):
    """Rows (path, offset, length), sorted by path: each file is opened once, and only the ranges are read."""
    held, handle, size = None, None, 0
    for batch in batches:
        content, errors = [], []
        for path, offset, length in zip(*(batch.column(x).to_pylist() for x in ("path", "offset", "length"))):
            if path != held:
                if handle:
                    handle.close()
                held, handle = path, None
                try:
                    store, at = fs.FileSystem.from_uri(path)
                    handle = store.open_input_file(at)
                    size = handle.size()
                except (FileNotFoundError, IsADirectoryError):
                    pass
                except OSError as e:
                    if store.get_file_info(at).type == fs.FileType.File:
                        raise OSError(f"{path}: {e}") from e
            fits = handle is not None and offset is not None and length is not None and offset >= 0 and length >= 0 and offset + length <= size
            content.append(handle.read_at(length, offset) if fits else None)
            errors.append(None if fits else "no such file" if handle is None else "range beyond the end")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, "content", "error"])
    if handle:
        handle.close()


def read_ranges(ranges: DataFrame, unpack: bool = False) -> DataFrame:
    """ranges: (path, offset, length), paths with their scheme. Adds content and error; a range of no
    file, or beyond its file's end, has an error and no content. Ranges near each other are read by one
    task (STRIPE bytes of a file at most, so a large file is read by many); nothing else of a file is read."""
    rows = ranges.select("path", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    rows = rows.repartition("path", F.expr(f"offset div {STRIPE}")).sortWithinPartitions("path", "offset")
    rows = rows.mapInArrow(_ranges, "path string, offset long, length long, content binary, error string")
    return rows.withColumn("content", gunzip("content")) if unpack else rows


def _members(folder: str):
    def run(batches):
        held, stream, at = None, None, 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            offsets = []
            names, members = batch.column("file").to_pylist(), batch.column("member").to_pylist()
            for name, member in zip(names, members):
                if name != held:
                    if stream:
                        stream.close()
                    held, stream, at = name, store.open_output_stream(f"{root}/{name}"), 0
                stream.write(member or b"")
                offsets.append(at)
                at += len(member or b"")
            paths = [f"{folder}/{name}" for name in names]
            lengths = [len(m or b"") for m in members]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column("doc_id"), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["path", "doc_id", "offset", "length"])
        if stream:
            stream.close()

    return run


def write_members(members: DataFrame, folder: str) -> DataFrame:
    """members: (file, doc_id, member). Writes each file's members one after the other, in doc_id
    order; (path, doc_id, offset, length). Stores once: the result is read back, not written again. A
    task that runs again writes the same files."""
    rows = members.select(F.col("file").cast("string").alias("file"), F.col("doc_id").cast("long").alias("doc_id"), "member").repartition("file").sortWithinPartitions("file", "doc_id")
    index = f"{folder}/_index"
    rows.mapInArrow(_members(folder), "path string, doc_id long, offset long, length long").write.parquet(index)
    return members.sparkSession.read.parquet(index)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
