"""Where new file names come from, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CheckpointError(ValueError):
    """The checkpoint is later than every file."""


def new_files(names: list[str], last: str | None, hold_newest: bool = False) -> list[str]:
    """Names after the last one handled, in order. A checkpoint that is itself gone
    gives all files again; one after every file is an error."""
    names = sorted(names)
    if hold_newest:
        names = names[:-1]
    if not names or last is None:
        return names
    if last > names[-1]:
        raise CheckpointError(last)
    return [n for n in names if n > last] if last in names else names


def new_files_table(files: DataFrame, last: str | None, hold_newest: bool = False) -> DataFrame:
    """new_files() over a table (dir, name), for each directory; its error comes when rows are read."""
    if hold_newest:
        newest = files.groupBy("dir").agg(F.max("name").alias("_newest"))
        files = files.join(newest, "dir").where("name < _newest").drop("_newest")
    if last is None:
        return files
    known = files.groupBy("dir").agg(F.max(F.col("name") == last).alias("_known"), F.max("name").alias("_newest"))
    late = F.when(F.col("_newest") < last, F.raise_error(F.concat(F.lit(f"the checkpoint {last} is later than every file of "), "dir")).cast("boolean"))
    return files.join(known, "dir").where(F.coalesce(late, ~F.col("_known") | (F.col("name") > last))).drop("_known", "_newest")


def queue(items: Iterator[str]) -> Callable[[], list[str]]:
    """A source of one item a call, none at the end."""

    def take() -> list[str]:
        found = next(items, None)
        return [] if found is None else [found]

    return take


def directory_stream(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """(value, path): lines of new files of a directory, each once (needs a checkpoint)."""
    reader = spark.readStream.option("lineSep", "\n")
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """(value) of a topic; needs Spark's Kafka package on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return rows.select(F.col("value").cast("string").alias("value"))


SOURCES: dict[str, Callable] = {"dm": directory_stream, "queue": queue, "topic": topic_stream}


def source(name: str) -> Callable:
    if name not in SOURCES:
        raise KeyError(f"no source named {name}; known: {sorted(SOURCES)}")
    return SOURCES[name]
