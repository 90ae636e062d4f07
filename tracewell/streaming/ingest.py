"""Continuous ingestion: windows of files, flushed by watermark, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.text import file_time


def windowed_files(files: DataFrame, minutes: int, late: int) -> DataFrame:
    """files: a stream (path, size, idc). Files and bytes of each window and idc; a
    window is out ``late`` minutes of file time after it began (the window's length at least),
    later files are left out. flush_windows() keeps them."""
    if late < minutes:
        raise ValueError("late is the window's length at least")
    timed = files.where("size > 0").withColumn("at", file_time(F.col("path"))).where("at is not null")
    grouped = timed.withWatermark("at", f"{late - minutes} minutes").groupBy(F.window("at", f"{minutes} minutes").alias("w"), "idc")
    return grouped.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("window"), "idc", "files", "bytes")


def flush_windows(files: DataFrame, folder: str, checkpoint: str, minutes: int, late: int, drain: bool = True) -> StreamingQuery:
    """files: a stream (path, size, idc). Writes (window, idc, files, bytes, paths) to folder/out, once for
    each window and idc that is ``late`` minutes old by the latest file time seen. A file that comes
    for a window that is out already is a group of its own in a further output: nothing is dropped.

    What waits is stored by batch beside the latest time, so a batch that runs again replaces itself."""
    if late < minutes:
        raise ValueError("late is the window's length at least")
    timed = files.where("size > 0").withColumn("at", file_time(F.col("path"))).where("at is not null")
    timed = timed.withColumn("window", F.window("at", f"{minutes} minutes").start).select("window", "idc", "path", "size", "at")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = lambda n: f"{folder}/waiting/batch={n}"
        before = spark.read.schema(batch.schema).parquet(waiting(number - 1)) if number else batch.limit(0)
        batch = batch.persist()  # read once; what is lost is read again
        rows = before.unionByName(batch)
        clock = rows.agg(F.max("at")).first()[0]  # the file that set it waits as long as any
        due = F.lit(clock) >= F.col("window") + F.expr(f"interval {late} minutes")
        out = rows.where(due).groupBy("window", "idc").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.sort_array(F.collect_list("path")).alias("paths"))
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/out")
        rows.where(~due | due.isNull()).write.mode("overwrite").parquet(waiting(number))
        batch.unpersist()

    writer = timed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="30 seconds")).start()


def counters(query: StreamingQuery) -> list[tuple[int, int, float, float]]:
    """(batch, rows read, rows a second read, rows a second done) of the recent batches of a stream."""
    return [(p.batchId, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond) for p in query.recentProgress]


def once(files: DataFrame, late: int) -> DataFrame:
    """Each path once within the watermark."""
    return files.withColumn("at", file_time(F.col("path"))).withWatermark("at", f"{late} minutes").dropDuplicatesWithinWatermark(["path"])


def append_batches(stream: DataFrame, path: str, checkpoint: str, prepare=lambda batch: batch, drain: bool = True) -> StreamingQuery:
    """Appends every batch, late rows too. A batch that is run again replaces what it
    wrote: rows carry their batch, and writing is by batch partition."""

    def put(batch: DataFrame, number: int) -> None:
        out = prepare(batch).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="30 seconds")).start()


def stream_index(lines: DataFrame, path: str, checkpoint: str, config, drain: bool = True) -> StreamingQuery:
    """Indexes a stream of numbered lines (day, doc_id, row_index, line) as it comes."""
    from tracewell.operators.index import tokens

    return append_batches(lines, path, checkpoint, lambda batch: tokens(batch, config), drain)
