"""Session, storage and column helpers shared by the corpus operators.

Conventions used by every operator here:

* only the columns an operator needs are read, under private names, so extra
  columns of the input, whatever they are called, can't clash;
* a null text is an empty text;
* a null doc_id is an id of its own, ordered before all others, and comes back
  as null.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import scratch

#: Stands for a null id inside the operators.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of rows: where the session has Spark's default of
    10,000, a tenth of it, since texts may be long. Operators put batches together again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def keyed(docs: DataFrame) -> DataFrame:
    """(id, text) of documents: no nulls, no other columns."""
    _small_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def has_repeats(docs: DataFrame) -> bool:
    """Whether some doc_id, null included, stands in several rows. Only ids are read."""
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def copy_number(docs: DataFrame) -> Column:
    """A column that tells rows of one doc_id apart: 0 where every id is its own,
    else a hash of the text, which needs no shuffle of texts."""
    if has_repeats(docs):
        return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit(2**63 - 1))
    return F.lit(0).cast("long")


def keys(docs: DataFrame) -> list[Column]:
    """id and copy, which name a row together (equal rows alike)."""
    _small_batches(docs.sparkSession)
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), copy_number(docs).alias("copy")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, id, copy): all columns in one, out of the way of any name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys(docs))


def numbered(docs: DataFrame) -> DataFrame:
    """(id, copy, text) of documents."""
    return docs.select(*keys(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def public_id(column: str = "id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs in here deletes its shuffle files as it ends; else they stay until the driver's memory is collected,
    whatever their size. The session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the
    lineage in a way that outlives any executor, and frees what was shuffled for it."""
    spark = df.sparkSession
    path = scratch(spark, what)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing that is still to run reads it.
    Other DataFrames are passed over."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def steady(docs: DataFrame) -> DataFrame:
    """docs, stored first if they come out of a shuffle: rows of one have no fixed order, those of a stored
    table have, so a task that runs again after a loss meets the same rows in the same batches."""
    dealt = "Exchange" in docs._jdf.queryExecution().executedPlan().toString()
    return materialise(docs, "steady") if dealt else docs


def join_apart(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, an aggregate by keys, such that adaptive execution can
    split a hot key: by a key of its own, right is dealt out anew, and both sides are
    plain shuffles. (Else left would share the aggregate's shuffle, which can't be split.)"""
    return left.withColumn("_apart", F.struct(*keys)).join(right.withColumn("_apart", F.struct(*keys)).drop(*keys), "_apart", how).drop("_apart")


#: Rows that one task sends a chunk in at most, so that each row is worth its while.
FANOUT = 8192


#: Numbers that are held to be cut anew.
HELD = 4_000_000


def in_two_steps(sent: DataFrame, buckets: int, again) -> DataFrame:
    """sent: (bucket, ...), packed rows of coarse buckets where buckets are more than FANOUT. Then they are dealt out by
    these first, again(batches) puts rows of a coarse bucket together and cuts them by the fine ones."""
    if buckets <= FANOUT:
        return sent
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(again, sent.schema)


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; docs as keyed() gives them. A JVM-side scan of one column."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
