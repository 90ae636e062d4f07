"""Tables of the driver as lines, files and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import IndexConfig, Step
from tracewell.operators import documents, index
from tracewell.session import scratch

LINES_PER_DOC = 16
WORDS = (Step("split", "[^0-9A-Za-z]+"), Step("keyword"))
DOCUMENTS = IndexConfig("docs", "TAB", ("text",), {"text": WORDS}, lines_per_doc=LINES_PER_DOC)
EVENT_FIELDS = ("event_id", "user_id", "event_type", "value", "props")
EVENTS = IndexConfig("events", "TAB", EVENT_FIELDS, {"event_type": (Step("keyword"),), "user_id": (Step("keyword"),)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, n, line): a document's text is a file."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return documents.lines_of(docs, "file_id", "text")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    counts = documents.line_counts(docs, "file_id", "text")
    return documents.number_documents(counts, "file_id", LINES_PER_DOC, F.expr("file_id div 4096"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, n, line, doc_id, row_index)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return documents.numbered_lines(docs, document_files(spark, sf_dir), "file_id", "text", LINES_PER_DOC)


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, row_index, field, token) of all documents."""
    return index.tokens(numbered_lines(spark, sf_dir).select("doc_id", "row_index", "line"), DOCUMENTS)


_stored: dict[tuple[str, str], str] = {}


def _stored_index(spark: SparkSession, sf_dir: str) -> str:
    """Where the index and lines of all documents are stored; made once for an application and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        folder = scratch(spark, "index")
        index.write(document_postings(spark, sf_dir), f"{folder}/postings")
        lines = numbered_lines(spark, sf_dir).select("doc_id", "row_index", "line")
        lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "row_index").write.parquet(f"{folder}/lines")
        _stored[key] = folder
    return _stored[key]


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("doc_id long, row_index int, field string, token string").parquet(f"{_stored_index(spark, sf_dir)}/postings")


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_stored_index(spark, sf_dir)}/lines")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, doc_id, row_index, line): tab-separated events, 128 to a document."""
    events = table(spark, sf_dir, "events")
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("event_id", "user_id", "event_type")], F.lit("-"), "props")
    return events.select(F.to_date("ts").alias("day"), F.expr("event_id div 128").alias("doc_id"), (F.col("event_id") % 128).cast("int").alias("row_index"), line.alias("line"))


def event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(event_lines(spark, sf_dir), EVENTS)


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, path, size, idc): a file named after each event."""
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("/data/logs/"), "event_type", F.lit("/info."), F.date_format("ts", "yyyy-MM-dd-HH-mm"), F.lit("."), F.col("event_id").cast("string"), F.lit(".gz"))
    return events.select("event_id", name.alias("path"), (F.col("event_id") % 5000).alias("size"), F.concat(F.lit("idc"), (F.col("user_id") % 3).cast("string")).alias("idc"))
