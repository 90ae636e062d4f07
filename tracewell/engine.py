"""One business's lines, documents, index and metadata under one root folder.

What is ingested, built or merged has a batch name. A batch is a partition of each
table, so one that runs again replaces itself and nothing else; its document ids
are allocated once, from a stored high-water mark. A batch ingested again is indexed
again by the next build. One writer a business and day at a time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import IndexConfig
from tracewell.operators import documents, index, kv, search
from tracewell.operators.search import SearchRequest
from tracewell.session import small

BATCH = ("business", "day", "batch")
_STORED = {
    "ids": "business string, day date, batch string, start long, count long",
    "kv": "meta_type string, business string, key string, value string, seq long",
    "token_stats": "business string, day date, batch string, field string, token string, pv long",
    "postings": "business string, day date, batch string, field string, token string, doc_id long, row_index int",
    "docs": "business string, day date, batch string, file_id long, n_lines long, n_docs long, begin long",
    "lines": "business string, day date, batch string, file_id long, doc_id long, row_index int, line string",
}


class Engine:
    def __init__(self, spark: SparkSession, config: IndexConfig, root: str):
        self.spark, self.config, self.root = spark, config, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str) -> DataFrame:
        try:
            found = self.spark.read.schema(_STORED[name]).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], _STORED[name])
        return found.where(F.col("business") == self.config.business)

    def _put(self, rows: DataFrame, name: str, by: tuple[str, ...] = BATCH) -> None:
        """Stores rows, in the place of what their partitions held."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self._path(name))

    def _marked(self, rows: DataFrame, day: str, batch: str) -> DataFrame:
        return rows.select(F.lit(self.config.business).alias("business"), F.lit(day).cast("date").alias("day"), F.lit(batch).alias("batch"), "*")

    def allocate(self, day: str, batch: str, count: int) -> int:
        """The first of count consecutive ids of the day; the same again for the same batch."""
        taken = self._table("ids").where(F.col("day") == day)
        mine = taken.where(F.col("batch") == batch).first()
        if mine:
            if mine["count"] != count:
                raise ValueError(f"batch {batch} had {mine['count']} documents, now {count}")
            return mine["start"]
        start = taken.agg(F.max(F.col("start") + F.col("count"))).first()[0] or 0
        self._put(self._marked(self.spark.createDataFrame([(start, count)], "start long, count long"), day, batch), "ids")
        return start

    def ingest(self, files: DataFrame, day: str, batch: str | None = None) -> int:
        """files: (file_id long, text). Numbers their lines and stores them; the next free doc_id."""
        batch = batch or uuid.uuid4().hex
        counts = documents.line_counts(files, "file_id", "text")
        total = counts.agg(F.sum(F.expr(f"ceil(n_lines / {self.config.lines_per_doc})"))).first()[0] or 0
        start = self.allocate(day, batch, int(total))
        begun = documents.number_documents(counts, "file_id", self.config.lines_per_doc, F.expr("file_id div 4096"), start)
        self._put(self._marked(begun, day, batch), "docs")
        begun = self._table("docs").where((F.col("day") == day) & (F.col("batch") == batch))
        self._drop("token_stats", batch, day)  # an index of what the batch held before is built again
        lines = documents.numbered_lines(files, begun.select("file_id", "begin"), "file_id", "text", self.config.lines_per_doc)
        self._put(self._marked(lines.select("file_id", "doc_id", "row_index", "line"), day, batch), "lines")
        return start + int(total)

    def _count(self, fresh: DataFrame) -> None:
        """Tokens of more than posting_cap postings in a batch keep that many. Counts, of all
        postings, are stored last: a batch that has counts is whole."""
        counts, counted = self._set_aside(index.token_stats(fresh, *BATCH, "field", "token"))
        hot = counts.where(F.col("pv") > self.config.posting_cap).select(*BATCH, "field").distinct()
        if not hot.isEmpty():
            of_hot = fresh.join(small(hot, search.MOST_BROADCAST), [*BATCH, "field"], "left_semi")
            some, capped = self._set_aside(index.cap(of_hot, self.config.posting_cap, *BATCH, "field", "token"))
            index.write(some, self._path("postings"), mode="overwrite")
            self._delete(capped)
        self._put(counts, "token_stats")
        self._delete(counted)

    def _set_aside(self, rows: DataFrame) -> tuple[DataFrame, str]:
        path = self._path(f"_aside/{uuid.uuid4().hex}")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def _delete(self, *paths: str) -> None:
        """Deletes what patterns find."""
        context = self.spark.sparkContext
        for path in paths:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            store = at.getFileSystem(context._jsc.hadoopConfiguration())
            for found in store.globStatus(at) or ():
                store.delete(found.getPath(), True)

    def _drop(self, name: str, batch: str, day: str = "*") -> None:
        """Takes a batch out of a table, fields included that it has no more."""
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        self._delete(f"{self._path(name)}/business={escaped(self.config.business)}/day={day}/batch={escaped(batch)}")

    def _unindex(self, batch: str, day: str = "*") -> None:
        for name in ("token_stats", "postings"):  # counts go first, so what is left in between is no whole batch
            self._drop(name, batch, day)

    def build_index(self, day: str, again: bool = False) -> None:
        """Indexes the day's batches that have no index yet, or all of them again; until
        it is done, their lines aren't found."""
        lines = self._table("lines").where(F.col("day") == day)
        if not again:
            built = self._table("token_stats").where(F.col("day") == day).select("batch").distinct()
            lines = lines.join(small(built, search.MOST_BROADCAST), "batch", "left_anti")
        batches = [r["batch"] for r in lines.select("batch").distinct().collect()]  # folders, which the driver lists anyway
        if not batches:
            return
        for batch in batches:
            self._unindex(batch, day)
        lines = self._table("lines").where((F.col("day") == day) & F.col("batch").isin(batches))
        index.write(index.tokens(lines.select(*BATCH, "doc_id", "row_index", "line"), self.config), self._path("postings"), mode="overwrite")
        self._count(self._table("postings").where((F.col("day") == day) & F.col("batch").isin(batches)))

    def merge_index(self, postings: DataFrame, name: str | None = None) -> None:
        """Adds postings (business, day, field, token, doc_id, row_index) of elsewhere; the same name replaces what it added before."""
        batch = "merged-" + (name or uuid.uuid4().hex)
        self._unindex(batch)
        index.write(postings.withColumn("batch", F.lit(batch)), self._path("postings"), mode="overwrite")
        self._count(self._table("postings").where(F.col("batch") == batch))

    def stats(self) -> DataFrame:
        return self._table("token_stats").groupBy("business", "day", "field", "token").agg(F.sum("pv").alias("pv"))

    def terms(self, request: SearchRequest) -> list[tuple[str, str]]:
        """The request's terms, as the lines of their fields are indexed; none if some value yields no term."""
        found: set[tuple[str, str]] = set()
        for name, value in request.keywords.items():
            for piece in filter(None, value.split("\t")):
                tokens = search.normalised(self.spark, self.config, self._input(name), piece)
                if not tokens:
                    return []
                found.update((name, t) for t in tokens)
        return sorted(found)

    def search(self, request: SearchRequest) -> tuple[DataFrame, DataFrame | None]:
        return search.search(self._table("postings"), self.stats(), self._table("lines"), request, self.terms(request))

    def _input(self, output: str) -> str:
        return next((f for f in self.config.tokenizers if self.config.output_field(f) == output), output)

    def responses(self, request: SearchRequest) -> DataFrame:
        return search.responses(*self.search(request), request)

    def shards(self, day: str) -> DataFrame:
        """The day's index as stored shards (field, file, shard, offset, length, blob), by the configured width and files."""
        return index.shard_blobs(self._table("postings").where(F.col("day") == day), self.config.shard_width, self.config.files_per_field)

    def put(self, meta_type: str, changes: DataFrame) -> None:
        """Appends (key, value, seq); reads take the last."""
        rows = changes.select(F.lit(meta_type).alias("meta_type"), F.lit(self.config.business).alias("business"), "key", "value", F.col("seq").cast("long").alias("seq"))
        rows.write.mode("append").partitionBy("meta_type", "business").parquet(self._path("kv"))

    def get(self, meta_type: str, keys: DataFrame) -> DataFrame:
        """Only rows of the keys are aggregated."""
        store = self._table("kv").where(F.col("meta_type") == meta_type)
        some = store.join(small(keys.select("key").distinct(), search.MOST_BROADCAST), "key", "left_semi")
        return kv.multi_get(kv.upsert(some, store.limit(0)), keys)


class Engines:
    """Engines by business; others are an error."""

    def __init__(self, *engines: Engine):
        self._known = {e.config.business: e for e in engines}

    def __getitem__(self, business: str) -> Engine:
        if business not in self._known:
            raise KeyError(f"no business named {business}; known: {sorted(self._known)}")
        return self._known[business]

    def search(self, request: SearchRequest) -> tuple[DataFrame, DataFrame | None]:
        return self[request.business].search(request)

    def responses(self, request: SearchRequest) -> DataFrame:
        return self[request.business].responses(request)
