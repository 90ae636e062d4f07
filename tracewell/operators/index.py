"""The inverted index as tables: postings(field, token, doc_id, row_index) and
token_stats(field, token, pv), both by day."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import IndexConfig, Step
from tracewell.functions.hashing import file_number, shard_id, token_hash
from tracewell.functions.tokenizers import Tokenizer, block_list, chain
from tracewell.operators.documents import gzip_member
from tracewell.operators.fields import values

KEYS = ("day", "field", "token")
#: Shares that a token's postings are cut in before they are ranked together.
SHARES = 16
#: Documents whose postings of one token are dealt together.
SPAN = 65536
#: Characters of a text index that are parsed at once.
PIECE = 4_000_000
NO_ROW = -(2**63)


def _chained(steps: tuple[Step, ...], extra: dict[str, Tokenizer], value: Column) -> Column:
    return chain(value, steps, extra)


def tokens(lines: DataFrame, config: IndexConfig, extra: dict[str, Tokenizer] | None = None) -> DataFrame:
    """lines: (..., line). One row for each distinct token of each configured field of
    a line; fields that share an alias keep a row each. line goes."""
    fields = []
    for name, steps in config.tokenizers.items():
        more = dict(extra or {})
        if name in config.token_filters:
            more["tokenfilter"] = block_list(config.token_filters[name])
        found = F.transform(values(F.col("line"), config, name), partial(_chained, steps, more))
        fields.append(F.struct(F.lit(config.output_field(name)).alias("field"), F.array_distinct(F.flatten(found)).alias("tokens")))
    keep = [c for c in lines.columns if c != "line"]
    if not fields:
        return lines.select(*keep, F.lit("").alias("field"), F.lit("").alias("token")).limit(0)
    per_field = lines.where(F.octet_length("line") < config.longest_line).select(*keep, F.explode(F.array(*fields)).alias("f"))
    return per_field.select(*keep, F.col("f.field").alias("field"), F.explode("f.tokens").alias("token"))


def drop_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Without tokens of a list of any size; listed: (token)."""
    return rows.join(listed.select("token").distinct(), "token", "left_anti")


def sample_listed(rows: DataFrame, listed: DataFrame, precision: int) -> DataFrame:
    """Of a listed token's postings every precision-th stays (the fifth, and so on);
    none where precision is 5 or less. Tokens that aren't listed stay."""
    if precision <= 5:
        return drop_listed(rows, listed)
    marked = rows.join(listed.select("token").distinct().withColumn("_listed", F.lit(True)), "token", "left")
    others = marked.where("_listed is null").drop("_listed")
    w = Window.partitionBy("field", "token").orderBy("doc_id", "row_index")
    some = marked.where("_listed").withColumn("_n", F.row_number().over(w)).where(F.col("_n") % precision == 5)
    return others.unionByName(some.drop("_listed", "_n"))


def token_stats(postings: DataFrame, *keys: str) -> DataFrame:
    """pv: hits of each token, by partial sums."""
    return postings.groupBy(*keys).agg(F.count("*").alias("pv"))


def cap(postings: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first ``most`` postings of each token. Hot tokens are cut in shares first,
    so no task ranks more than most rows a share."""
    keys = keys or KEYS
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    order = ("doc_id", "row_index")
    some = postings.withColumn("_share", share).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_share").orderBy(*order))).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_share", "_n")


def posting_lists(postings: DataFrame, *keys: str) -> DataFrame:
    """One row a token: pv and its postings in order. postings is capped where tokens are hot."""
    found = F.sort_array(F.collect_list(F.struct("doc_id", "row_index")))
    # the sort behind it compares the first bytes of its first key at once: tokens differ there, fields don't
    return postings.groupBy(*reversed(keys)).agg(F.count("*").alias("pv"), found.alias("postings")).select(*keys, "pv", "postings")


def delta_encode(postings: DataFrame, *keys: str) -> DataFrame:
    """doc_id becomes delta: the first as it is, then differences."""
    w = Window.partitionBy(*keys).orderBy("doc_id", "row_index")
    n = F.row_number().over(w)
    return postings.select(*keys, n.alias("position"), (F.col("doc_id") - F.lag("doc_id", 1, 0).over(w)).alias("delta"), "row_index")


def delta_decode(encoded: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return encoded.select(*keys, F.sum("delta").over(w).cast("long").alias("doc_id"), "row_index")


def to_text(postings: Column) -> Column:
    """d1,r1;d2,r2;... with differences for all but the first d."""
    delta = lambda p, i: p["doc_id"] - F.coalesce(F.get(postings, i - 1)["doc_id"], F.lit(0))
    return F.array_join(F.transform(postings, lambda p, i: F.concat_ws(",", delta(p, i).cast("string"), p["row_index"].cast("string"))), ";")


def text_row(token: Column, field: Column, postings: Column, pv: Column) -> Column:
    return F.concat_ws("\t", F.replace(token, F.lit("\t"), F.lit(" ")), field, to_text(postings), pv.cast("string"))


def _numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps "d,r;d,r" of texts: how many each has, all their d, all their r; a step without r has NO_ROW."""
    pairs = pc.split_pattern(texts, ";")
    parts = pc.split_pattern(pairs.flatten(), ",")
    sizes = pc.list_value_length(pairs).to_numpy()
    if pc.all(pc.equal(pc.list_value_length(parts), 2)).as_py():
        numbers = pc.cast(parts.flatten(), pa.int64()).to_numpy().reshape(-1, 2)
        return sizes, numbers[:, 0], numbers[:, 1]
    some = [x if len(x) > 1 else [*x, NO_ROW] for x in parts.to_pylist()]
    return sizes, *(np.array([int(x[i]) for x in some], np.int64) for i in (0, 1))


def _pieces(text: str):
    """The text in pieces of about PIECE, cut between steps."""
    at = 0
    while len(text) - at > PIECE and (cut := text.find(";", at + PIECE)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _postings(sizes: np.ndarray, deltas: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Lists of postings, in order, from each list's own differences."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first = ends - sizes
    docs = np.cumsum(deltas)
    docs -= np.repeat(docs[first] - deltas[first], sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    if ((of[1:] == of[:-1]) & ((docs[1:] < docs[:-1]) | (docs[1:] == docs[:-1]) & (rows[1:] < rows[:-1]))).any():
        order = np.lexsort((rows, docs, of))
        docs, rows = docs[order], rows[order]
    values = pa.StructArray.from_arrays([pa.array(docs), pc.cast(pa.array(rows, mask=rows == NO_ROW), pa.int32())], ["doc_id", "row_index"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _parse(batches):
    """Text of about PIECE at once; a longer row on its own, in pieces."""
    for batch in batches:
        texts = batch.column("steps")
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            some = batch.slice(at, upto - at)
            if upto - at > 1:
                found = _postings(*_numbers(some.column("steps")))
            else:
                parts = [_numbers(pa.array([x]))[1:] for x in _pieces(texts[at].as_py())]
                deltas, rows = (np.concatenate(x) for x in zip(*parts))
                found = _postings(np.array([len(deltas)]), deltas, rows)
            yield pa.RecordBatch.from_arrays([some.column("field"), some.column("token"), some.column("pv"), found], names=["field", "token", "pv", "postings"])
            at = upto


def parse_text_rows(rows: DataFrame) -> DataFrame:
    """rows: (value), read from the right, since a token may hold tabs. (field, token, pv,
    postings); rows of fewer than four columns are dropped. Time is in proportion to the text."""
    parts = F.split("value", "\t")
    from_end = lambda i: F.try_element_at(parts, F.lit(-i))
    columns = rows.where(F.size(parts) >= 4).select(
        from_end(3).alias("field"), F.array_join(F.slice(parts, 1, F.size(parts) - 3), "\t").alias("token"), from_end(1).cast("long").alias("pv"), from_end(2).alias("steps")
    )
    return columns.mapInArrow(_parse, "field string, token string, pv long, postings array<struct<doc_id:bigint,row_index:int>>")


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def merge_stats(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Counts add up."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("pv").cast("long").alias("pv"))


def write(postings: DataFrame, path: str, partitions: int | None = None, mode: str = "append") -> None:
    """Stores postings by business, day, batch and field, each file sorted by token, so that a
    term's lookup reads few row groups; tokens get Bloom filters. Postings are dealt by token and range of SPAN
    documents, and what is still too large for a task is cut, so a hot token's postings are several files; with
    partitions, files are ranges of (token, doc_id), which takes a pass more over postings for their bounds.
    Overwriting replaces partitions that rows are of."""
    by = [c for c in ("business", "day", "batch", "field") if c in postings.columns]
    order = [*by, "token", "doc_id", "row_index"]
    dealt = postings.repartitionByRange(partitions, *order) if partitions else postings.withColumn("_span", F.expr(f"doc_id div {SPAN}")).hint("rebalance", *by, "token", "_span").drop("_span")
    (
        dealt.sortWithinPartitions(*order)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).option("parquet.bloom.filter.enabled#token", "true").parquet(path)
    )


def shard_blobs(postings: DataFrame, width: int = 200, files: int = 1000) -> DataFrame:
    """(field, file, shard, offset, length, blob): each shard's tokens with their postings as text, gzipped.

    A token's list is one cell, which the posting cap bounds."""
    rows = posting_lists(postings, "field", "token").withColumn("shard", shard_id(token_hash(F.col("token")), width))
    text = rows.select("field", "shard", F.struct("token", text_row(F.col("token"), F.col("field"), F.col("postings"), F.col("pv")).alias("row")).alias("r"))
    whole = text.groupBy("field", "shard").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "\n").alias("text"))
    blobs = whole.select("field", file_number(F.col("shard"), files).alias("file"), "shard", gzip_member("text").alias("blob")).withColumn("length", F.octet_length("blob").cast("long"))
    return shard_offsets(blobs)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """shards: (field, file, shard, length). Adds offset, the lengths before it in its file."""
    w = Window.partitionBy("field", "file").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
