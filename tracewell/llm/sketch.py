"""Bottom-k fingerprints of documents.

A fingerprint is the k least hashes of a text's distinct word shingles, upper 48
bits of each. The k least of two fingerprints' union are the union's fingerprint,
so fingerprints of parts merge; the share of those that both hold estimates
resemblance, and the k-th least hash the number of distinct shingles.

Each document is compared with its successor in descending doc_id. Documents are
dealt to ranges of ids, one a partition, the first of each range also to the range
before it, and stream through in order; texts are shuffled once. A range is of
RANGE_BYTES, or of more where that would make over MOST_RANGES of them; it streams
from a sort that can spill, so large ones take longer, not more memory.

Defined cases: null text: empty. A text of fewer words than a shingle: all its
words are one shingle; no words: the empty fingerprint "", which resembles only
itself (1.0) and has 0 shingles. Null doc_id: least of all. Repeated rows and ties
of doc_id: in the order of their texts. One document: its own successor. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import distinct, shingles, slices, word_hashes

WORDS = 5
K = 256
BITS = 48
RANGE_BYTES = 24_000_000
MOST_RANGES = 65_536
BATCH_BYTES = 4_000_000
_PAD = np.uint64(2**64 - 1)


def sketches(texts: pa.Array, k: int = K, n: int = WORDS) -> np.ndarray:
    """A row of k ascending hashes for each text, padded with the largest number."""
    h, counts = distinct(*shingles(*word_hashes(texts), n))
    h, counts = distinct(h >> np.uint64(64 - BITS), counts)
    out = np.full((len(counts), k), _PAD)
    begin = np.cumsum(counts) - counts
    rank = np.arange(len(h)) - np.repeat(begin, counts)
    few = rank < k
    out[np.repeat(np.arange(len(counts)), counts)[few], rank[few]] = h[few]
    return out


def encode(rows: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(rows.astype(">u8")).view(np.uint8).reshape(*rows.shape, 8)[:, :, 8 - BITS // 8 :]
    size = (rows != _PAD).sum(1)
    return [base64.b64encode(x[:n].tobytes()).decode() for x, n in zip(raw, size)]


def decode(fingerprints: list[str], k: int = K) -> np.ndarray:
    out = np.full((len(fingerprints), k), _PAD)
    width = BITS // 8
    for row, text in zip(out, fingerprints):
        raw = np.frombuffer(base64.b64decode(text or ""), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 8 - width :] = raw
        row[: len(raw)] = wide.reshape(-1).view(">u8")[:k]
    return out


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the unions, how many of each one's hashes both sides hold)."""
    k = a.shape[1]
    both = np.sort(np.concatenate([a, b], 1), 1)
    fresh = np.ones(both.shape, dtype=bool)
    fresh[:, 1:] = both[:, 1:] != both[:, :-1]
    fresh &= both != _PAD
    rank = np.cumsum(fresh, 1)
    shared = (~fresh & (both != _PAD) & (rank <= k)).sum(1)
    out = np.full(a.shape, _PAD)
    r, c = np.nonzero(fresh & (rank <= k))
    out[r, rank[r, c] - 1] = both[r, c]
    return out, shared


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    union, shared = merge(a, b)
    size = (union != _PAD).sum(1)
    return np.where(size > 0, shared / np.maximum(size, 1), 1.0)


def cardinality(rows: np.ndarray) -> np.ndarray:
    """Distinct shingles: counted where they are fewer than k, else estimated."""
    k, size = rows.shape[1], (rows != _PAD).sum(1)
    return np.where(size < k, size, (k - 1) / np.maximum(rows[:, -1] / 2.0**BITS, 2.0**-BITS))


def containment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of a's shingles that b has too."""
    union, _ = merge(a, b)
    of_a = cardinality(a)
    return np.where(of_a > 0, np.clip(resemblance(a, b) * cardinality(union) / np.maximum(of_a, 1), 0, 1), 1.0)


def _successors(k: int, n: int):
    """Rows (range, late, id, text) in order; late: only a successor for the range's last."""

    def run(batches):
        held = None  # the last row so far, without its successor
        for batch in batches:
            for a, b in slices(batch.column(3), BATCH_BYTES):
                part = batch.slice(a, b - a)
                rows = [(g, late, i, t, s) for (g, late, i, t), s in zip(zip(*(x.to_pylist() for x in part.columns)), sketches(part.column(3), k, n))]
                if held:
                    rows.insert(0, held)
                out = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
                held = rows[-1]
                if out:
                    yield _compared(out, k, n)

    return run


def _compared(pairs: list[tuple], k: int, n: int) -> pa.RecordBatch:
    mine, after = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs])
    texts = [x[3] for x, _ in pairs]
    edited = [t[: len(t) - len(t) // 2] + y[3][: len(t) // 2] for t, (_, y) in zip(texts, pairs)]
    theirs = np.concatenate([sketches(pa.array(edited[a:b], pa.string()), k, n) for a, b in slices(pa.array(edited, pa.large_string()), BATCH_BYTES)])
    columns = [
        pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(encode(mine)), pa.array(encode(theirs)),
        pa.array(resemblance(mine, theirs)), pa.array(resemblance(mine, after)), pa.array(cardinality(mine).astype(float)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"])


def with_successors(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike it is to that and to its successor's."""
    docs = common.keyed(docs)
    ranges = int(min(MOST_RANGES, 1 + common.total_bytes(docs) // RANGE_BYTES))
    # the largest id of each of so many ranges of rows; only ids are read and dealt out
    dealt = docs.select("id").repartitionByRange(ranges, F.desc("id")).groupBy(F.spark_partition_id().alias("range")).agg(F.max("id").alias("head"))
    heads = np.array(sorted({r["head"] for r in dealt.collect()}), np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """Range 0 holds the largest ids."""
        return pd.Series((len(heads) - 1 - np.searchsorted(heads, ids.to_numpy())).astype(np.int32))

    rows = docs.select(place("id").alias("range") if len(heads) > 1 else F.lit(0).alias("range"), F.lit(0).alias("late"), "id", "text")
    if len(heads):
        down = heads[::-1].tolist()
        to = docs.sparkSession.createDataFrame([(h, (r - 1) % len(down)) for r, h in enumerate(down)], "id long, range int")
        # a row for each range: of the rows of its head, the first
        first = docs.join(F.broadcast(to), "id").groupBy("range", "id").agg(F.min("text").alias("text"))
        rows = rows.unionByName(first.select("range", F.lit(1).alias("late"), "id", "text"))
    rows = rows.repartitionById(max(1, len(heads)), F.col("range")).sortWithinPartitions("range", "late", F.desc("id"), "text")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return rows.mapInArrow(_successors(k, n), schema).select(common.public_id(), *[x.split()[0] for x in schema.split(", ")[1:]])


def merged(df: DataFrame, by: Column | str, k: int = K, n: int = WORDS) -> DataFrame:
    """(part, fingerprint, n_shingles) of all texts of each part: tasks merge what
    they hold, then one row for each part and batch is merged again."""

    def local(batches):
        for batch in batches:
            parts, texts = batch.columns
            rows = np.concatenate([np.zeros((0, k), np.uint64), *[sketches(texts.slice(a, b - a), k, n) for a, b in slices(texts, BATCH_BYTES)]])
            yield _merge_rows(parts.to_pylist(), rows, k)

    def final(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_merge_rows(table.column("part").to_pylist(), decode(table.column("fingerprint").to_pylist(), k), k)])

    schema = "part string, fingerprint string, n_shingles double"
    texts = df.select((F.col(by) if isinstance(by, str) else by).cast("string").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    some = texts.mapInArrow(local, schema).withColumn("share", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))
    some = some.groupBy("part", "share").applyInArrow(lambda t: final(t), schema)
    return some.groupBy("part").applyInArrow(lambda t: final(t), schema)


def _merge_rows(parts: list, rows: np.ndarray, k: int) -> pa.RecordBatch:
    found: dict = {}
    for p, row in zip(parts, rows):
        found[p] = merge(found[p], row[None])[0] if p in found else row[None]
    out = np.concatenate(list(found.values())) if found else np.zeros((0, k), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(encode(out), pa.string()), pa.array(cardinality(out).astype(float))], names=["part", "fingerprint", "n_shingles"])
