"""Substring dedup: words of windows that were seen before go.

Every run of ``width`` consecutive words of a document is a window, named by
its 64-bit Rabin-Karp hash. A word goes if a window that covers it has the same
words as one that starts earlier (smaller doc_id, or same document and earlier
start). Windows are judged on the input.

Plan: (1) tasks hash all windows of a few thousand documents at a time and keep
the earliest of each hash; every later one is known to go. The earliest ones
travel, sorted and packed, to the bucket of their hash. (2) A bucket counts each
hash over all tasks and names the windows that are not the first of theirs.
(3) Those positions meet their document again; overlapping windows merge into
maximal intervals, which are cut out. A window in a third of all documents
reaches its bucket once per group of documents, not once per document.

Two different windows are taken for equal with a chance of n**2 / 2**65 over n
windows (0.0005 for 0.14 billion).

Defined cases: null or blank text, or fewer words than width: nothing goes. Null
doc_id: before all others. Several rows with one doc_id: one after the other, in
the order of their texts' hashes; equal rows are alike, so the first keeps its
words. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs, common
from .hashing import chunks, tidied, tidy, windows, word_hashes

WIDTH = 20
#: Windows that one task holds at once, and that one bucket is laid out for.
CHUNK_BYTES = 6_000_000
BUCKET_WINDOWS = 1_000_000
#: Text of the documents that meet their intervals at once.
GROUP_BYTES = 8_000_000
_BYTES_A_WORD = 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _order_key(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _by_group(groups: int, bucket, key, copy, start) -> list[tuple]:
    """Windows that go -> one packed row for each group of documents that has any."""
    group = np.mod(_ids(key) ^ copy.astype(np.int64), groups)
    order = np.lexsort((start, copy, key, group))
    group, key, copy, start = group[order], key[order], copy[order], start[order]
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    rows = []
    for a, b in zip(cut, np.r_[cut[1:], len(group)] if len(group) else []):
        edge = np.flatnonzero(np.r_[True, (key[a + 1 : b] != key[a : b - 1]) | (copy[a + 1 : b] != copy[a : b - 1])]) + a
        rows.append((bucket(len(rows)), int(group[a]), blobs.pack(key[edge]), blobs.pack(copy[edge]), blobs.pack(np.diff(np.r_[edge, b])), blobs.pack(start[a:b])))
    return rows


def _ids(key: np.ndarray) -> np.ndarray:
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _hash_windows(width: int, buckets: int, groups: int):
    """(id, copy, text) batches -> rows for each bucket: its share of the
    earliest windows of this chunk (low set), and documents' windows that go
    whatever other chunks hold (group set; any bucket passes them on)."""

    def run(batches):
        for chunk in chunks(batches, 2, CHUNK_BYTES):
            ids, copies, texts = chunk.columns
            key = _order_key(ids.to_numpy())
            copy = copies.to_numpy().astype(np.uint64)
            words, counts = word_hashes(texts)
            hashes, at, per = windows(words, counts, width)
            if not len(hashes):
                continue
            rank = np.empty(len(key), np.int64)
            rank[np.lexsort((copy, key))] = np.arange(len(key))
            owner = np.repeat(np.arange(len(key)), per)
            start = (at - np.repeat(np.cumsum(counts) - counts, per)).astype(np.uint64)
            order = np.arange(len(hashes))
            if (np.diff(rank) < 0).any():
                order = np.lexsort((start, rank[owner]))
            order = order[np.argsort(hashes[order], kind="stable")]
            h, o, s = hashes[order], owner[order], start[order]
            same = np.zeros(len(h), dtype=bool)
            same[1:] = h[1:] == h[:-1]
            # of equal rows, which share id and copy, all hold the first window
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            gone = np.flatnonzero(same & ((key[o] != key[o[lead]]) | (copy[o] != copy[o[lead]]) | (s != s[lead])))
            rows = _by_group(groups, lambda n: n % buckets, key[o[gone]], copy[o[gone]], s[gone])
            rows = [(x[0], x[1], None, *x[2:]) for x in rows]
            h, o, s = h[~same], o[~same], s[~same]
            rows += _by_bucket(buckets, h, key[o], copy[o], s)
            yield _batch(rows, _SENT)

    return run


def _by_bucket(buckets: int, h, key, copy, start) -> list[tuple]:
    """Windows in the order of their hashes -> a row for each bucket that has any."""
    if not len(h):
        return []
    bucket, low = _buckets(h, buckets), key.min()
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    parts = (slice(a, b) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)]))
    return [(int(bucket[x.start]), None, int(_ids(low[None])[0]), blobs.pack_rising(h[x]), blobs.pack(key[x] - low), blobs.pack(copy[x]), blobs.pack(start[x])) for x in parts]


def _again(buckets: int):
    """Rows of coarse buckets, sorted by them -> the same by fine bucket, of some rows at a time; what goes to groups passes."""

    def cut(held):
        h, key, copy, start = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        return _batch(_by_bucket(buckets, h[order], key[order], copy[order], start[order]), _SENT)

    def run(batches):
        held, size, at = [], 0, None
        for batch in batches:
            passed = batch.filter(pa.compute.is_valid(batch.column("group")))
            if passed.num_rows:
                yield passed.cast(_SENT)
            for k, low, a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("bucket", "low", *"abcd"))):
                if low is None:
                    continue
                if held and (k != at or size > common.HELD):
                    yield cut(held)
                    held, size = [], 0
                at = k
                held.append((blobs.unpack_rising(a), blobs.unpack(b) + _order_key(np.array([low])), blobs.unpack(c), blobs.unpack(d)))
                size += len(held[-1][0])
        if held:
            yield cut(held)

    return run


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


_SENT = pa.schema([("bucket", pa.int32()), ("group", pa.int64()), ("low", pa.int64()), *[(x, pa.binary()) for x in "abcd"]])
_FOUND = pa.schema([("group", pa.int64()), *[(x, pa.binary()) for x in "abcd"]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema)], schema=schema)


def _later_ones(groups: int):
    """A bucket: of the windows of each hash, all but the earliest."""

    def run(table: pa.Table) -> pa.Table:
        sent = pa.compute.is_valid(table.column("low"))
        passed = table.filter(pa.compute.invert(sent)).select(_FOUND.names).cast(_FOUND)
        hs, ks, cs, ss = [], [], [], []
        for low, a, b, c, d in zip(*(table.filter(sent).column(x).to_pylist() for x in ("low", *"abcd"))):
            hs.append(blobs.unpack_rising(a))
            ks.append(blobs.unpack(b) + _order_key(np.array([low])))
            cs.append(blobs.unpack(c))
            ss.append(blobs.unpack(d).astype(np.uint32))
        if not hs:
            return passed
        h = np.concatenate(hs)
        del hs
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = np.zeros(len(h) + 1, dtype=bool)
        same[1:-1] = h[1:] == h[:-1]
        many = same[1:] | same[:-1]
        h, order = h[many], order[many]
        key, copy, start = (np.concatenate(x)[order] for x in (ks, cs, ss))
        order = np.lexsort((start, copy, key, h))
        h, key, copy, start = h[order], key[order], copy[order], start[order]
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[1:] == h[:-1]
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        gone = np.flatnonzero(same & ((key != key[lead]) | (copy != copy[lead]) | (start != start[lead])))
        rows = [x[1:] for x in _by_group(groups, lambda n: 0, key[gone], copy[gone], start[gone])]
        del h, order, same, many, lead, ks, cs, ss, key, copy, start
        tidy()
        return pa.concat_tables([passed, pa.Table.from_batches([_batch(rows, _FOUND)])])

    return run


def _meet_again(docs: DataFrame, width: int, finish, schema: str | T.StructType) -> DataFrame:
    """docs: id, copy, text and what else finish needs. Every group of documents
    meets the starts of its windows that go: finish(table, intervals by row)."""
    docs = common.steady(docs)
    size = common.total_bytes(docs)
    buckets = int(max(4, -(-size // (_BYTES_A_WORD * BUCKET_WINDOWS))))
    groups = int(size // GROUP_BYTES) | 1
    coarse = min(buckets, common.FANOUT)
    sent = docs.select("id", "copy", "text").mapInArrow(tidied(_hash_windows(width, coarse, groups)), "bucket int, group long, low long, a binary, b binary, c binary, d binary")
    sent = common.in_two_steps(sent, buckets, tidied(_again(buckets)))
    found = sent.groupBy("bucket").applyInArrow(_later_ones(groups), "group long, a binary, b binary, c binary, d binary")

    def cut(table: pa.Table, gone: pa.Table) -> pa.Table:
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        for a, b, c, d in zip(*(gone.column(x).to_pylist() for x in "abcd")):
            sizes = blobs.unpack(c).astype(np.int64)
            for i, k, s in zip(_ids(blobs.unpack(a)).tolist(), blobs.unpack(b).tolist(), np.split(blobs.unpack(d).astype(np.int64), np.cumsum(sizes)[:-1])):
                starts.setdefault((i, k), []).append(s)
        rows = zip(table.column("id").to_pylist(), table.column("copy").to_pylist())
        return finish(table, [intervals(starts.get(x, []), width) for x in rows])

    placed = docs.withColumn("group", F.pmod(F.col("id").bitwiseXOR(F.col("copy")), F.lit(groups)))
    return placed.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(cut, schema)


def intervals(starts: list[np.ndarray], width: int) -> list[tuple[int, int]]:
    """Windows that go -> maximal ranges of words, ends exclusive."""
    if not starts:
        return []
    at = np.unique(np.concatenate(starts))
    cut = np.flatnonzero(np.diff(at) > width)
    return [(int(a), int(b) + width) for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]])]


_DIGEST = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _summary(table: pa.Table, gone: list[list[tuple[int, int]]]) -> pa.Table:
    rows = []
    for d, text, cuts in zip(table.column("id").to_pylist(), table.column("text"), gone):
        words = text.as_py().encode().split()  # at the same six bytes
        n = len(words)
        for a, b in reversed(cuts):
            del words[a:b]
        rows.append((d, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
    return pa.Table.from_batches([_batch(rows, _DIGEST)])


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = _meet_again(common.numbered(docs), width, _summary, "id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(common.public_id(), "n_words", "n_removed", "kept_sha256")


def cut_text(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words that go and without the white space behind them."""
    if not gone:
        return text
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    keep, begin = [], 0
    for a, b in gone:
        keep.append(text[begin : at[a]])
        begin = at[b]
    return "".join(keep) + text[begin:]


def _rewritten(table: pa.Table, gone: list[list[tuple[int, int]]]) -> pa.Table:
    row = table.column("row").combine_chunks()
    old = row.field("text").to_pylist()
    texts = [t if t is None else cut_text(t, x) for t, x in zip(old, gone)]
    fresh = {"text": texts, "n_chars": [n if not x else len(t) for n, t, x in zip(row.field("n_chars").to_pylist(), texts, gone)]} if "n_chars" in row.type.names else {"text": texts}
    parts = [pa.array(fresh[f.name], f.type) if f.name in fresh else row.field(f.name) for f in row.type]
    return pa.table({"row": pa.StructArray.from_arrays(parts, fields=list(row.type))})


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, all columns, with text cut and n_chars, where there is one, counted anew."""
    whole = common.whole_rows(docs)
    rows = whole.select("row", "id", "copy", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    out = _meet_again(rows, width, _rewritten, T.StructType([whole.schema["row"]]))
    return out.select("row.*")
