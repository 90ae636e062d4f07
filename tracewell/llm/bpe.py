"""Byte-level BPE over a whole corpus: every distinct word is encoded once for
each bucket of words, not once for each document.

Tasks cut texts into pre-tokens, once, and keep, for some megabytes of documents (a
batch), the distinct words and the word number at every position, both packed. One
shuffle deals out both: words to the bucket of their hash, positions by their batch.
(1) A bucket encodes each of its words once and answers every batch with its words'
ids. (2) Answers meet their batch's positions, read from the same shuffle; ids
are put together by position. Decoding looks every id up in the table of token
bytes. A word in every document reaches its bucket once for each batch.

A batch is named by a hash of its texts, so a task that runs again on the same rows names it alike;
documents that come out of a shuffle, in no fixed order, are stored first.

Defined cases: null or empty text: no tokens. Null doc_id: kept, stays null.
Repeated rows: each is encoded. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, common
from .hashing import chunks, utf8
from .tokenizers import rank_encoder, ranks

BATCH_BYTES = 5_000_000
#: Text for which one bucket of words is laid out.
BUCKET_BYTES = 16_000_000


@lru_cache(maxsize=2)
def _pattern(text: str):
    return regex.compile(text)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


def _batches(batches):
    """(name, ids, texts, words by frequency, word number at every position, positions per text)."""
    for chunk in chunks(batches, 1, BATCH_BYTES):
        ids, some = chunk.columns
        data, offsets = utf8(some)
        name = -1 - (int.from_bytes(hashlib.blake2b(data.tobytes() + offsets.tobytes() + ids.to_numpy().tobytes(), digest_size=8).digest(), "little") >> 1)
        found: dict[str, int] = {}
        split = _pattern(public_tokenizers.PATTERN).findall
        numbers, sizes = [], []
        for text in some:
            at = [found.setdefault(w, len(found)) for w in split(text.as_py())]
            sizes.append(len(at))
            numbers.append(np.array(at, np.uint32))
        at = np.concatenate(numbers)
        order = np.argsort(-np.bincount(at, minlength=len(found)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(found)
        yield name, ids.to_pylist(), [words[i] for i in order.tolist()], rank[at], np.array(sizes, np.int64)


_SENT = pa.schema([("home", pa.int64()), ("docs", pa.list_(pa.int64())), ("n_words", pa.int64()), ("name", pa.int64()), *[(x, pa.binary()) for x in "abc"]])


def _scan(buckets: int):
    """Rows of words (home: their bucket; name: their batch; numbers, sizes, words) and of positions (home, below 0: the batch; docs; positions, sizes)."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for name, ids, words, at, sizes in _batches(batches):
            rows = [(name, ids, len(words), name, blobs.pack(at), blobs.pack(sizes), None)]
            raw = [w.encode() for w in words]
            home = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
            order = np.argsort(home, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
                some = [raw[i] for i in mine.tolist()]
                rows.append((int(home[mine[0]]), None, None, name, blobs.pack_rising(mine), blobs.pack(np.array([len(w) for w in some])), squeeze.compress(b"".join(some))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _SENT)], schema=_SENT)

    return run


def _encode(path: str):
    def run(table: pa.Table) -> pa.Table:
        encode, known, rows = rank_encoder(path)._encode_single_piece, {}, []
        opened = zstandard.ZstdDecompressor()
        if table.column("home")[0].as_py() < 0:  # positions
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=["name", "numbers", "counts", "ids"])
        for name, numbers, sizes, words in zip(*(table.column(x).to_pylist() for x in ("name", *"abc"))):
            to = np.cumsum(blobs.unpack(sizes).astype(np.int64))
            raw = opened.decompress(words, max_output_size=int(to[-1]) + 1)
            ids, counts, a = [], [], 0
            for b in to.tolist():
                w = raw[a:b]
                a = b
                x = known.get(w)
                if x is None:
                    x = known[w] = encode(w)
                ids += x
                counts.append(len(x))
            rows.append((name, numbers, blobs.pack(np.array(counts)), blobs.pack(np.array(ids))))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["name", "numbers", "counts", "ids"])

    return run


_DIGEST = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _assemble(path: str, outputs: bool):
    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        if batch.num_rows and batch.column("home")[0].as_py() >= 0:  # words
            return pa.Table.from_arrays([pa.array([], t.type) for t in _DIGEST], schema=_DIGEST)
        if not batch.num_rows:
            raise RuntimeError("the documents changed under a task that ran again; store them first")
        table = token_bytes(path)
        n = batch.column("n_words")[0].as_py()
        ids: list = [None] * n
        for numbers, counts, flat in zip(*(answers.column(x).to_pylist() for x in ("numbers", "counts", "ids"))):
            flat, a = blobs.unpack(flat).tolist(), 0
            for i, c in zip(blobs.unpack_rising(numbers).tolist(), blobs.unpack(counts).tolist()):
                ids[i] = flat[a : a + c]
                a += c
        if None in ids:
            raise RuntimeError("the documents changed under a task that ran again; store them first")
        text = [",".join(map(str, x)) for x in ids]
        back = [b"".join([table[i] for i in x]) for x in ids]
        count = np.array([len(x) for x in ids], np.int64)
        rows = []
        for docs, positions, sizes in zip(*(batch.column(x).to_pylist() for x in ("docs", "a", "b"))):
            at, to = blobs.unpack(positions).astype(np.int64), np.cumsum(blobs.unpack(sizes).astype(np.int64))
            a = 0
            for doc, b in zip(docs, to.tolist()):
                mine = at[a:b].tolist()
                decoded = b"".join([back[i] for i in mine])
                rows.append((
                    doc, int(count[at[a:b]].sum()), hashlib.sha256(",".join([text[i] for i in mine]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(),
                    np.array([x for i in mine for x in ids[i]], "<u4").tobytes() if outputs else None, decoded if outputs else None,
                ))
                a = b
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _DIGEST)], schema=_DIGEST)

    return run


def encode_decode(docs: DataFrame, path: str | None = None, outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian unsigned
    32-bit) and decoded (bytes; both null unless outputs) of every document."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = common.steady(common.keyed(docs))
    buckets = int(max(4, -(-common.total_bytes(docs) // BUCKET_BYTES)))
    sent = docs.mapInArrow(_scan(buckets), "home long, docs array<long>, n_words long, name long, a binary, b binary, c binary").repartition("home")
    answers = sent.groupBy("home").applyInArrow(_encode(path), "name long, numbers binary, counts binary, ids binary")
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary"
    out = sent.groupBy("home").cogroup(answers.groupBy("name")).applyInArrow(_assemble(path, outputs), schema)
    return out.select(common.public_id(), "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
