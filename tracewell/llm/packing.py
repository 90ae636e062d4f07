"""Best-fit packing of documents into sequences of a fixed length.

Tasks tokenize documents and cut those longer than a sequence; the pieces, a few
numbers each, are dealt out by a hash, and every task packs its share: online
best fit over a bounded number of open sequences. A bitset has bit f set while
some open sequence has f places free, so the fullest one that a piece fits in is
the lowest set bit from the piece's length on. When too many are open, the
fullest closes. Pieces come in chunks, longest first within each.

Shares never meet, so a share costs a few open sequences at its end; adaptive
execution makes shares as large as its advisory partition size.

Defined cases: null or empty text: the end token alone, one piece of length 1.
Null doc_id: packed like any other, doc_id stays null. Repeated rows: each is
packed. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenizers import encode_like_json

CAPACITY = 2048
OPEN = 16384
CHUNK = 16384
END = 0


class Packer:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = OPEN, first: int = 0):
        self.capacity, self.most_open, self.next = capacity, most_open, first
        self.free_bits, self.open, self.at = 0, 0, [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.at[free]
        sequence = bins.pop()
        if not bins:
            self.free_bits ^= 1 << free
        self.open -= 1
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open >= self.most_open:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            if not self.at[left]:
                self.free_bits |= 1 << left
            self.at[left].append(sequence)
            self.open += 1
        return sequence, self.capacity - free


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones behind a first that may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(json_path: str, rank_path: str, special, capacity: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode_like_json(text.as_py(), json_path, rank_path, special)
                ids.append(END)
                raw = np.array(ids, dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = raw[start : start + length].tobytes()
                    for column, x in zip(rows, (doc, piece, start, length, zlib.crc32(part), part if with_ids else None)):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def _place(capacity: int, most_open: int, chunk: int):
    def run(batches):
        packer = Packer(capacity, most_open, TaskContext.get().partitionId() << 36)

        def packed(table: pa.Table) -> pa.RecordBatch:
            lengths = table.column("length").to_numpy()
            found = np.empty((len(lengths), 2), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                found[i] = packer.put(int(lengths[i]))
            for name, x in zip(("sequence_id", "offset"), found.T):
                table = table.append_column(name, pa.array(np.ascontiguousarray(x)))
            return table.combine_chunks().to_batches()

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held))

    return run


def pack(
    docs: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, chunk: int = CHUNK, with_ids: bool = True,
    json_path: str | None = None, rank_path: str | None = None, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit,
    null unless with_ids), sequence_id, offset: one row for each piece."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = common.keyed(docs).mapInArrow(_pieces(json_path, rank_path, special, capacity, with_ids), schema)
    shuffled = pieces.withColumn("turn", F.xxhash64("id", "piece", "ids_crc32")).repartition("turn").sortWithinPartitions("turn", "id", "piece", "start", "ids_crc32").drop("turn")
    placed = shuffled.mapInArrow(_place(capacity, most_open, chunk), schema + ", sequence_id long, offset long")
    return placed.select(common.public_id(), "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
