"""Hashes of words and of runs of words, over whole Arrow columns at a time.

A text is taken as UTF-8 bytes; words are maximal runs of bytes other than
space and 0x09-0x0D. All sums are modulo 2**64. Prefix sums of byte * B**-i give
the polynomial hash of any span (Rabin-Karp), so neither words nor windows are
ever made as Python objects.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at once; bounds the temporary arrays.
BLOCK = 1 << 20

_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Block ends: ends of texts where they fit, else white space inside a long text."""
    ends, at, n = [], 0, len(data)
    while at < n:
        to = offsets[np.searchsorted(offsets, at + BLOCK, "right") - 1]
        if to <= at:
            end = offsets[np.searchsorted(offsets, at, "right")]
            to = end
            if end - at > 2 * BLOCK:
                look = at + BLOCK
                while look < end:
                    gap = np.flatnonzero(~_SOLID[data[look : min(look + 65536, end)]])
                    if len(gap):
                        to = look + gap[0]
                        break
                    look += 65536
        ends.append(to)
        at = to
    return np.array(ends, np.int64)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text in order, words per text)."""
    data, offsets = utf8(texts)
    values = _LOWER if lower else _SAME
    out, starts_all, at = [], [], 0
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    for to in _cuts(data, offsets):
        part = data[at:to]
        solid = _SOLID[part]
        edge = np.empty(len(part) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        np.logical_not(solid[:-1], out=edge[1:-1])
        edge[:-1] |= first[at:to]
        starts = np.flatnonzero(solid & edge[:-1])
        after = np.empty(len(part), dtype=bool)
        np.logical_not(solid[1:], out=after[:-1])
        after[-1] = True
        after[:-1] |= first[at + 1 : to]
        ends = np.flatnonzero(solid & after)
        up, down = _powers(len(part))
        sums = np.cumsum(values[part] * down[: len(part)])
        before = np.zeros(len(starts), np.uint64)
        inner = starts > 0
        before[inner] = sums[starts[inner] - 1]
        out.append(mix((sums[ends] - before) * up[starts] ^ (ends - starts + 1).astype(np.uint64)))
        starts_all.append(starts + at)
        at = to
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(out), np.diff(np.searchsorted(starts, offsets))


def windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every run of width words inside one text.

    Returns (hashes, index in words at which each begins, runs per text)."""
    per = np.maximum(counts - width + 1, 0)
    total = int(per.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), per
    begin = np.cumsum(counts) - counts
    skip = begin - (np.cumsum(per) - per)
    at = np.arange(total) + np.repeat(skip, per)
    out = np.empty(total, np.uint64)
    up, down = _powers(BLOCK + width)
    for lo in range(0, len(words), BLOCK):
        a, b = np.searchsorted(at, [lo, lo + BLOCK])
        if a == b:
            continue
        part = words[lo : lo + BLOCK + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * down[: len(part)], out=sums[1:])
        i = at[a:b] - lo
        out[a:b] = mix((sums[i + width] - sums[i]) * up[i])
    return out, at, per


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """windows() with the whole of a text that has fewer words, but some, as its one run.

    Returns (hashes grouped by text, runs per text)."""
    runs, _, per = windows(words, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return runs, per
    begin = np.cumsum(counts) - counts
    whole = np.empty(len(short), np.uint64)
    for j, d in enumerate(short):
        x = np.zeros(1, np.uint64)
        for w in words[begin[d] : begin[d] + counts[d]]:
            x = x * np.uint64(_BASE) + w
        whole[j] = mix(x ^ np.uint64(counts[d]))[0]
    at = (np.cumsum(per) - per)[short]
    per = per.copy()
    per[short] = 1
    return np.insert(runs, at, whole), per


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending, and how many they are."""
    if not len(hashes):
        return hashes, counts.copy()
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.bincount(o[keep], minlength=len(counts))


def slices(texts: pa.Array, most_bytes: int):
    """Ranges of rows with about most_bytes of text each, one row at least."""
    _, offsets = utf8(texts)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        yield a, min(b, n)
        a = b


def chunks(batches, column: int, most_bytes: int):
    """Batches cut and put together again so that each has about most_bytes of text
    in a column, the last maybe less."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for a, b in slices(batch.column(column), most_bytes):
            part = batch.slice(a, b - a)
            more = part.column(column).nbytes
            if held and size + more > most_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):
    _LIBC.mallopt(-3, 1 << 20)  # arrays of a megabyte or more are mapped, and unmapped when freed


def tidy() -> None:
    """Gives freed memory back to the system: Python workers live on, idle, between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidied(run):
    """A function over batches that tidies up behind its last one."""

    def over(batches):
        yield from run(batches)
        tidy()

    return over
