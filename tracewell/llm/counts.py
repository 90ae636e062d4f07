"""Token counts of a piece vocabulary, without making the tokens.

Texts are cut where no piece can span: in front of a run of spaces, and around
line ends. Each distinct part of a batch is counted once. Parts are cut further,
between two characters that stand side by side in no piece: no merge can join
them. All sequences are held as one ragged array of symbols, and every round applies
the best-ranked pair of each (the leftmost of equals) to all of them at once, until
no pair is left; what survives is counted. A character that is no piece counts its bytes.

One pair a sequence and round is what the library does: with several at once, a new
pair of better rank could come too late. Sequences of over LONG symbols, for which
that takes too many rounds (long runs of one character, thousands of letters without
a space), go through a heap one at a time, with the same result.

Defined cases: null or empty text: 0. Null doc_id: kept, stays null. Repeated
rows: each is counted. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from . import common
from .hashing import slices

LONG = 400
#: Text of which the parts are held at once, and parts remembered by a process.
BATCH_BYTES = 4_000_000
MEMORY = 400_000
SPACE = "▁"
_NONE = np.int64(2**31 - 1)


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for text in ("a", " a", "a  b ", "Äﬁ x\tI\n", "<s>"):
            if library.decode(library.encode(text)) not in (text, text[1:] if text[0] == " " else text):
                raise ValueError(f"{path}: texts are normalised; only spaces may be")
        if library.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError(f"{path}: no space is put in front")
        n = library.get_piece_size()
        plain = [i for i in range(n) if not (library.is_unknown(i) or library.is_control(i) or library.is_byte(i) or library.is_unused(i))]
        pieces = {library.id_to_piece(i): i for i in plain}
        self.symbols = dict(pieces)
        for p in pieces:
            for c in p:
                self.symbols.setdefault(c, len(self.symbols) + n)
        self.base = n + len(self.symbols) + 1
        self.pieces = pieces
        score = {i: library.get_score(i) for i in plain}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (i, rank[score[i]])
        self.pairs = pairs
        self.beside = np.array(sorted({self.symbols[a] * self.base + self.symbols[b] for p in pieces for a, b in zip(p, p[1:])}), np.int64)
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        inner = any(b == SPACE and a != SPACE for p in pieces for a, b in zip(p, p[1:]))
        if inner:
            raise ValueError(f"{path}: a piece has a space inside")
        ends = "\n" if not any("\n" in p and len(p) > 1 for p in pieces) else ""
        self.part = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + (f"|{ends}+" if ends else ""))
        self.known: dict[str, int] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _touching(self, sym: np.ndarray) -> np.ndarray:
        """Whether some piece has symbols i and i + 1, characters, side by side."""
        key = sym[:-1] * self.base + sym[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        return self.beside[at] == key

    def _symbols(self, part: str) -> tuple[list[int], int]:
        """A part's symbols, and how many tokens more than symbols it has (bytes of unknown characters)."""
        out, more = [], 0
        for c in part:
            s = self.symbols.get(c)
            if s is None:
                s = self.base - 1
            if c not in self.pieces:
                more += len(c.encode()) - 1
            out.append(s)
        return out, more

    def count(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part."""
        total, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        flat: list[int] = []
        for i, p in enumerate(parts):
            s, total[i] = self._symbols(p)
            flat += s
            sizes[i] = len(s)
        sym = np.array(flat, np.int64)
        del flat
        opens = np.ones(len(sym), dtype=bool)
        opens[1:] = ~self._touching(sym)
        opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        start = np.flatnonzero(opens)
        size, which = np.diff(start, append=len(sym)), np.repeat(np.arange(len(parts)), sizes)[start]
        far = size > LONG
        for a, n, i in zip(start[far].tolist(), size[far].tolist(), which[far].tolist()):
            total[i] += self._count_long(sym[a : a + n].tolist())
        sym, size, which = sym[np.repeat(~far, size)], size[~far], which[~far]
        start = np.cumsum(size) - size
        pair = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            pair[:-1] = self._lookup(sym[:-1], sym[1:])
            pair[start + size - 1] = -1
        while len(which):
            rank = np.where(pair >= 0, self.ranks[pair], _NONE)
            best = np.minimum.reduceat((rank << np.int64(32)) | np.arange(len(sym)), start)
            live = (best >> np.int64(32)) < _NONE
            np.add.at(total, which[~live], size[~live])
            at = best[live] & np.int64(0xFFFFFFFF)
            if not len(at):
                break
            sym[at] = self.merged[pair[at]]
            keep = np.repeat(live, size)
            keep[at + 1] = False
            last = np.zeros(len(sym), dtype=bool)
            last[start + size - 1] = True
            ends = last[at + 1]
            fresh = np.cumsum(keep)[at] - 1
            sym = sym[keep]
            pair = pair[keep]
            which, size = which[live], size[live] - 1
            start = np.cumsum(size) - size
            pair[fresh] = -1
            inside = fresh[~ends]
            pair[inside] = self._lookup(sym[inside], sym[inside + 1])
            behind = fresh[fresh > start] - 1
            pair[behind] = self._lookup(sym[behind], sym[behind + 1])
        return total

    def _count_long(self, s: list[int]) -> int:
        n, alive = len(s), len(s)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                found = self.pairs.get(s[i] * self.base + s[j])
                if found:
                    heapq.heappush(heap, (found[1], i, s[i], s[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i] = self.pairs[a * self.base + b][0]
            gone[j] = 1
            alive -= 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return alive

    def texts(self, texts: list[str]) -> list[int]:
        parts = [self.part.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        new = list({p for x in parts for p in x}.difference(known))
        for a in range(0, len(new), 100_000):
            some = new[a : a + 100_000]
            known.update(zip(some, self.count(some).tolist()))
        return [sum(map(known.__getitem__, x)) for x in parts]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _count(path: str):
    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            for a, b in slices(texts, BATCH_BYTES):
                some = texts.slice(a, b - a)
                n = counter(path).texts(some.to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.compute.binary_length(some).cast(pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    return common.keyed(docs).mapInArrow(_count(path), "id long, n_bytes long, n_tokens long").select(common.public_id(), "n_bytes", "n_tokens")
