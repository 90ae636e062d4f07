"""Toxicity of documents, seen through disguises.

A word may be disguised: look-alike characters (1d10t), letters spelled out
(i d i o t, i.d.i.o.t, st.upid), words taken apart (st upid), letters repeated
(idiooot, iddiioott). A token is decoded by Viterbi over its lattice: at each
place the letters that the character can stand for, or its own deletion, weighed
by a channel model and a character trigram model counted over all documents. It is
left as it is only where the lattice has no other reading: no letter twice in a
row, no look-alike or separator between its ends; numbers stay numbers. Over any
white space, quotes and brackets, neighbouring tokens are read together where the
likeliest reading of their ends drops the space. Trigrams see two letters back, so
the ends decide as the whole would; only between two letters outside a-z, which
the model doesn't tell apart, tokens of several letters stay apart.

Features of a logistic model are words and word beginnings. They are chosen by
how often labelled texts hold them, as written or in the plainer disguises: of
all, those whose share of toxic texts chance doesn't explain. Then every reading
of every text is searched for them: a text's skeleton (alike letters as one;
repeats, separators and spaces gone) holds the skeleton of each word that some
reading holds, so one Aho-Corasick pass over skeletons finds the places to decode.

The model learns from a bounded sample: MOST_LABELLED labelled documents, those
with the least hashes of their ids. Features are counted and chosen in Spark; of
the sample, only its MOST_FEATURES chosen ones reach the driver, which fits the
weights. Trigram counts and scores cover everything. No label, lang, source or id enters a score.

Defined cases: null or empty text, or no known word: the score of no features.
Null doc_id: scored, held_out null; never learned from. A doc_id labelled twice
is toxic if any of its labels says so; rows of labels without id or label are
left out. No labels, or one class only: every score is the smoothed share of
toxic labels. Repeated rows: each is scored. Empty table: no rows. Other columns
are not read. A feature has SHORTEST letters or more when repeats are gone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import slices, tidied, tidy, utf8

MOST_LABELLED = 30_000
MOST_FEATURES = 300
PREFIXES = (4, 5, 6)
SHORTEST = 3
#: The least share of toxic texts among those that hold a feature.
TELLING = 0.5
#: Added to the logarithm of the number of features, which the gain of a chosen one reaches.
DOUBT = 0.0
STEPS, PENALTY = 400, 1e-5
FOLDS = 5
MEMORY = 150_000
LONG = 24  # longer tokens seldom come again
BATCH_BYTES = 4_000_000
#: Text that is searched at once.
READ_BYTES = 500_000

# What a character can stand for in a disguised word.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
GAPS = " .-_*~'/,:;"
_EDGE = ".,;:!?\"'()[]{}<>#%&*$|_-/\\+=~`"
_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"(?<![^\s])[\w@$!|+](?:[ .\-_*~][\w@$!|+]){3,}(?![^\s.,;:?!])")
_SPELLED_TOKEN = re.compile(r"[\w@$!|+](?:[ .\-_*~/][\w@$!|+]){2,}")
_TWICE = re.compile(r"([^\W\d_])\1")
#: Disguises that plain texts seldom hold: look-alikes between letters, letters three times.
_PLAIN_SIGHT = re.compile(r"[^\W\d_][\d@$!|+(<€£¡]+[^\W\d_]|([^\W\d_])\1\1")
_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: Letters of the trigram model: 0 is a word's edge, 1-26 are a-z, 27 any other.
ALPHABET = 28
_CODE = np.zeros(256, dtype=np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _trigrams(batches):
    counts = np.zeros(ALPHABET**3, np.int64)
    for batch in batches:
        texts = batch.column(0)
        for a, b in slices(texts, BATCH_BYTES):
            data, offsets = utf8(texts.slice(a, b - a))
            codes = np.zeros(len(data) + len(offsets) + 2, np.int64)
            codes[np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 2] = _CODE[data]
            # the middle letter or the last is none: no word goes on there
            three = (codes[:-2] * ALPHABET + codes[1:-1]) * ALPHABET + codes[2:]
            counts += np.bincount(three[(codes[1:-1] > 0) | (codes[2:] > 0)], minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log p(c | a, b) over all texts; at most 28**3 numbers reach the driver."""
    rows = common.keyed(docs).select("text").mapInArrow(tidied(_trigrams), "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**3)
    for r in rows:
        counts[r["trigram"]] = r["n"]
    counts = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    two, one = counts.sum(0), counts.sum((0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5))


def decode(text: str, model: np.ndarray) -> str:
    """The likeliest plain reading of a lower-case text: letters, and spaces between words."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for c in text:
        if c.isalpha():
            choices = [(c, 0.0)] if c != before else [(c, -0.2), ("", -0.9)]
        elif c in LOOKS:
            choices = [(x, -0.5) for x in LOOKS[c]] + [(" ", -7.0)]
            if c == before:
                choices.append(("", -0.7))
        elif c in GAPS:
            choices = [("", -0.5), (" ", -1.5)]
        else:
            choices = [(" ", 0.0), ("", -3.0)]
        before = c
        fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for x, cost in choices:
                if not x:
                    state, total, way = (a, b), score + cost, path
                else:
                    k = _code(x)
                    if k == 0 and b == 0:
                        state, total, way = (a, b), score + cost, path
                    else:
                        state, total, way = (b, k), score + cost + model[a, b, k], (x, path)
                if state not in fresh or fresh[state][0] < total:
                    fresh[state] = (total, way)
        best = fresh
    _, path = max(((s + (model[a, b, 0] if b else 0.0), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


def _core(token: str) -> str:
    return token.rstrip(_EDGE).lstrip(".,;:?\"'()[]{}#%&*_-/\\=~`")


def disguised(token: str) -> bool:
    """Whether the lattice of a lower-case token has other readings than the token."""
    core = token if token.isalpha() else _core(token)
    if _TWICE.search(core):
        return True
    if core.isalpha():
        return False
    return any(c in LOOKS or c in GAPS for c in core) and any(c.isalpha() for c in core) or bool(_SPELLED_TOKEN.search(core))


def _ends(token: str) -> tuple[str, str, str]:
    """A token without quotes and brackets, its first letters and its last ones: two, three where they are the same."""
    core = _core(token)
    return core, core[: 3 if core[:1] == core[1:2] else 2], core[-3 if core[-1:] == core[-2:-1] else -2 :]


class _Plain(dict):
    """Letters that share a look-alike as one; what is no letter in any reading is gone."""

    def __missing__(self, c: int):
        x = LOOKS.get(chr(c), chr(c))[0]
        self[c] = {"l": "i", "g": "b"}.get(x, x if x.isalpha() else None)
        return self[c]


_PLAIN = _Plain()
_REPEATED = re.compile(r"(.)\1+", re.DOTALL)


def skeleton(token: str) -> str:
    """The same for all readings of a token, and part of it for each word of a reading."""
    return _REPEATED.sub(r"\1", token.translate(_PLAIN))


def _automaton(words) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        out.add_word(w)
    out.make_automaton()
    return out


class _Characters:
    """What characters are in a skeleton, by code point; looked up as they come."""

    BETWEEN = 1  # kept, and in no word

    def __init__(self):
        self.known, self.to = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32)
        self.known[0], self.to[0] = True, self.BETWEEN

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        for c in np.unique(codes[~self.known[codes]]).tolist():
            x = _PLAIN[c]
            self.known[c], self.to[c] = True, ord(x) if x else 0
        return self.to[codes]


_characters = _Characters()


def names_of(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings with a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]


@dataclass
class Reader:
    """The wanted words and word beginnings that some reading of a text holds."""

    characters: np.ndarray
    wanted: dict[str, int] = field(default_factory=dict)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)
    ends: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    links: dict[str, bool] = field(default_factory=dict)
    #: The wanted ones by what they are without repeats.
    thin: dict[str, list[int]] = field(default_factory=dict)
    seeker: ahocorasick.Automaton | None = None

    def __post_init__(self):
        for x, i in self.wanted.items():
            self.thin.setdefault(_REPEATED.sub(r"\1", x), []).append(i)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "ends": {}, "links": {}, "seeker": None}

    def forget(self) -> None:
        for memo in (self.known, self.ends, self.links):
            memo.clear()

    def written(self, text: str) -> set[str]:
        """Words of a text as written and in the plainer disguises."""
        text = text.lower()
        words = set(_LETTERS.findall(text))
        odd = {t for t in text.split() if len(t) <= LONG and _PLAIN_SIGHT.search(t)} if _PLAIN_SIGHT.search(text) else set()
        for t in odd.union(_SPELLED.findall(text)):
            words.update(decode(t, self.characters).split())
        return words

    def _of(self, token: str) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            numbers = {self.wanted.get(x) for w in _LETTERS.findall(token) for x in names_of(w)}
            if disguised(token):
                for w in decode(token, self.characters).split():
                    numbers.update(self.wanted.get(x) for x in names_of(w))
                    thin = _REPEATED.sub(r"\1", w)  # how often a letter was meant is not to be told
                    for x in (thin, *[thin[:n] + "*" for n in range(SHORTEST, max(PREFIXES) + 1)]):
                        numbers.update(self.thin.get(x, ()))
            found = tuple(numbers - {None})
            if len(token) <= LONG:
                if len(self.known) > MEMORY:
                    self.known.clear()
                self.known[token] = found
        return found

    def _linked(self, ends: str) -> bool:
        """Whether the likeliest reading drops a space between ends of tokens."""
        if ends.count(" ") == 1:
            at = ends.index(" ")
            if _code(ends[at - 1]) == _code(ends[at + 1]) == 27:
                return False
        return decode(ends, self.characters).count(" ") < ends.count(" ")

    def _joined(self, tokens: list[str]) -> set[str]:
        """What neighbouring tokens are together, wherever a space is likelier dropped."""
        ends, links = self.ends, self.links
        for memo in (ends, links):
            if len(memo) > MEMORY:
                memo.clear()
        out: set[str] = set()
        run: list[str] = []
        tail, core, singles = "", "", []  # the last token of several characters, and single ones since
        for t in [*tokens, ""]:
            found = ends.get(t)
            if found is None:
                found = ends[t] = _ends(t)
            following, head, next_tail = found
            if len(following) == 1:
                singles.append(following)
                continue
            if not following and t:
                continue  # no more than quotes, brackets or separators
            if singles:
                key = " ".join([x for x in (tail, *singles, head) if x])
            elif core and head:
                key = f"{tail} {head}"
            else:
                key = ""
            linked = links.get(key)
            if linked is None:
                linked = self._linked(key)
                if len(key) < 40:
                    links[key] = linked
            if linked:
                run += [x for x in (() if run else (core,)) if x] + singles
                if following:
                    run.append(following)
                if singles:
                    middle = " ".join(singles)
                    out.update((middle, f"{core} {middle}", f"{middle} {following}"))
                else:
                    out.add(core + following)
            if run and not (linked and following):
                out.add("".join(run) if min(map(len, run)) > 1 else " ".join(run))
                run = []
            tail, core, singles = next_tail, following, []
        return out

    def _around(self, places: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray, big: str) -> Iterator[tuple[int, set[int]]]:
        """Places that span several tokens, by first and last token -> (a token, features of what they are
        together with the token before and the one behind)."""
        places.sort()
        a, b = places[0]
        for c, d in [*places[1:], (len(starts) + 9, 0)]:
            if c <= b + 1:
                b = max(b, d)
                continue
            text = big[starts[max(a - 1, 0)] : ends[min(b + 1, len(ends) - 1)]]
            text = text[text.rfind("\0", 0, starts[a] - starts[max(a - 1, 0)]) + 1 :].partition("\0")[0]
            found: set[int] = set()
            for t in self._joined(text.split()).union(_SPELLED.findall(text)):
                found.update(self._of(t))
            yield a, found
            a, b = c, d

    def features(self, texts: list[str]) -> list[set[int]]:
        """Of each text, the numbers of the wanted words and beginnings that it holds in some reading."""
        out: list[set[int]] = [set() for _ in texts]
        if not self.wanted or not texts:
            return out
        if self.seeker is None:
            self.seeker = _automaton({skeleton(x.rstrip("*")) for x in self.wanted})
        big = "\0".join([t.lower().replace("\0", " ") for t in texts])
        codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = _characters(codes)
        at = np.flatnonzero(plain)
        plain = plain[at]
        first = np.ones(len(at), bool)  # of a run of one letter
        first[1:] = plain[1:] != plain[:-1]
        plain, begun, ended = plain[first], at[np.r_[first[1:], True]], at[first]
        hits = np.array([(end - size + 1, end) for end, size in self.seeker.iter(plain.tobytes().decode("utf-32-le", "surrogatepass"))], np.int64).reshape(-1, 2)
        if not len(hits):
            return out
        solid = ~np.isin(codes, _SPACE) & (codes > 0)
        edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(np.flatnonzero(codes == 0), starts)
        a, b = (np.searchsorted(starts, x, "right") - 1 for x in (begun[hits[:, 0]], ended[hits[:, 1]]))
        for i in np.unique(a[a >= b]).tolist():
            out[doc[i]].update(self._of(big[starts[i] : ends[i]]))
        wide = np.unique(np.stack([a, b], 1)[a < b], axis=0).tolist()
        if wide:
            for i, found in self._around([tuple(x) for x in wide], starts, ends, big):
                out[doc[i]].update(found)
        return out


@dataclass
class Model:
    reader: Reader
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> list[float]:
        z = [self.bias + float(self.weights[list(x)].sum()) if x else self.bias for x in self.reader.features(texts)]
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in z]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def _learn(rows: list[tuple[bytes, int]], reader: Reader) -> Model:
    """rows: (feature numbers as 32-bit numbers, label)."""
    y = np.array([t for _, t in rows], float)
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    if not len(y) or y.min() == y.max() or not reader.wanted:
        return Model(Reader(reader.characters), np.zeros(0), base)
    held = [np.frombuffer(x, np.int32) for x, _ in rows]
    at, doc = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
    n = len(reader.wanted)
    # accelerated gradient steps, not scaled by feature: common features learn first, chance ones last
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, bias, ahead_w, ahead_bias = np.zeros(n), base, np.zeros(n), base
    v = np.ones(n + 1)
    for _ in range(30):  # the curvature's largest value, for the longest safe step
        v /= np.linalg.norm(v)
        u = weight * (v[-1] + np.bincount(doc, v[at], minlength=len(y)))
        v = np.r_[np.bincount(at, u[doc], minlength=n), u.sum()] / len(y)
    rate = 1 / (0.3 * np.linalg.norm(v) + PENALTY)
    for step in range(STEPS):
        z = ahead_bias + np.bincount(doc, ahead_w[at], minlength=len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        next_w = ahead_w - rate * (np.bincount(at, error[doc], minlength=n) / len(y) + PENALTY * ahead_w)
        next_bias = ahead_bias - rate * error.mean()
        pace = step / (step + 3)
        ahead_w, ahead_bias = next_w + pace * (next_w - w), next_bias + pace * (next_bias - bias)
        w, bias = next_w, next_bias
    z = bias + np.bincount(doc, w[at], minlength=len(y))
    clean, toxic = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.01)
    if clean < toxic:
        # The classes part. Toxic texts of the sample mostly hold several telling words,
        # one must do as well: a half lies a quarter of the gap above the clean ones.
        bias -= clean + (toxic - clean) / 4
    return Model(reader, w, float(bias))


def _written(reader: Reader):
    """(text, toxic) -> (words, toxic)."""

    def run(batches):
        for batch in batches:
            words = [[w for w in sorted(reader.written(t.as_py())) if len(skeleton(w)) >= SHORTEST] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    return run


def _held(reader: Reader):
    """(text, toxic) -> (feature numbers, toxic)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), READ_BYTES):
                rows = [np.array(sorted(x), np.int32).tobytes() for x in reader.features(batch.column(0).slice(a, b - a).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(a, b - a)], names=["held", "toxic"])

    return run


def _telling(words: DataFrame) -> dict[str, int]:
    """words: (words, toxic). At most MOST_FEATURES features, numbered: those in toxic texts mostly,
    so much more than the share of all that, by the Chernoff bound, chance among as many doesn't give it."""
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    share = size["toxic"] / max(size["n"], 1)
    if not 0 < share < 1:
        return {}
    word = words.select(F.explode("words").alias("w"), "toxic").groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    # a text with two words of one beginning counts for it twice
    begun = F.filter(F.array(*[F.when(F.length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in PREFIXES]), lambda x: x.isNotNull())
    rows = word.select(F.explode(F.concat(F.array("w"), begun)).alias("name"), "n", "toxic").groupBy("name").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    p = F.col("toxic") / F.col("n")
    gain = F.col("n") * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    rows = common.materialise(rows.where(F.col("toxic") >= 2).where((p > share) & (p >= TELLING)).select("name", gain.alias("gain")), "features")
    enough = math.log(max(rows.count(), 1)) + DOUBT
    best = rows.where(F.col("gain") >= enough).orderBy(F.desc("gain"), "name").limit(MOST_FEATURES).select("name").collect()
    common.discard(rows)
    found = sorted(r["name"] for r in best)
    return {x: i for i, x in enumerate(x for x in found if len(skeleton(x.rstrip("*"))) >= SHORTEST)}


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """Learns from labels of documents that are not held out."""
    reader = Reader(character_model(docs))
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    # at most most_labelled rows of two numbers
    sample = common.materialise(common.keyed(docs).join(F.broadcast(some), "id").select("text", "toxic"), "labelled")
    words = common.materialise(sample.mapInArrow(tidied(_written(reader)), "words array<string>, toxic int"), "words")
    reader = Reader(reader.characters, _telling(words))
    rows = sample.mapInArrow(tidied(_held(reader)), "held binary, toxic int").collect()
    common.discard(sample, words)
    return _learn(sorted((bytes(r["held"]), r["toxic"]) for r in rows), reader)


def scorer(model: Model):
    """A Pandas UDF from text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = pa.array([t or "" for t in texts], pa.large_string())
            yield pd.Series([x for a, b in slices(some, READ_BYTES) for x in model.scores(some.slice(a, b - a).to_pylist())], dtype=float)
        model.reader.forget()
        tidy()

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = common.keyed(docs).select("id", scorer(model)("text").alias("score"))
    public = rows.select(common.public_id(), "score")
    return public.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that score less than a half. A model that has learned no feature rejects none."""
    model = fit(docs, labels)
    return docs.where(scorer(model)(F.col("text")) < 0.5) if model.reader.wanted else docs
