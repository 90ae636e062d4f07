"""Personal data in texts, found from anchors.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, schemes, and words
that announce an identifier. From each, a small parser expands to both sides and
validates what it has found; a second pass finds runs of digits, from which
addresses and cards are read. Every parser reads each character a bounded number
of times, so very long texts cost no more than their length.

Kinds, in this order. Base: email, ip, card, phone, exactly as the patterns
define them (leftmost, non-overlapping within a kind, what fails a check is
dropped without another try). Added, where they overlap no span found before:
address (a URL with credentials), account (an IBAN that passes its check, or
digits behind a word for account, social security or passport number) and secret
(a value behind a word for password or token).

Spans count code points, ends exclusive.

Defined cases: null or empty text: no spans. Null doc_id: kept, stays null.
Repeated rows: each is searched. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account", "secret")
KINDS = BASE + ADDED

# The base kinds' character classes.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGITS = frozenset("0123456789")
_PHONE = frozenset(" ().0123456789-")

_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_CREDENTIALS = re.compile(r"[^\s/?#@\"'<>]++@(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?")
_TAIL = re.compile(r"[^\s\"'<>]*+")
_LINK = re.compile(r"(?:[\s_-]*(?:number|num|nr|no|id|n°|#))?[\s.]{0,2}(?:\s?(?:is|was)\s|\s*[:=#]\s*|\s)", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9A-Za-z])")
_PASSPORT = re.compile(r"[A-Z]{1,2}[0-9]{6,9}(?![0-9A-Za-z])|[0-9]{8,9}(?![0-9A-Za-z])")
_ASSIGNED = re.compile(r"\s*+[:=]\s*+")
_QUOTED = re.compile(r"\"([^\"\s]{8,}+)\"|'([^'\s]{8,}+)'")
_BARE = re.compile(r"[^\s\"',;]*+")

# Words that announce an identifier, and the parser they call.
CUES = {
    "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "iban": ("iban",),
    "number": ("ssn", "social security"),
    "passport": ("passport",),
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey", "api-key"),
}


@lru_cache(maxsize=1)
def _automaton():
    found = ahocorasick.Automaton()
    for sign, what in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(sign, (what, len(sign)))
    for what, words in CUES.items():
        for w in words:
            for form in {w, w.capitalize(), w.title(), w.upper()}:
                found.add_word(form, (what, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    begin = at
    while begin > after and text[begin - 1] in _LOCAL:
        begin -= 1
    if begin == at:
        return None
    n, end, labels = len(text), at + 1, 0
    while True:
        start = end
        while end < n and text[end] in _HOST:
            end += 1
        if end == start:
            end -= 1  # a point that no label follows
            break
        labels += 1
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    return (begin, end) if labels >= 2 else None


def _phone(text: str, at: int) -> tuple[int, int] | None:
    n, end = len(text), at + 2
    if end > n or text[at + 1 : end] not in _DIGITS:
        return None
    last = 0
    while end < n and text[end] in _PHONE:
        if text[end] in _DIGITS and end >= at + 3:
            last = end + 1
        end += 1
    return (at, last) if last else None


def base_spans(text: str, anchors: list) -> dict[str, list[tuple[int, int]]]:
    emails, phones, ips, cards = [], [], [], []
    after_email = after_phone = 0
    for at, what in anchors:
        if what == "at":
            if found := _email(text, at, after_email):
                after_email = found[1]
                emails.append(found)
        elif what == "plus" and at >= after_phone and (found := _phone(text, at)):
            after_phone = found[1]
            if 8 <= sum(c in _DIGITS for c in text[slice(*found)]) <= 15:
                phones.append(found)
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                ips.append((at, at + size))
            at += size + 1
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def _secret(text: str, end: int, bare: int) -> tuple[tuple[str, int, int] | None, int]:
    """The value after a word, however long, and how far bare values are read: one that begins within another ends with it."""
    m = _ASSIGNED.match(text, end)
    if not m:
        return None, bare
    if q := _QUOTED.match(text, m.end()):
        return ("secret", *q.span(q.lastindex)), bare
    if m.end() >= bare:
        bare = _BARE.match(text, m.end()).end()
    return ("secret", m.end(), bare) if bare - m.end() >= 8 else None, bare


def _announced(text: str, what: str, end: int) -> tuple[str, int, int] | None:
    if text[end : end + 1].isalpha():
        return None
    link = _LINK.match(text, end)
    at = link.end() if link else end
    if m := _IBAN.match(text, at):
        code = m.group()
        while code and not iban(code):
            code = code.rpartition(" ")[0]  # a word in capitals may follow
        if code:
            return "account", at, at + len(code)
    pattern = {"passport": _PASSPORT, "iban": None}.get(what, _NUMBER)
    if pattern and link and (m := pattern.match(text, at)):
        return "account", *m.span()
    return None


class _Taken:
    """What spans cover, as ranges apart from each other in order."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a

    def put(self, a: int, b: int) -> None:
        """A span that meets none; those of a text come nearly in order."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind."""
    signs = [(end - size + 1, what, end + 1) for end, (what, size) in _automaton().iter(text)]
    spans = base_spans(text, [(at, what) for at, what, _ in signs]) | {k: [] for k in ADDED}
    cues = [x for x in signs if x[1] not in ("at", "plus")]
    if cues:
        taken, added = _Taken(x for k in BASE for x in spans[k]), _Taken()
        bare = tail = 0
        for at, what, end in cues:
            if what == "scheme":
                scheme, m = _SCHEME.search(text, max(0, at - 32), at), _CREDENTIALS.match(text, end)
                found = None
                if scheme and m:
                    to = m.end()
                    if text[to : to + 1] in ("/", "?", "#"):
                        if to >= tail:  # else within a run that was read before, and ends with it
                            tail = _TAIL.match(text, to).end()
                        to = tail
                    found = ("address", scheme.start(), to)
            elif at and text[at - 1].isalnum():
                found = None
            elif what == "secret":
                found, bare = _secret(text, end, bare)
            else:
                found = _announced(text, what, end)
            if found and not taken.meets(*found[1:]) and not added.meets(*found[1:]):
                spans[found[0]].append(found[1:])
                added.put(*found[1:])
    for k in ADDED:
        spans[k].sort()
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, or run of overlapping ones, named by its kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, x in spans.items() for a, b in x):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_DIGEST = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])


def _search(batches):
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            spans = find(text.as_py())
            rows.append((doc, *[len(spans[k]) for k in BASE], hashlib.sha256(listed(spans, BASE).encode()).hexdigest(), listed(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * len(_DIGEST), _DIGEST)], schema=_DIGEST)


def search(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    out = common.keyed(docs).mapInArrow(_search, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.select(common.public_id(), *[f"n_{k}" for k in BASE], "base_sha256", "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every span replaced and n_chars, where there is one, counted anew."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(t):
            if not t:
                return t
            spans = find(t)
            return redact(t, spans) if any(spans.values()) else t

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
