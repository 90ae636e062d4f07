"""Plain versions of the operators, on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def substring(rows, width=20):
    """rows of different ids -> {id: (n_words, n_removed, sha)}."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: order(r[0])):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def shingles(text, n, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(rows, n, percent):
    """[(id, text)] -> for each row, the index of the least row that it reaches by links."""
    sets = [shingles(t, n, True) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(rows))], [len(s) for s in sets]


def quality(text):
    text = text or ""
    w = words(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = [False] * len(w)
    for i in range(len(w) - 7):
        if runs[tuple(w[i : i + 8])] > 1:
            covered[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(covered)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }
