"""Tokenizers: functions from an array of strings to an array of strings.

A field's chain starts with its value as the only element; every step maps a set
to a set. New tokenizers join by ``register``.
"""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.config import Step

Tokenizer = Callable[[Column, "str | None"], Column]
REGISTRY: dict[str, Tokenizer] = {}

# Second-level labels that name no site of their own.
GENERIC_LABELS = ("com", "edu", "gov", "net", "org", "cn", "hk")


def register(name: str, function: Tokenizer | None = None):
    def add(f: Tokenizer) -> Tokenizer:
        REGISTRY[name] = f
        return f

    return add(function) if function else add


def trim_controls(x: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.trim(x, F.lit("".join(map(chr, range(0x21)))))


def _each(function: Callable[[Column], Column]) -> Tokenizer:
    return lambda tokens, _=None: F.transform(tokens, function)


def _flat(function: Callable[[Column], Column]) -> Tokenizer:
    return lambda tokens, _=None: F.array_distinct(F.flatten(F.transform(tokens, function)))


def _bind(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


register("keyword", _each(lambda x: F.lower(trim_controls(x))))
register("lower-case", REGISTRY["keyword"])
register("urlencode", _each(F.url_encode))
register("UrlEncode", _each(lambda x: F.lower(F.url_encode(x))))


@register("urldecode")
def url_decode(tokens: Column, _: str | None = None) -> Column:
    """Decoded values; malformed ones go."""
    return F.filter(F.transform(tokens, F.try_url_decode), lambda x: x.isNotNull())


_SPELLED = {"0-9": string.digits, "A-Z": string.ascii_uppercase, "a-z": string.ascii_lowercase}


def spelled_out(pattern: str) -> str:
    """A class of nothing but 0-9, A-Z and a-z with each character named: it matches the same, but is a bitmap to
    java.util.regex, where each range is a call a character. Other patterns stay as they are."""
    if not re.fullmatch(r"\[\^?(?:0-9|A-Z|a-z)+\][+*?]?", pattern):
        return pattern
    return re.sub("0-9|A-Z|a-z", lambda m: _SPELLED[m[0]], pattern)


@register("split")
def split(tokens: Column, pattern: str | None = None) -> Column:
    by = spelled_out(pattern or r"\s+")
    return F.flatten(F.transform(tokens, lambda x: F.split(x, by)))


def long_enough(x: Column) -> Column:
    """Whether a segmented word is worth indexing."""
    return (
        F.when(x.rlike(r"[^\x00-\x7F]"), F.length(x) >= 2)
        .when(x.rlike(r"^[0-9]+$"), F.length(x) >= 5)
        .when(x.rlike(r"^0x[0-9a-f]+$"), F.length(x) >= 6)
        .otherwise(F.length(x).between(4, 128))
    )


def _segments(x: Column) -> Column:
    """Runs of letters and digits; of Han characters, every two neighbours."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), 0)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}"), pairs(r)).otherwise(F.array(r))))


@register("text")
def text(tokens: Column, _: str | None = None) -> Column:
    return F.filter(F.array_distinct(F.flatten(F.transform(tokens, _segments))), long_enough)


def _from_base64(x: Column) -> Column:
    """Lenient: other characters are skipped, both alphabets and missing padding accepted."""
    clean = F.regexp_replace(F.translate(F.substring_index(x, "=", 1), "-_", "+/"), r"[^A-Za-z0-9+/]", "")
    whole = _bind(clean, lambda c: F.when(F.length(c) % 4 == 1, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c))
    padded = _bind(whole, lambda c: F.rpad(c, F.ceil(F.length(c) / 4).cast("int") * 4, "="))
    return F.make_valid_utf8(F.unbase64(padded).cast("string"))


register("base64decode", _each(_from_base64))


def _url_tokens(x: Column) -> Column:
    host, authority = F.try_parse_url(x, F.lit("HOST")), F.try_parse_url(x, F.lit("AUTHORITY"))
    port = F.regexp_extract(F.coalesce(authority, F.lit("")), r":([0-9]*[1-9][0-9]*)$", 1)
    valid = F.try_parse_url(x, F.lit("PATH")).isNotNull()
    site = F.coalesce(F.concat(host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise("")), x)
    path = F.try_url_decode(F.replace(F.try_parse_url(x, F.lit("PATH")), F.lit("+"), F.lit("%2B")))

    def of(s: Column) -> Column:
        labels = F.split(s, r"\.")
        starts = F.filter(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: i <= F.size(labels))
        starts = F.filter(starts, lambda i: ~((i == F.size(labels) - 1) & F.get(labels, i - 1).isin(*GENERIC_LABELS)) & (i < F.size(labels)))
        suffixes = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        part = lambda i: F.get(F.split(path, "/"), F.lit(i))
        has = lambda *n: F.coalesce(F.lit(True) & (F.least(*[F.length(part(i)) for i in n], F.lit(1)) > 0) & part(n[-1]).isNotNull(), F.lit(False))
        paths = F.array(
            F.when(has(1), F.concat(s, F.lit("/"), part(1))),
            F.when(has(1, 2), F.concat_ws("/", part(1), part(2))),
            F.when(has(1, 2, 3), F.concat_ws("/", s, part(1), part(2), part(3))),
        )
        return F.concat(F.array(x, host, F.when(port != "", s)), F.when(F.size(labels) > 2, suffixes).otherwise(F.array().cast("array<string>")), paths)

    return F.when(x == "", F.array().cast("array<string>")).when(valid, F.filter(_bind(site, of), lambda t: t.isNotNull())).otherwise(F.array(x))


register("url", _flat(_url_tokens))


def _path_tokens(x: Column) -> Column:
    def of(parts: Column) -> Column:
        pairs = F.transform(parts, lambda p, i: F.when((p != "") & (F.get(parts, i - 1) != ""), F.concat(F.get(parts, i - 1), F.lit("\\"), p)))
        return F.filter(F.concat(F.array(x), parts, pairs), lambda t: t.isNotNull() & ((t != "") | (x == "")))

    return _bind(F.split(x, r"\\"), of)


register("path", _flat(_path_tokens))


def _encoded_path_tokens(x: Column) -> Column:
    return _bind(F.lower(trim_controls(x)), lambda v: F.filter(F.concat(F.split(v, "%5c"), F.array(v)), lambda t: t != ""))


register("pathWithUrlencode", _flat(_encoded_path_tokens))


def _ip_tokens(x: Column) -> Column:
    parts = F.split(F.regexp_replace(x, r"\.+$", ""), r"\.")
    return F.when(F.size(parts) == 4, F.array(x, F.array_join(F.slice(parts, 1, 3), "."))).otherwise(F.array(x))


register("ip", _flat(_ip_tokens))


@register("regexcheck")
def regex_check(tokens: Column, encoded: str | None = None) -> Column:
    """Values that match a base64-encoded pattern in full; without one, all."""
    if encoded is None:
        return tokens
    pattern = base64.b64decode(encoded).decode()
    return F.filter(tokens, lambda x: x.rlike(rf"\A(?:{pattern})\z"))


def block_list(listed: Iterable[str]) -> Tokenizer:
    """A tokenizer that drops listed tokens (a short list; a long one is a join: operators.index.drop_listed)."""
    words = sorted(set(listed))
    return lambda tokens, _=None: F.array_except(tokens, F.array(*map(F.lit, words)).cast("array<string>"))


def emitted(tokens: Column) -> Column:
    """What reaches the index: distinct tokens but null, empty and "null"."""
    return F.filter(F.array_distinct(tokens), lambda x: x.isNotNull() & (x != "") & (x != "null"))


def chain(value: Column, steps: Iterable[Step], extra: dict[str, Tokenizer] | None = None) -> Column:
    """Tokens of a value; unknown steps are passed over; no known step, or a null value, no tokens."""
    known = [(s, {**REGISTRY, **(extra or {})}[s.name]) for s in steps if s.name in REGISTRY or s.name in (extra or {})]
    none = F.array().cast("array<string>")
    if not known:
        return none
    tokens = F.array(value.cast("string"))
    for step, function in known:
        tokens = function(tokens, step.param)
    return F.when(value.isNull(), none).otherwise(emitted(tokens))
