"""Token hash, shards, files and metadata keys, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = 0xFFFFFFFF


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _times(a: Column, c: int) -> Column:
    """32-bit product within 64 bits: halves of a, so that nothing overflows."""
    return _bind(a, lambda x: (x.bitwiseAND(65535) * F.lit(c).cast("long") + (F.shiftrightunsigned(x, 16) * F.lit(c).cast("long")).bitwiseAND(65535) * 65536).bitwiseAND(_ALL))


def _turn(a: Column, bits: int) -> Column:
    return _bind(a, lambda x: F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 32 - bits)).bitwiseAND(_ALL))


def _fold(a: Column, bits: int) -> Column:
    return _bind(a, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, bits)))


def _scramble(k: Column) -> Column:
    return _times(_turn(_times(k, 0xCC9E2D51), 15), 0x1B873593)


def _little_endian(hexes: Column, at: Column, n: int) -> Column:
    """n bytes of a hex string from byte ``at`` on."""
    pairs = [F.substring(hexes, at * 2 + 1 + 2 * i, F.lit(2)) for i in reversed(range(n))]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def murmur3(text: Column, seed: int = 0) -> Column:
    """murmur3_x86_32 of the UTF-8 bytes as an unsigned number."""
    hexes, n = F.hex(F.encode(text, "utf-8")), F.octet_length(text)
    blocks = F.floor(n / 4).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), lambda i: i < blocks)
    body = F.aggregate(
        at, F.lit(seed).cast("long"),
        lambda h, i: (_turn(h.bitwiseXOR(_scramble(_little_endian(hexes, i * 4, 4))), 13) * 5 + 0xE6546B64).bitwiseAND(_ALL),
    )
    rest = n % 4
    tail = F.when(rest == 3, _little_endian(hexes, blocks * 4, 3)).when(rest == 2, _little_endian(hexes, blocks * 4, 2)).when(rest == 1, _little_endian(hexes, blocks * 4, 1)).otherwise(F.lit(0).cast("long"))
    h = body.bitwiseXOR(_scramble(tail)).bitwiseXOR(n.cast("long"))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = _times(_fold(h, shift), factor)
    return _fold(h, 16)


def token_hash(token: Column) -> Column:
    """The hash as a signed 32-bit number, made positive (but for the least one)."""
    signed = _bind(murmur3(token), lambda x: F.when(x > 0x7FFFFFFF, x - (_ALL + 1)).otherwise(x))
    return _bind(signed, lambda x: F.when((x < 0) & (x != -(2**31)), -x).otherwise(x))


def shard_id(number: Column, width: int = 200) -> Column:
    """Zero-padded shard of a token hash, eight places at least."""
    return F.format_string("%08d", ((number - number % width) / width).cast("long"))


def file_number(shard: Column, files: int = 1000) -> Column:
    """The index file of a shard: polynomial string hash, base 31, from 1."""
    h = F.aggregate(F.split(shard, ""), F.lit(1).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(_ALL))
    return h.bitwiseAND(0x7FFFFFFF) % files


def index_key(field: Column, day: Column, shard: Column) -> Column:
    return F.concat(field, F.date_format(day, "yyMMdd"), shard)


def doc_key(day: Column, doc_id: Column) -> Column:
    return F.concat(F.date_format(day, "yyMMdd"), doc_id.cast("string"))
