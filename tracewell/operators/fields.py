"""From a line to the values of its fields, in three formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.config import IndexConfig


def json_value(line: Column, path: str) -> Column:
    """A dotted path into a JSON line; null where there is none."""
    return F.get_json_object(line, "$." + path)


def tab_value(line: Column, position: int) -> Column:
    return F.get(F.split(line, "\t"), F.lit(position))


_PAIR = r"<(\w+)=([^>]*)>"


def kv_pairs(line: Column) -> Column:
    """All <key=value> pairs of a line, in order, as structs."""
    keys, values = (F.regexp_extract_all(line, F.lit(_PAIR), i) for i in (1, 2))
    return F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value")))


def kv_values(line: Column, key: str) -> Column:
    """All values of a key."""
    return F.transform(F.filter(kv_pairs(line), lambda p: p["key"] == key), lambda p: p["value"])


def values(line: Column, config: IndexConfig, name: str) -> Column:
    """The values of a configured field, none to several."""
    if config.format == "KV":
        return kv_values(line, name)
    one = json_value(line, name) if config.format == "JSON" else tab_value(line, config.field_names.index(name))
    return F.filter(F.array(one), lambda v: v.isNotNull())
