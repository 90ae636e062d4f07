"""Scalar helpers on lines, names and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date letters of path templates and what Spark calls them.
DATE_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss"}


def date_path(when: Column, template: str) -> Column:
    """A path template such as ``Y-m-d/H/i:5`` (letters; ``:N`` truncates the minute) filled in."""
    template, _, every = template.partition(":")
    if every:
        step = int(every)
        when = F.timestamp_seconds(F.floor(F.unix_timestamp(when) / (60 * step)) * (60 * step))
    return F.date_format(when, "".join(DATE_LETTERS.get(c, f"'{c}'" if c.isalpha() else c) for c in template))


def file_time(path: Column) -> Column:
    """The time in a file name, yyyy-MM-dd-HH-mm or yyyy-MM-dd-HH; null without one."""
    full = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2})", 1)
    hour = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_timestamp(full, F.lit("yyyy-MM-dd-HH-mm")), F.try_to_timestamp(hour, F.lit("yyyy-MM-dd-HH")))


def short_path(file_id: Column, host: Column, begun: Column, window: Column) -> Column:
    """The stored form of a document file's path."""
    return F.concat_ws("_", file_id, host, F.concat(F.date_format(begun, "MMddHHmmss"), F.date_format(window, "HHmm")))


def long_path(short: Column, day: Column, root: str) -> Column:
    """The place of a file whose stored path ends in HHMM."""
    n = F.length(short)
    day = F.date_format(day, "yyyy-MM-dd")
    name = F.concat(F.substring(short, F.lit(1), n - 4), F.lit("_"), day, F.lit("-"), F.substring(short, n - 3, F.lit(2)), F.lit("-"), F.substring(short, n - 1, F.lit(2)), F.lit(".gz"))
    return F.concat(F.lit(root.rstrip("/") + "/"), day, F.lit("/"), name)


def pick_columns(line: Column, separator: str, positions: list[int]) -> Column:
    """Selected columns of a separated line, joined again; missing ones are empty."""
    parts = F.split(line, separator)
    return F.array_join(F.array(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in positions]), separator.replace("\\", ""))


def pick_row(doc: Column, row: Column) -> Column:
    """A document's line; the whole document where there is no such line."""
    return F.coalesce(F.get(F.split(doc, "\n"), row), doc)


def is_url(x: Column) -> Column:
    return x.rlike(r"^\w+://[\w\-.]+")


def symbol_ratio(x: Column) -> Column:
    """The share of characters other than ASCII letters and digits."""
    return F.length(F.regexp_replace(x, "[0-9A-Za-z]", "")) / F.nullif(F.length(x), F.lit(0))


def trim_chars(x: Column, chars: str) -> Column:
    return F.btrim(x, F.lit(chars))
