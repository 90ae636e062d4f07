"""AND search over the index: terms, intersection, pages, lines."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import IndexConfig
from tracewell.functions.tokenizers import chain

#: The two numbers of a line in one.
LOG_ID = "doc_id * 1000000 + row_index"
#: A page is sent to all tasks up to so many rows; beyond that it is joined by shuffle.
MOST_BROADCAST = 100_000
MOST_TERMS = 62
FAR_HOTTER = 8


@dataclass(frozen=True)
class SearchRequest:
    business: str
    keywords: dict[str, str]
    days: tuple[str, ...] = ()
    page_size: int = 20
    page_number: int = 0
    pv_only: bool = False
    where: str | None = None
    extra: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.business or not self.keywords:
            raise ValueError("business and keywords are required")
        if self.page_size < 1 or self.page_number < 0:
            raise ValueError("no such page")

    @property
    def begin(self) -> int:
        return self.page_number * self.page_size

    @classmethod
    def from_json(cls, text: str) -> SearchRequest:
        query = json.loads(text).get("query")
        if not isinstance(query, dict) or not isinstance(query.get("keywords"), dict):
            raise ValueError("query and query.keywords are required")
        options = query.get("options") or {}
        days = query.get("days") or [query.get("day")]
        return cls(
            business=query.get("business", ""),
            keywords={k: str(v) for k, v in query["keywords"].items()},
            days=tuple(d for d in days if d),
            page_size=int(query.get("page_size", 20)),
            page_number=int(query.get("page_number", 0)),
            pv_only=bool(int(options.get("pv_only") or 0)),
            where=options.get("filter") or None,
            extra={k: v for k, v in query.items() if k == "progress_key"},
        )


def terms(keywords: dict[str, str]) -> list[tuple[str, str]]:
    """(field, token): each tab-separated piece of a value is a term of its own."""
    return sorted({(f, t.lower()) for f, v in keywords.items() for t in v.split("\t") if t})


def normalised(spark, config: IndexConfig, name: str, value: str) -> list[str]:
    """Terms of a query value by the field's own chain, as lines are indexed."""
    rows = spark.range(1).select(chain(F.lit(value), config.tokenizers.get(name, ())).alias("t")).first()
    return sorted(rows["t"])


def hits(postings: DataFrame, wanted: list[tuple[str, str]], *keys: str) -> DataFrame:
    """(keys, doc_id, row_index) of lines that hold all terms; no terms, no lines.

    One pass: the terms' filter reaches the scan, each posting sets its term's bit,
    and partial sums of bits meet once."""
    wanted = sorted(set(wanted))
    if len(wanted) > MOST_TERMS:  # a long has so many bits; what some of the terms leave is narrowed by others
        some = [hits(postings, wanted[i : i + MOST_TERMS], *keys) for i in range(0, len(wanted), MOST_TERMS)]
        return reduce(lambda a, b: a.join(b, [*keys, "doc_id", "row_index"], "left_semi"), some)
    is_term = [(F.col("field") == f) & (F.col("token") == t) for f, t in wanted]
    if not wanted:
        return postings.select(*keys, "doc_id", "row_index").limit(0)
    rows = postings.where(reduce(lambda a, b: a | b, is_term))
    if len(wanted) == 1:
        return rows.select(*keys, "doc_id", "row_index").distinct()
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << i).otherwise(0).cast("long") for i, c in enumerate(is_term)])
    return rows.groupBy(*keys, "doc_id", "row_index").agg(F.bit_or(bits).alias("bits")).where(F.col("bits") == (1 << len(wanted)) - 1).drop("bits")


def term_counts(stats: DataFrame, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Hits of each term, a row each."""
    rows = stats.where(reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("token") == t) for f, t in wanted]))
    return {(r["field"], r["token"]): r["pv"] for r in rows.groupBy("field", "token").agg(F.sum("pv").alias("pv")).collect()}


def best_hits(postings: DataFrame, stats: DataFrame, wanted: list[tuple[str, str]], *keys: str) -> DataFrame:
    """hits(), from the rarest term on where another is FAR_HOTTER; none where a term has no hit at all."""
    if len(set(wanted)) < 2:
        return hits(postings, wanted, *keys)
    counts = term_counts(stats, wanted)
    found = [counts.get(x, 0) for x in set(wanted)]
    if not min(found):
        return hits(postings, [], *keys)
    return hits_by_rarest(postings, stats, wanted, *keys, counts=counts) if max(found) >= FAR_HOTTER * min(found) else hits(postings, wanted, *keys)


def hits_by_rarest(postings: DataFrame, stats: DataFrame, wanted: list[tuple[str, str]], *keys: str, counts: dict | None = None) -> DataFrame:
    """hits() for a hot term beside a rare one: semi-joins from the rarest term on, so
    the hot term's postings are only probed."""
    counts = counts or term_counts(stats, wanted)
    each = [postings.where((F.col("field") == f) & (F.col("token") == t)).select(*keys, "doc_id", "row_index").distinct() for f, t in sorted(set(wanted), key=lambda x: (counts.get(x, 0), x))]
    return reduce(lambda a, b: a.join(b, [*keys, "doc_id", "row_index"], "left_semi"), each)


def totals(found: DataFrame, stats: DataFrame, wanted: list[tuple[str, str]], *keys: str) -> DataFrame:
    """(keys, total, pv, uv). One term: pv from the statistics, uv 0; several: both the
    number of lines in the intersection."""
    out = found.groupBy(*keys).agg(F.count("*").alias("total"))
    if len(set(wanted)) != 1:
        return out.withColumn("pv", F.col("total")).withColumn("uv", F.col("total"))
    ((f, t),) = set(wanted)
    one = stats.where((F.col("field") == f) & (F.col("token") == t)).select(*keys, "pv")
    if keys:
        return out.join(one, list(keys), "left").withColumn("uv", F.lit(0).cast("long"))
    return out.crossJoin(one.agg(F.coalesce(F.sum("pv"), F.lit(0)).alias("pv"))).withColumn("uv", F.lit(0).cast("long"))  # one row each


def page(found: DataFrame, size: int, number: int = 0) -> DataFrame:
    """Rows of a page in the order of lines: a distributed top-k, then an offset."""
    return found.orderBy("doc_id", "row_index").offset(number * size).limit(size)


def page_by_day(found: DataFrame, size: int, number: int = 0, key: str = "day") -> DataFrame:
    """A page of each day; ranks beyond the page are cut before they are shuffled."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "row_index"))
    return found.withColumn("_n", n).where(F.col("_n") <= (number + 1) * size).where(F.col("_n") > number * size).drop("_n")


def fetch(rows: DataFrame, lines: DataFrame, most: int, *keys: str) -> DataFrame:
    """Lines of a page of at most ``most`` rows; a line that is gone stays, as null."""
    small = F.broadcast(rows) if most <= MOST_BROADCAST else rows
    on = [*keys, "doc_id", "row_index"]
    there = lines.join(small, on, "left_semi")  # the page is what is sent, the lines are only filtered
    return rows.join(there, on, "left")


def search(postings: DataFrame, stats: DataFrame, lines: DataFrame, request: SearchRequest, wanted: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(totals by day, the page's lines by day, or None if only counts are wanted).

    wanted: the terms, if they are known as they are indexed; else the request's, in lower case.
    A filter is a predicate over line; it is applied before paging."""
    wanted, keys = terms(request.keywords) if wanted is None else wanted, ("day",)

    def of(df: DataFrame) -> DataFrame:
        if "business" in df.columns:
            df = df.where(F.col("business") == request.business)
        return df.where(F.col("day").isin(*request.days)) if request.days else df

    postings, stats, lines = of(postings), of(stats), of(lines)
    found = best_hits(postings, stats, wanted, *keys)
    counts = totals(found, stats, wanted, *keys)
    if request.pv_only:
        return counts, None
    most = request.page_size * max(1, len(request.days) or MOST_BROADCAST)
    if request.where:
        matching = lines.join(found, [*keys, "doc_id", "row_index"], "left_semi").where(F.expr(request.where))
        return counts, page_by_day(matching, request.page_size, request.page_number)
    return counts, fetch(page_by_day(found, request.page_size, request.page_number), lines, most, *keys)


def responses(counts: DataFrame, rows: DataFrame | None, request: SearchRequest) -> DataFrame:
    """(day, response): one JSON document a day; a page's rows are few, so they meet in one."""
    hit = F.struct("doc_id", "row_index", F.lit(1).alias("base64"), F.base64(F.col("line").cast("binary")).alias("data"))
    if rows is None:
        out = counts.withColumn("hits", F.array().cast("array<struct<doc_id:bigint,row_index:int,base64:int,data:string>>"))
    else:
        out = counts.join(rows.groupBy("day").agg(F.sort_array(F.collect_list(hit)).alias("hits")), "day", "left")
    body = F.struct("total", "pv", "uv", F.lit(request.page_number).alias("page_number"), F.lit(request.page_size).alias("page_size"), F.coalesce("hits", F.array()).alias("hits"))
    keywords = F.lit(json.dumps(request.keywords, ensure_ascii=False))
    return out.select("day", F.to_json(F.struct(F.lit(0).alias("code"), F.lit("").alias("err"), F.col("day").cast("string").alias("day"), keywords.alias("keywords"), body.alias("hits"))).alias("response"))
