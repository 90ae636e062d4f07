"""One query for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import IndexConfig, Step
from tracewell.engine import Engine
from tracewell.functions import hashing, text
from tracewell.functions.tokenizers import chain
from tracewell.operators import documents, ids, index, kv, search
from tracewell.operators.fields import json_value, kv_pairs
from tracewell.operators.search import SearchRequest
from tracewell.plans.inputs import (
    DOCUMENTS,
    LINES_PER_DOC,
    WORDS,
    document_files,
    document_lines,
    document_postings,
    event_files,
    event_lines,
    event_postings,
    numbered_lines,
    stored_lines,
    stored_postings,
    table,
)
from tracewell.session import scratch
from tracewell.sources import files, registry
from tracewell.streaming.ingest import append_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_LINES = r"""
    ln AS (SELECT doc_id AS file_id, generate_subscripts(ls, 1) - 1 AS n, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    fl AS (SELECT file_id, count(*) AS n_lines, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_docs FROM ln GROUP BY file_id),
    be AS (SELECT *, CAST(coalesce(sum(n_docs) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM fl),
    num AS (SELECT file_id, n, line, CAST(begin + n // 16 AS BIGINT) AS doc_id, CAST(n % 16 AS INTEGER) AS row_index FROM ln JOIN be USING (file_id))"""
_POSTINGS = _LINES + r""",
    post AS (SELECT DISTINCT doc_id, row_index, 'text' AS field, token
             FROM (SELECT doc_id, row_index, lower(unnest(string_split_regex(string_split(line, chr(9))[1], '[^0-9A-Za-z]+'))) AS token FROM num)
             WHERE token <> '' AND token <> 'null')"""
_EVENTS = r"""
    ev AS (SELECT CAST(ts AS DATE) AS day, event_id // 128 AS doc_id, CAST(event_id % 128 AS INTEGER) AS row_index,
                  concat_ws(chr(9), CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type, '-', props) AS line, event_type, user_id, event_id FROM events)"""
_FILES = r"""
    ef AS (SELECT event_id, '/data/logs/' || event_type || '/info.' || strftime(ts, '%Y-%m-%d-%H-%M') || '.' || event_id || '.gz' AS path,
                  event_id % 5000 AS size, 'idc' || (user_id % 3) AS idc, date_trunc('minute', ts) AS t FROM events)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = "op_" + f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Documents and numbering


@query(f"WITH {_LINES} SELECT file_id, n, doc_id, row_index FROM num")
def doc_numbering(spark, sf_dir):
    return numbered_lines(spark, sf_dir).select("file_id", F.col("n").cast("long").alias("n"), "doc_id", "row_index")


@query(f"WITH {_LINES} SELECT file_id, n_lines, n_docs, begin FROM be")
def first_doc_ids(spark, sf_dir):
    found = numbered_lines(spark, sf_dir).select("file_id", F.col("n").alias("line_no"), "doc_id")
    return document_files(spark, sf_dir).select("file_id", "n_lines", "n_docs").join(documents.first_doc_ids(found, "file_id"), "file_id")


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY row_index) || chr(10) AS text FROM num GROUP BY doc_id")
def doc_packing(spark, sf_dir):
    return documents.documents(numbered_lines(spark, sf_dir).select("doc_id", "row_index", "line"))


@query(f"WITH {_LINES} SELECT file_id, doc_id, string_agg(line, chr(10) ORDER BY row_index) || chr(10) AS text FROM num GROUP BY file_id, doc_id")
def doc_gzip(spark, sf_dir):
    docs = documents.documents(numbered_lines(spark, sf_dir).select("file_id", "doc_id", "row_index", "line"), "file_id")
    return documents.gz_documents(docs, "file_id").select("file_id", "doc_id", files.gunzip("member").cast("string").alias("text"))


@query(r"SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(url)) AS BIGINT) AS bytes FROM pages WHERE url IS NOT NULL AND strlen(url) < 10485760")
def line_scan(spark, sf_dir):
    path = scratch(spark, "lines")
    table(spark, sf_dir, "pages").where("url is not null").select("url").write.option("compression", "gzip").text(path)
    lines = files.read_lines(spark, f"{path},").where(F.octet_length("line") < DOCUMENTS.longest_line)
    return lines.agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes"))


# Fields


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(NULL AS VARCHAR) AS missing FROM events")
def tab_projection(spark, sf_dir):
    from tracewell.operators.fields import tab_value

    lines = event_lines(spark, sf_dir)
    return lines.select(tab_value(F.col("line"), 0).cast("long").alias("event_id"), tab_value(F.col("line"), 1).alias("user_id"), tab_value(F.col("line"), 2).alias("event_type"), tab_value(F.col("line"), 9).alias("missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string('{\"a\": {\"b\": ' || props || '}}', '$.a.b.k') AS nested, json_extract_string(props, '$.zz') AS missing FROM events")
def json_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    nested = F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}"))
    return e.select("event_id", json_value(F.col("props"), "k").alias("k"), json_value(nested, "a.b.k").alias("nested"), json_value(F.col("props"), "zz").alias("missing"))


@query(r"""
    WITH l AS (SELECT event_id, '<type=' || event_type || '> noise <user=' || user_id || '><type=again>' AS line FROM events)
    SELECT event_id, unnest(regexp_extract_all(line, '<(\w+)=([^>]*)>', 1)) AS key, unnest(regexp_extract_all(line, '<(\w+)=([^>]*)>', 2)) AS value FROM l""")
def kv_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("<type="), "event_type", F.lit("> noise <user="), F.col("user_id").cast("string"), F.lit("><type=again>"))
    return e.select("event_id", F.explode(kv_pairs(line)).alias("p")).select("event_id", "p.key", "p.value")


@query(r"""
    WITH t AS (SELECT 'who' AS field, CAST(user_id AS VARCHAR) AS token FROM events UNION ALL SELECT 'who', event_type FROM events)
    SELECT field, token, count(*) AS pv FROM t GROUP BY ALL""")
def alias_merge(spark, sf_dir):
    config = IndexConfig("events", "TAB", ("event_id", "user_id", "event_type"), {"user_id": (Step("keyword"),), "event_type": (Step("keyword"),)}, {"user_id": "who", "event_type": "who"})
    return index.token_stats(index.tokens(event_lines(spark, sf_dir), config), "field", "token")


@query("SELECT event_id, event_type || '|' || event_id || '|' AS picked FROM events")
def pick_columns(spark, sf_dir):
    line = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", text.pick_columns(line, r"\|", [2, 0, 7]).alias("picked"))


# Tokenizers


def _of_urls(spark, sf_dir, *steps: Step) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(chain(F.col("url"), steps)).alias("token"))


@query(r"""SELECT file_id, n, lower(regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS token FROM (WITH """ + _LINES + r""" SELECT * FROM ln)
    WHERE lower(regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) NOT IN ('', 'null')""")
def tok_keyword(spark, sf_dir):
    rows = document_lines(spark, sf_dir).select("file_id", F.col("n").cast("long").alias("n"), F.explode(chain(F.col("line"), (Step("keyword"),))).alias("token"))
    return rows


@query(r"""SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(string_split_regex(text, '[\s.,]+')) AS token FROM documents) WHERE token NOT IN ('', 'null')""")
def tok_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(chain(F.col("text"), (Step("split", r"[\s.,]+"),))).alias("token"))


@query(r"""
    WITH t AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents))
    SELECT doc_id, token FROM t WHERE token <> 'null' AND CASE WHEN regexp_matches(token, '[^\x00-\x7F]') THEN length(token) >= 2
        WHEN regexp_full_match(token, '[0-9]+') THEN length(token) >= 5 WHEN regexp_full_match(token, '0x[0-9a-f]+') THEN length(token) >= 6
        ELSE length(token) BETWEEN 4 AND 128 END""")
def tok_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(chain(F.col("text"), (Step("text"),))).alias("token"))


@query(r"SELECT page_id, replace(replace(replace(url_encode(url), '%20', '+'), '%2A', '*'), '~', '%7E') AS token FROM pages WHERE url <> ''")
def tok_urlencode(spark, sf_dir):
    return _of_urls(spark, sf_dir, Step("urlencode"))


@query(r"SELECT page_id, lower(replace(replace(replace(url_encode(url), '%20', '+'), '%2A', '*'), '~', '%7E')) AS token FROM pages WHERE url <> ''")
def tok_urlencode_lower(spark, sf_dir):
    return _of_urls(spark, sf_dir, Step("UrlEncode"))


@query("SELECT page_id, url AS token FROM pages WHERE url <> ''")
def tok_urldecode(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.url_encode("url").alias("url"))
    bad = pages.select("page_id", F.concat(F.lit("%zz"), "url").alias("url"))
    return pages.unionByName(bad).select("page_id", F.explode(chain(F.col("url"), (Step("urldecode"),))).alias("token"))


@query("SELECT page_id, url AS token FROM pages WHERE url <> ''")
def tok_base64decode(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.rtrim(F.base64(F.col("url").cast("binary")), F.lit("=")).alias("url"))
    return pages.select("page_id", F.explode(chain(F.col("url"), (Step("base64decode"),))).alias("token"))


@query(r"""
    WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS p FROM pages WHERE url <> ''),
    h AS (SELECT *, string_split(host, '.') AS ls FROM u),
    t AS (SELECT page_id, url AS token FROM h UNION SELECT page_id, host FROM h
          UNION SELECT page_id, array_to_string(ls[i:], '.') FROM (SELECT page_id, ls, unnest(range(2, len(ls))) AS i FROM h)
                WHERE NOT (i = len(ls) - 1 AND ls[i] IN ('com', 'edu', 'gov', 'net', 'org', 'cn', 'hk'))
          UNION SELECT page_id, host || '/' || p[2] FROM h WHERE len(p) > 1 AND p[2] <> ''
          UNION SELECT page_id, p[2] || '/' || p[3] FROM h WHERE len(p) > 2 AND p[2] <> '' AND p[3] <> ''
          UNION SELECT page_id, host || '/' || p[2] || '/' || p[3] || '/' || p[4] FROM h WHERE len(p) > 3 AND p[2] <> '' AND p[3] <> '' AND p[4] <> '')
    SELECT page_id, token FROM t WHERE token <> '' AND token <> 'null'""")
def tok_url(spark, sf_dir):
    return _of_urls(spark, sf_dir, Step("url"))


@query(r"""
    WITH l AS (SELECT event_id, ['C:', event_type, '', 'u' || user_id, event_id || '.log'] AS p FROM events)
    SELECT DISTINCT event_id, token FROM (SELECT event_id, unnest(p || [array_to_string(p, '\'), p[1] || '\' || p[2], p[4] || '\' || p[5]]) AS token FROM l) WHERE token <> ''""")
def tok_path(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.concat(F.lit("C:\\"), "event_type", F.lit("\\\\u"), F.col("user_id").cast("string"), F.lit("\\"), F.col("event_id").cast("string"), F.lit(".log"))
    return e.select("event_id", F.explode(chain(value, (Step("path"),))).alias("token"))


@query(r"""
    SELECT DISTINCT event_id, unnest(['c:', event_type, CAST(user_id AS VARCHAR), 'c:%5c' || event_type || '%5c' || user_id]) AS token FROM events""")
def tok_path_urlenc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.concat(F.lit(" C:%5C"), "event_type", F.lit("%5C"), F.col("user_id").cast("string"), F.lit("\t"))
    return e.select("event_id", F.explode(chain(value, (Step("pathWithUrlencode"),))).alias("token"))


@query(r"""
    SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['10.' || user_id || '.1.' || event_id, '10.' || user_id || '.1'] ELSE ['10.' || user_id || '.1'] END) AS token FROM events""")
def tok_ip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    three = F.concat(F.lit("10."), F.col("user_id").cast("string"), F.lit(".1"))
    value = F.when(F.col("event_id") % 2 == 0, F.concat(three, F.lit("."), F.col("event_id").cast("string"))).otherwise(three)
    return e.select("event_id", F.explode(chain(value, (Step("ip"),))).alias("token"))


@query(r"SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(string_split_regex(text, '[^0-9A-Za-z]+')) AS token FROM documents) WHERE regexp_full_match(token, 't[a-h]+|[0-9]{4,}')")
def tok_regexcheck(spark, sf_dir):
    check = Step("regexcheck", base64.b64encode(b"t[a-h]+|[0-9]{4,}").decode())
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(chain(F.col("text"), (Step("split", "[^0-9A-Za-z]+"), check))).alias("token"))


@query(f"""WITH {_POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, row_index) AS k FROM post)
    SELECT token, doc_id, row_index FROM r WHERE token NOT IN ('the', 'that', 'de') OR k % 10 = 5""")
def tok_filter(spark, sf_dir):
    listed = spark.createDataFrame([("the",), ("that",), ("de",)], "token string")
    return index.sample_listed(document_postings(spark, sf_dir), listed, 10).select("token", "doc_id", "row_index")


@query(f"WITH {_POSTINGS} SELECT token, doc_id, row_index FROM post WHERE token NOT IN ('the', 'that', 'de')")
def tok_blacklist(spark, sf_dir):
    config = IndexConfig("docs", "TAB", ("text",), {"text": (Step("split", "[^0-9A-Za-z]+"), Step("keyword"), Step("tokenfilter"))}, token_filters={"text": ("the", "that", "de")})
    return index.tokens(numbered_lines(spark, sf_dir).select("doc_id", "row_index", "line"), config).select("token", "doc_id", "row_index")


@query(r"""SELECT page_id, regexp_matches(url, '^\w+://[\w\-.]+') AS is_url, length(regexp_replace(url, '[0-9A-Za-z]', '', 'g')) / CAST(length(url) AS DOUBLE) AS symbols, trim(url, 'htps:/') AS trimmed FROM pages""")
def scalar_helpers(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.is_url(url).alias("is_url"), text.symbol_ratio(url).alias("symbols"), text.trim_chars(url, "htps:/").alias("trimmed"))


# Index


@query(f"WITH {_POSTINGS} SELECT field, token, doc_id, row_index FROM post")
def postings(spark, sf_dir):
    return document_postings(spark, sf_dir).select("field", "token", "doc_id", "row_index")


@query(f"WITH {_POSTINGS} SELECT field, token, count(*) AS pv FROM post GROUP BY ALL")
def pv(spark, sf_dir):
    return index.token_stats(document_postings(spark, sf_dir), "field", "token")


@query(f"WITH {_POSTINGS} SELECT count(DISTINCT doc_id * 1000000 + row_index) AS total, count(*) AS pv FROM post WHERE token = 'the'")
def total(spark, sf_dir):
    rows = document_postings(spark, sf_dir).where("token = 'the'")
    return rows.agg(F.count_distinct(F.expr(search.LOG_ID)).alias("total"), F.count("*").alias("pv"))


@query(f"""WITH {_POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, row_index) AS k, count(*) OVER (PARTITION BY token) AS pv FROM post)
    SELECT token, doc_id, row_index, pv FROM r WHERE k <= 100""")
def posting_cap(spark, sf_dir):
    rows = document_postings(spark, sf_dir)
    stats = index.token_stats(rows, "field", "token")
    return index.cap(rows, 100, "field", "token").join(stats, ["field", "token"]).select("token", "doc_id", "row_index", "pv")


@query(f"""WITH {_POSTINGS} SELECT token, row_number() OVER w AS position, doc_id - lag(doc_id, 1, 0) OVER w AS delta, row_index FROM post WINDOW w AS (PARTITION BY token ORDER BY doc_id, row_index)""")
def delta_encode(spark, sf_dir):
    return index.delta_encode(document_postings(spark, sf_dir), "token").withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_POSTINGS} SELECT token, doc_id, row_index FROM post")
def delta_decode(spark, sf_dir):
    return index.delta_decode(index.delta_encode(document_postings(spark, sf_dir), "token"), "token")


_TEXT_ROWS = f"""WITH {_POSTINGS}, d AS (SELECT token, doc_id, row_index, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY token ORDER BY doc_id, row_index) AS delta FROM post)
    SELECT token || chr(9) || 'text' || chr(9) || string_agg(delta || ',' || row_index, ';' ORDER BY doc_id, row_index) || chr(9) || count(*) AS value FROM d GROUP BY token"""


@query(_TEXT_ROWS)
def posting_text(spark, sf_dir):
    rows = index.posting_lists(document_postings(spark, sf_dir), "field", "token")
    return rows.select(index.text_row(F.col("token"), F.col("field"), F.col("postings"), F.col("pv")).alias("value"))


@query(_TEXT_ROWS)
def posting_text_round_trip(spark, sf_dir):
    path = scratch(spark, "index-text")
    posting_text(spark, sf_dir).write.text(path)
    again = index.parse_text_rows(files.read_index_text(spark, path))
    return again.select(index.text_row(F.col("token"), F.col("field"), F.col("postings"), F.col("pv")).alias("value"))


@query(f"WITH {_POSTINGS} SELECT field, token, count(*) AS pv FROM post GROUP BY ALL")
def index_merge(spark, sf_dir):
    rows = document_postings(spark, sf_dir)
    old, new = (index.token_stats(rows.where(F.col("doc_id") % 2 == i), "field", "token") for i in (0, 1))
    return index.merge_stats(old, new, "field", "token")


# Hashes and keys


_M = "CAST(4294967296 AS HUGEINT)"


@query(f"""WITH {_POSTINGS}, w AS (SELECT DISTINCT token, hex(encode(token)) AS hx, strlen(token) AS n FROM post),
    -- the four bytes of each block, and the bytes left over, as little-endian numbers
    b AS (SELECT token, n, list_transform(range(0, n // 4), lambda i: CAST('0x' || hx[i * 8 + 7:i * 8 + 8] || hx[i * 8 + 5:i * 8 + 6] || hx[i * 8 + 3:i * 8 + 4] || hx[i * 8 + 1:i * 8 + 2] AS HUGEINT)) AS ks,
                 CASE WHEN n % 4 = 0 THEN CAST(0 AS HUGEINT) ELSE CAST('0x' || array_to_string(list_transform(range(n % 4 - 1, -1, -1), lambda i: hx[(n // 4) * 8 + i * 2 + 1:(n // 4) * 8 + i * 2 + 2]), '') AS HUGEINT) END AS tail FROM w),
    s AS (SELECT token, n, list_transform(list_transform(list_transform(ks || [tail], lambda k: k * 3432918353 % {_M}), lambda k: k * 32768 % {_M} + k // 131072), lambda k: CAST(k * 461845907 % {_M} AS BIGINT)) AS ks FROM b),
    f AS (SELECT token, xor(xor(list_reduce([CAST(0 AS BIGINT)] || ks[:-2], lambda h, k: CAST(((xor(h, k) * CAST(8192 AS HUGEINT) % {_M} + xor(h, k) // 524288) * 5 + 3864292196) % {_M} AS BIGINT)), ks[-1]), CAST(n AS BIGINT)) AS h FROM s),
    g AS (SELECT token, CAST(CAST(xor(h, h >> 16) AS HUGEINT) * 2246822507 % {_M} AS BIGINT) AS h FROM f),
    e AS (SELECT token, CAST(CAST(xor(h, h >> 13) AS HUGEINT) * 3266489909 % {_M} AS BIGINT) AS h FROM g),
    z AS (SELECT token, xor(h, h >> 16) AS h FROM e)
    SELECT token, CASE WHEN h > 2147483648 THEN 4294967296 - h WHEN h = 2147483648 THEN -2147483648 ELSE h END AS hash FROM z""")
def token_hash(spark, sf_dir):
    stats = index.token_stats(document_postings(spark, sf_dir), "token")
    return stats.select("token", hashing.token_hash(F.col("token")).alias("hash"))


@query(ORACLE_SQL["op_token_hash"].replace("SELECT token, CASE", "SELECT token, lpad(CAST((CASE").replace("END AS hash FROM z", "END) // 200 AS VARCHAR), 8, '0') AS shard FROM z"))
def token_shard(spark, sf_dir):
    return token_hash(spark, sf_dir).select("token", hashing.shard_id(F.col("hash"), 200).alias("shard"))


@query("WITH s AS (" + ORACLE_SQL["op_token_shard"] + r""")
    SELECT token, shard, CAST((list_reduce([CAST(1 AS BIGINT)] || list_transform(string_split(shard, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) & 2147483647) % 1000 AS BIGINT) AS file FROM s""")
def file_partition(spark, sf_dir):
    rows = token_shard(spark, sf_dir)
    return rows.withColumn("file", hashing.file_number(F.col("shard")))


@query(r"""SELECT event_id, event_type || strftime(ts, '%y%m%d') || lpad(CAST(event_id // 200 AS VARCHAR), 8, '0') AS index_key, strftime(ts, '%y%m%d') || event_id AS doc_key FROM events""")
def meta_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", hashing.index_key(F.col("event_type"), F.col("ts"), hashing.shard_id(F.col("event_id"))).alias("index_key"), hashing.doc_key(F.col("ts"), F.col("event_id")).alias("doc_key"))


# Search

_TWO = [("text", "the"), ("text", "that")]
_AND = f"WITH {_POSTINGS}, hit AS (SELECT doc_id, row_index FROM post WHERE token = 'the' INTERSECT SELECT doc_id, row_index FROM post WHERE token = 'that')"


@query(f"WITH {_POSTINGS} SELECT doc_id, row_index FROM post WHERE token = 'the'")
def search_term(spark, sf_dir):
    return search.hits(stored_postings(spark, sf_dir), [("text", "the")])


@query(f"{_AND} SELECT doc_id, row_index FROM hit")
def search_and(spark, sf_dir):
    return search.hits(stored_postings(spark, sf_dir), _TWO)


@query(f"{_AND} SELECT doc_id, row_index FROM hit")
def search_and_rarest(spark, sf_dir):
    rows = stored_postings(spark, sf_dir)
    return search.hits_by_rarest(rows, index.token_stats(rows, "field", "token"), _TWO)


@query(f"WITH {_EVENTS} SELECT day, doc_id, row_index FROM ev WHERE event_type = 'click' AND user_id = 7")
def search_and_fields(spark, sf_dir):
    return search.hits(event_postings(spark, sf_dir), [("event_type", "click"), ("user_id", "7")], "day")


@query(f"{_AND} SELECT doc_id, row_index FROM hit")
def search_multi_token(spark, sf_dir):
    return search.hits(stored_postings(spark, sf_dir), search.terms({"text": "The\t\tthat"}))


@query(f"{_AND} SELECT doc_id, row_index FROM hit ORDER BY doc_id, row_index LIMIT 20 OFFSET 20")
def search_page(spark, sf_dir):
    return search.page(search_and(spark, sf_dir), 20, 1)


@query(f"{_AND} SELECT count(*) AS total, count(*) AS pv, count(*) AS uv FROM hit")
def search_pv_only(spark, sf_dir):
    rows = stored_postings(spark, sf_dir)
    return search.totals(search.hits(rows, _TWO), index.token_stats(rows, "field", "token"), _TWO)


@query(f"WITH {_POSTINGS} SELECT count(*) AS total, count(*) AS pv, CAST(0 AS BIGINT) AS uv FROM post WHERE token = 'the'")
def search_counts_one(spark, sf_dir):
    rows, one = stored_postings(spark, sf_dir), [("text", "the")]
    return search.totals(search.hits(rows, one), index.token_stats(rows, "field", "token"), one)


@query(f"{_AND} SELECT doc_id, row_index, line FROM hit JOIN num USING (doc_id, row_index) WHERE length(line) % 2 = 0 ORDER BY doc_id, row_index LIMIT 30")
def search_filter(spark, sf_dir):
    lines = stored_lines(spark, sf_dir).select("doc_id", "row_index", "line")
    matching = lines.join(search_and(spark, sf_dir), ["doc_id", "row_index"], "left_semi").where("length(line) % 2 = 0")
    return search.page(matching, 30)


@query(f"{_AND} SELECT doc_id, row_index, line FROM (SELECT * FROM hit ORDER BY doc_id, row_index LIMIT 20) JOIN num USING (doc_id, row_index)")
def search_fetch(spark, sf_dir):
    lines = stored_lines(spark, sf_dir).select("doc_id", "row_index", "line")
    return search.fetch(search.page(search_and(spark, sf_dir), 20), lines, 20)


@query(r"SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 2 THEN string_split(text, chr(10))[3] ELSE text END AS line FROM documents")
def row_pick(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.pick_row(F.col("text"), F.lit(2)).alias("line"))


@query(f"""WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY doc_id, row_index) AS k FROM ev WHERE event_type = 'click' AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-05')
    SELECT strftime(day, '%Y-%m-%d') AS day, doc_id, row_index, line FROM r WHERE k > 5 AND k <= 10""")
def search_multi_day(spark, sf_dir):
    rows = event_postings(spark, sf_dir)
    request = search.SearchRequest("events", {"event_type": "click"}, ("2024-01-03", "2024-01-04", "2024-01-05"), 5, 1)
    _, page = search.search(rows, index.token_stats(rows, "day", "field", "token"), event_lines(spark, sf_dir), request)
    return page.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "doc_id", "row_index", "line")


@query(f"""WITH {_EVENTS}, c AS (SELECT * FROM ev WHERE event_type = 'click' AND day IN (DATE '2024-01-03', DATE '2024-01-04')),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY doc_id, row_index) AS k, count(*) OVER (PARTITION BY day) AS t FROM c)
    SELECT strftime(day, '%Y-%m-%d') AS day, '{{"code":0,"err":"","day":"' || strftime(day, '%Y-%m-%d') || '","keywords":"{{\\"event_type\\": \\"click\\"}}","hits":{{"total":' || any_value(t) || ',"pv":' || any_value(t)
        || ',"uv":0,"page_number":0,"page_size":3,"hits":[' || string_agg('{{"doc_id":' || doc_id || ',"row_index":' || row_index || ',"base64":1,"data":"' || to_base64(CAST(line AS BLOB)) || '"}}', ',' ORDER BY doc_id, row_index) || ']}}}}' AS response
    FROM r WHERE k <= 3 GROUP BY day""")
def result_json(spark, sf_dir):
    rows = event_postings(spark, sf_dir)
    request = search.SearchRequest("events", {"event_type": "click"}, ("2024-01-03", "2024-01-04"), 3)
    found = search.search(rows, index.token_stats(rows, "day", "field", "token"), event_lines(spark, sf_dir), request)
    return search.responses(*found, request).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "response")


# Key-value metadata and ids


def _store(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_custkey").alias("seq"))


@query("SELECT k AS key, coalesce(to_base64(CAST(o_orderstatus AS BLOB)), '') AS value FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer) LEFT JOIN orders ON k = CAST(o_orderkey AS VARCHAR)")
def kv_multiget(spark, sf_dir):
    return kv.multi_get(_store(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")))


@query(r"""
    WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value, 0 AS seq FROM orders UNION ALL
               SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority, 1 FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT 'new' || c_custkey, c_mktsegment, 1 FROM customer)
    SELECT key, max_by(value, seq) AS value FROM a GROUP BY key""")
def kv_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = _store(spark, sf_dir).withColumn("seq", F.lit(0))
    changed = orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"), F.lit(1).alias("seq"))
    fresh = table(spark, sf_dir, "customer").select(F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"), F.lit(1).alias("seq"))
    return kv.upsert(old, changed.unionByName(fresh)).select("key", "value")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def kv_delete(spark, sf_dir):
    return kv.delete(_store(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))).select("key", "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer")
def kv_set_body(spark, sf_dir):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), F.base64(F.col("c_mktsegment").cast("binary")))
    return kv.parse_set(table(spark, sf_dir, "customer").select(line.alias("line")))


@query("SELECT '240105' || event_id AS key, event_type AS value FROM events")
def kv_bulk_load(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws("\t", F.col("event_id").cast("string"), "event_type").alias("value"))
    return kv.from_rows(rows.unionByName(spark.createDataFrame([("short",)], "value string")), "240105")


@query("SELECT 'type240105' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS key, '{\"path\":\"part-1\",\"offset\":' || (event_id * 3) || ',\"length\":3}' AS value FROM events")
def kv_index_load(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    row = F.concat_ws("\t", F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit("part-1"), (F.col("event_id") * 3).cast("string"), F.lit("3"))
    return kv.from_shard_rows(e.select(row.alias("value")), "type", "240105")


@query(r"""SELECT business, day, seq, count, CAST(coalesce(sum(count) OVER (PARTITION BY business, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index
    FROM (SELECT event_type AS business, strftime(ts, '%Y%m%d') AS day, event_id AS seq, greatest(event_id % 7 - 1, 1) AS count FROM events)""")
def id_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ids.allocate(e.select(F.col("event_type").alias("business"), F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 - 1).alias("count")))


@query(r"""SELECT field, file, shard, length, CAST(coalesce(sum(length) OVER (PARTITION BY field, file ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
    FROM (SELECT event_type AS field, event_id % 10 AS file, lpad(CAST(event_id // 10 AS VARCHAR), 8, '0') AS shard, event_id % 97 + 10 AS length FROM events)""")
def shard_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return index.shard_offsets(e.select(F.col("event_type").alias("field"), (F.col("event_id") % 10).alias("file"), F.lpad(F.expr("cast(event_id div 10 as string)"), 8, "0").alias("shard"), (F.col("event_id") % 97 + 10).alias("length")))


# Ingestion


@query(r"""WITH m AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'id' || event_id END AS id, 'host' || user_id AS host, '/data/logs/' || event_type || '/file.' || event_id AS path FROM events)
    SELECT CASE WHEN event_id % 2 = 0 THEN ':' || path WHEN id = '' THEN host || ':' || path ELSE id END AS id, 'bj' AS content, path FROM m WHERE length(path) >= 20""")
def parse_message(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("/data/logs/"), "event_type", F.lit("/file."), F.col("event_id").cast("string"))
    three = F.concat_ws("\t", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("id"), F.col("event_id").cast("string"))), F.concat(F.lit("host"), F.col("user_id").cast("string")), F.concat(path, F.lit(" ")))
    message = F.concat(F.when(F.col("event_id") % 2 == 0, path).otherwise(three), F.lit("\na\tb\nshort\n"))
    return documents.parse_messages(e.select(message.alias("message")), "bj")


@query(f"WITH {_FILES} SELECT path, strftime(t, '%Y-%m-%d %H:%M:%S') AS file_time FROM ef")
def filename_time(spark, sf_dir):
    return event_files(spark, sf_dir).select("path", F.date_format(text.file_time(F.col("path")), "yyyy-MM-dd HH:mm:ss").alias("file_time"))


@query(f"WITH {_FILES} SELECT strftime(time_bucket(INTERVAL 15 MINUTE, t), '%Y-%m-%d %H:%M:%S') AS win, idc, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ef WHERE size > 0 GROUP BY ALL")
def gather_window(spark, sf_dir):
    rows = documents.gather(event_files(spark, sf_dir), 15)
    return rows.select(F.date_format("window", "yyyy-MM-dd HH:mm:ss").alias("win"), "idc", "files", "bytes")


@query(f"""WITH {_FILES}, w AS (SELECT time_bucket(INTERVAL 15 MINUTE, t) AS win, idc, count(*) AS files FROM ef WHERE size > 0 GROUP BY ALL)
    SELECT strftime(win, '%Y-%m-%d %H:%M:%S') AS win, idc, files FROM w WHERE TIMESTAMP '2024-01-10 00:00:00' >= win + INTERVAL 30 MINUTE""")
def due_windows(spark, sf_dir):
    rows = documents.due(documents.gather(event_files(spark, sf_dir), 15), F.lit("2024-01-10 00:00:00").cast("timestamp"), 30)
    return rows.select(F.date_format("window", "yyyy-MM-dd HH:mm:ss").alias("win"), "idc", "files")


@query(f"""WITH RECURSIVE {_FILES}, f AS (SELECT time_bucket(INTERVAL 60 MINUTE, t) AS win, idc, path, size, row_number() OVER (PARTITION BY time_bucket(INTERVAL 60 MINUTE, t), idc ORDER BY path) AS k FROM ef WHERE size > 0),
    r AS (SELECT win, idc, path, k, CAST(0 AS BIGINT) AS flush, size AS total FROM f WHERE k = 1 UNION ALL
          SELECT f.win, f.idc, f.path, f.k, r.flush + CASE WHEN r.total >= 6000 THEN 1 ELSE 0 END, f.size + CASE WHEN r.total >= 6000 THEN 0 ELSE r.total END
          FROM r JOIN f ON f.win = r.win AND f.idc = r.idc AND f.k = r.k + 1)
    SELECT strftime(win, '%Y-%m-%d %H:%M:%S') AS win, idc, path, flush FROM r""")
def size_flush(spark, sf_dir):
    rows = documents.flush_by_size(event_files(spark, sf_dir), 60, 6000)
    return rows.select(F.date_format("window", "yyyy-MM-dd HH:mm:ss").alias("win"), "idc", "path", "flush")


@query(f"""WITH {_FILES}, f AS (SELECT idc AS dir, path AS name FROM ef) SELECT dir, name FROM f WHERE name > '/data/logs/click/info.2024-01-15' AND name < (SELECT max(name) FROM f g WHERE g.dir = f.dir) AND dir = 'idc0'
    UNION ALL SELECT dir, name FROM f WHERE dir <> 'idc0' AND name < (SELECT max(name) FROM f g WHERE g.dir = f.dir)""")
def new_files(spark, sf_dir):
    found = event_files(spark, sf_dir).select(F.col("idc").alias("dir"), F.col("path").alias("name"))
    mark = "/data/logs/click/info.2024-01-15"
    with_mark = found.unionByName(spark.createDataFrame([("idc0", mark)], "dir string, name string"))
    return registry.new_files_table(with_mark, mark, hold_newest=True)


@query(f"""WITH {_FILES} SELECT event_id, strftime(time_bucket(INTERVAL 5 MINUTE, t), '%Y-%m-%d/%H/%M') AS folder, 'f' || event_id || '_h_' || strftime(t, '%m%d%H%M00%H%M') AS short,
    '/logs/' || strftime(t, '%Y-%m-%d') || '/f' || event_id || '_h_' || strftime(t, '%m%d%H%M00') || '_' || strftime(t, '%Y-%m-%d-%H-%M') || '.gz' AS long FROM ef""")
def output_paths(spark, sf_dir):
    rows = event_files(spark, sf_dir).withColumn("at", text.file_time(F.col("path")))
    rows = rows.withColumn("short", text.short_path(F.concat(F.lit("f"), F.col("event_id").cast("string")), F.lit("h"), F.col("at"), F.col("at")))
    return rows.select("event_id", text.date_path(F.col("at"), "Y-m-d/H/i:5").alias("folder"), "short", text.long_path(F.col("short"), F.col("at"), "/logs").alias("long"))


@query(ORACLE_SQL["op_gather_window"])
def stream_ingest(spark, sf_dir):
    source, sink, mark = (scratch(spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    listed = event_files(spark, sf_dir).select("path", "size", "idc")
    listed.write.json(source)
    stream = spark.readStream.schema(listed.schema).option("maxFilesPerTrigger", 4).json(source)
    append_batches(stream, sink, mark, lambda batch: documents.gather(batch, 15).drop("paths")).awaitTermination()
    rows = spark.read.parquet(sink).groupBy("window", "idc").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return rows.select(F.date_format("window", "yyyy-MM-dd HH:mm:ss").alias("win"), "idc", "files", "bytes")


def _stored_documents(spark, sf_dir, packed: bool) -> DataFrame:
    """(path, doc_id, offset, length): all documents' texts in files of 500, as they are or gzipped."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    member = documents.gzip_member("text") if packed else F.encode("text", "utf-8")
    rows = docs.select(F.concat(F.lit("docs-"), F.expr("doc_id div 500"), F.lit(".bin")).alias("file"), "doc_id", member.alias("member"))
    return files.write_members(rows, scratch(spark, "members"))


@query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS md5, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT -1, 1000000000000, NULL, 'range beyond the end' UNION ALL SELECT -2, 1, NULL, 'no such file'""")
def range_read(spark, sf_dir):
    stored = _stored_documents(spark, sf_dir, packed=False)
    one = stored.orderBy("path").limit(1)
    odd = one.select(F.lit(-1).cast("long").alias("doc_id"), "path", F.lit(0).cast("long").alias("offset"), F.lit(10**12).alias("length")).unionByName(
        one.select(F.lit(-2).cast("long").alias("doc_id"), F.concat("path", F.lit(".none")).alias("path"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("length"))
    )
    asked = stored.unionByName(odd)
    got = files.read_ranges(asked).join(asked, ["path", "offset", "length"])
    return got.where("error is not null or length > 0 or doc_id >= 0").select("doc_id", "length", F.md5("content").alias("md5"), "error").distinct()


@query("SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def gunzip(spark, sf_dir):
    stored = _stored_documents(spark, sf_dir, packed=True)
    return files.read_ranges(stored, unpack=True).join(stored, ["path", "offset", "length"]).select("doc_id", F.md5("content").alias("md5"))


_GROUPS = r"""
    gl AS (SELECT source, doc_id AS file_id, generate_subscripts(ls, 1) - 1 AS n, unnest(ls) AS line
           FROM (SELECT source, doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    gn AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY file_id, n) - 1 AS k FROM gl),
    gb AS (SELECT source, CAST(coalesce(sum(ceil(c / 16.0)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
           FROM (SELECT source, count(*) AS c FROM gl GROUP BY source)),
    gp AS (SELECT source, CAST(begin + k // 16 AS BIGINT) AS doc_id, CAST(k % 16 AS INTEGER) AS row_index, line FROM gn JOIN gb USING (source))"""


@query(f"WITH {_GROUPS} SELECT source, doc_id, row_index, line FROM gp")
def doc_packing_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    return documents.pack_groups(docs, ["source"], "doc_id", "text", LINES_PER_DOC, F.lit(0))


@query("SELECT CAST(doc_id AS VARCHAR) || chr(9) || 'docs-' || (doc_id // 500) || '.bin' AS row FROM documents WHERE text IS NOT NULL")
def doc_meta(spark, sf_dir):
    rows = documents.doc_meta_rows(_stored_documents(spark, sf_dir, packed=True))
    parts = F.split("value", "\t")
    place = F.get_json_object(F.unbase64(F.get(parts, F.lit(1))).cast("string"), "$.path")
    return rows.select(F.concat_ws("\t", F.get(parts, F.lit(0)), F.element_at(F.split(place, "/"), -1)).alias("row"))


@query(r"""SELECT source, md5(string_agg(regexp_replace(text, '\n\z', ''), chr(10) ORDER BY doc_id)) AS md5 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source""")
def plain_concat(spark, sf_dir):
    folder = scratch(spark, "concat")
    documents.plain_concat(table(spark, sf_dir, "documents").where("text is not null and source is not null"), "source", "doc_id", "text", folder)
    rows = spark.read.option("lineSep", "\n").schema("value string, source string").text(folder)
    rows = rows.select("source", "value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    return rows.groupBy("source").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "b", "n", "value"))), lambda r: r["value"]), "\n")).alias("md5"))


@query("SELECT 'f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.gz' ELSE '' END AS path, md5(text) AS md5 FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'f' || doc_id, md5(text) FROM documents WHERE text IS NOT NULL")
def rezip(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "utf-8").alias("content"))
    some = documents.rezip(plain.where("int(substring(path, 2)) % 2 = 0"), zip=True, unzip=False).unionByName(plain.where("int(substring(path, 2)) % 2 = 1"))
    back = documents.rezip(some, zip=False, unzip=True)
    opened = some.select("path", F.md5(F.when(F.col("path").endswith(".gz"), files.gunzip("content")).otherwise(F.col("content"))).alias("md5"))
    return opened.unionByName(back.select("path", F.md5("content").alias("md5")))


@query(f"""WITH {_POSTINGS} SELECT token, count(*) AS pv, count(*) AS postings FROM post GROUP BY token""")
def shard_blob(spark, sf_dir):
    blobs = index.shard_blobs(document_postings(spark, sf_dir))
    rows = blobs.select(F.explode(F.split(files.gunzip("blob").cast("string"), "\n")).alias("value"))
    return index.parse_text_rows(rows).select("token", "pv", F.size("postings").cast("long").alias("postings"))


@query(f"WITH {_POSTINGS} SELECT token, count(*) AS pv, md5(string_agg(doc_id || ',' || row_index, ';' ORDER BY doc_id, row_index)) AS md5 FROM post GROUP BY token")
def dump_merge(spark, sf_dir):
    """Two dumps, of even and odd documents, that share tokens."""
    rows = document_postings(spark, sf_dir)
    dumps = [index.posting_lists(rows.where(f"doc_id % 2 = {i}"), "field", "token").select(index.text_row(F.col("token"), F.col("field"), F.col("postings"), F.col("pv")).alias("value")) for i in (0, 1)]
    read = index.parse_text_rows(dumps[0].unionByName(dumps[1]))
    pairs = F.sort_array(F.flatten(F.collect_list("postings")))
    merged = read.groupBy("token").agg(F.sum("pv").alias("pv"), pairs.alias("p"))
    return merged.select("token", "pv", F.md5(F.array_join(F.transform("p", lambda x: F.concat_ws(",", x["doc_id"].cast("string"), x["row_index"].cast("string"))), ";")).alias("md5"))


def _engine(spark, sf_dir, posting_cap: int = 1_000_000) -> Engine:
    """All documents, ingested and indexed in two batches, the first of them twice."""
    config = IndexConfig("docs", "TAB", ("text",), {"text": WORDS}, lines_per_doc=LINES_PER_DOC, posting_cap=posting_cap)
    engine = Engine(spark, config, scratch(spark, "engine"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    for batch, some in (("even", "file_id % 2 = 0"), ("even", "file_id % 2 = 0"), ("odd", "file_id % 2 = 1")):
        engine.ingest(rows.where(some), "2024-01-01", batch)
        engine.build_index("2024-01-01")
    return engine


@query(f"WITH {_POSTINGS} SELECT field, token, count(*) AS pv, count(*) AS postings, (SELECT sum(n_docs) FROM be) AS docs FROM post GROUP BY ALL")
def engine_two_ingests(spark, sf_dir):
    """Counts and postings after ingest, build, the same again, ingest, build, merge twice, rebuild."""
    engine = _engine(spark, sf_dir)
    more = spark.createDataFrame([("docs", "2024-01-02", "text", "merged", 1, 0)], "business string, day string, field string, token string, doc_id long, row_index int").withColumn("day", F.to_date("day"))
    for _ in range(2):
        engine.merge_index(more, "m")
    engine.build_index("2024-01-01", again=True)
    day = F.col("day") == "2024-01-01"
    n = engine._table("lines").where(day).select("doc_id").distinct().agg(F.count("*").alias("docs"))
    kept = engine._table("postings").where(day).groupBy("field", "token").agg(F.count("*").alias("postings"))
    return engine.stats().where(day).join(kept, ["field", "token"]).select("field", "token", "pv", "postings").join(F.broadcast(n))  # one row


@query("SELECT CAST(NULL AS BIGINT) AS doc_id WHERE false")
def engine_no_such_token(spark, sf_dir):
    """A word that yields no term, or that no line holds, leaves no hit of the other."""
    engine = _engine(spark, sf_dir)
    found = [engine.search(SearchRequest("docs", {"text": f"the\t{x}"}, ("2024-01-01",), page_size=1000))[1] for x in ("---", "nosuchword")]
    return found[0].unionByName(found[1]).select("doc_id")


@query(f"WITH {_POSTINGS}, r AS (SELECT token, count(*) AS pv, least(count(*), 200) AS kept FROM post GROUP BY token) SELECT token, pv, kept FROM r WHERE pv > 100")
def engine_cap(spark, sf_dir):
    """100 postings of each token in each of two batches; tokens of over 100 whose batches are both full, or not cut."""
    engine = _engine(spark, sf_dir, posting_cap=100)
    kept = engine._table("postings").groupBy("token", "batch").agg(F.count("*").alias("n"))
    counts = engine._table("token_stats").groupBy("token", "batch").agg(F.sum("pv").alias("pv"))
    rows = counts.join(kept, ["token", "batch"]).withColumn("whole", F.col("n") == F.least("pv", F.lit(100)))
    rows = rows.groupBy("token").agg(F.sum("pv").alias("pv"), F.sum(F.when(F.col("whole"), F.col("n"))).alias("n"), F.min("pv").alias("least")).where("pv > 100")
    return rows.select("token", "pv", F.when(F.col("n") < 100, 0).otherwise(F.least("pv", F.lit(200))).cast("long").alias("kept"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, numbering, tokens, an AND search with its counts, and the first page's lines."""
    rows, lines = document_postings(spark, sf_dir), numbered_lines(spark, sf_dir).select("doc_id", "row_index", "line")
    found = search.hits(rows, _TWO)
    return search.fetch(search.page(found, LINES_PER_DOC), lines, LINES_PER_DOC)

