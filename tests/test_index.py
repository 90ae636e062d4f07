"""Index, search and ids: properties against a line scan."""

import datetime
import json
import time

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.config import IndexConfig, Step, steps
from tracewell.engine import Engine, Engines
from tracewell.operators import documents, fields, ids, index, kv, search
from tracewell.operators.search import SearchRequest

WORDS = (Step("split", "[^0-9A-Za-z]+"), Step("keyword"))
CONFIG = IndexConfig("b", "TAB", ("text", "kind"), {"text": WORDS, "kind": (Step("keyword"),)}, lines_per_doc=3)


def numbered(spark, lines):
    rows = [(i // 3, i % 3, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, row_index int, line string")


LINES = ["the cat\tA", "The dog the\tB", "no", "cat dog\tA", "", "the-cat,dog\tB\tC", "null\tnull"]


def scan(line):
    parts = line.split("\t")
    import re

    out = {("text", t.lower()) for t in re.split("[^0-9A-Za-z]+", parts[0]) if t and t.lower() != "null"}
    if len(parts) > 1 and parts[1] not in ("", "null"):
        out.add(("kind", parts[1].lower()))
    return out


def test_tokens_are_the_scan(spark):
    got = {(r.doc_id, r.row_index, r.field, r.token) for r in index.tokens(numbered(spark, LINES), CONFIG).collect()}
    assert got == {(i // 3, i % 3, f, t) for i, line in enumerate(LINES) for f, t in scan(line)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.text("ab \t,", max_size=8), min_size=1, max_size=12), wanted=st.sets(st.sampled_from([("text", "a"), ("text", "b"), ("text", "ab"), ("kind", "a")]), min_size=1, max_size=3))
def test_search_is_a_scan(spark, lines, wanted):
    postings = index.tokens(numbered(spark, lines), CONFIG)
    expected = {(i // 3, i % 3) for i, line in enumerate(lines) if wanted <= scan(line)}
    assert {tuple(r) for r in search.hits(postings, sorted(wanted)).collect()} == expected
    assert {tuple(r) for r in search.hits_by_rarest(postings, index.token_stats(postings, "field", "token"), sorted(wanted)).collect()} == expected


def test_no_terms_no_lines(spark):
    assert search.hits(index.tokens(numbered(spark, LINES), CONFIG), []).count() == 0


def test_delta_and_text_round_trip(spark):
    postings = index.tokens(numbered(spark, LINES * 5), CONFIG)
    plain = sorted(map(tuple, postings.select("field", "token", "doc_id", "row_index").collect()))
    again = index.delta_decode(index.delta_encode(postings, "field", "token"), "field", "token")
    assert sorted(map(tuple, again.select("field", "token", "doc_id", "row_index").collect())) == plain
    rows = index.posting_lists(postings, "field", "token").select(index.text_row(F.col("token"), F.col("field"), F.col("postings"), F.col("pv")).alias("value"))
    parsed = index.parse_text_rows(rows.unionByName(spark.createDataFrame([("a\tb\tc",)], "value string")))
    assert sorted((r.field, r.token, p.doc_id, p.row_index) for r in parsed.collect() for p in r.postings) == plain
    with_tab = spark.createDataFrame([("x\ty\tf\t1,2;0,3\t2",)], "value string")
    r = index.parse_text_rows(with_tab).first()
    assert (r.token, r.field, r.pv, [tuple(p) for p in r.postings]) == ("x\ty", "f", 2, [(1, 2), (1, 3)])


def test_delta_example(spark):
    doc_ids = [1, 3, 4, 7, 9, 115, 120, 121, 226]
    df = spark.createDataFrame([("t", d, 0) for d in doc_ids], "token string, doc_id long, row_index int")
    assert [r.delta for r in index.delta_encode(df, "token").orderBy("position").collect()] == [1, 2, 1, 3, 2, 106, 5, 1, 105]


def test_merge_is_one_build(spark):
    a, b = numbered(spark, LINES), numbered(spark, LINES[::-1])
    stats = lambda df: index.token_stats(index.tokens(df, CONFIG), "field", "token")
    merged = index.merge_stats(stats(a), stats(b), "field", "token")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, stats(a.unionByName(b)).collect()))


def test_cap(spark):
    df = spark.createDataFrame([("d", "f", "hot", i, 0) for i in range(500)] + [("d", "f", "cold", 1, 0)], "day string, field string, token string, doc_id long, row_index int")
    got = index.cap(df, 10).collect()
    assert sorted(r.doc_id for r in got if r.token == "hot") == list(range(10)) and len(got) == 11


@pytest.mark.parametrize(("precision", "kept"), [(0, 0), (5, 0), (10, 10), (100, 1)])
def test_sample_listed(spark, precision, kept):
    df = spark.createDataFrame([("f", t, i, 0) for i in range(100) for t in ("listed", "free")], "field string, token string, doc_id long, row_index int")
    got = index.sample_listed(df, spark.createDataFrame([("listed",)], "token string"), precision).collect()
    assert (sum(r.token == "listed" for r in got), sum(r.token == "free" for r in got)) == (kept, 100)


def test_formats(spark):
    line = lambda value, config, name: spark.range(1).select(fields.values(F.lit(value), config, name).alias("x")).first().x
    kv_config = IndexConfig("b", "KV", tokenizers={"k": WORDS})
    assert line("<k=a> <j=b><k=c>", kv_config, "k") == ["a", "c"]
    json_config = IndexConfig("b", "JSON")
    assert line('{"a": {"b": [1, 2]}}', json_config, "a.b") == ["[1,2]"]
    assert line('{"a": null}', json_config, "a") == line("no json", json_config, "a") == line('{"a": 1}', json_config, "a.b") == []
    assert line("x\ty", CONFIG, "kind") == ["y"] and line("x", CONFIG, "kind") == []


def test_alias_and_long_lines(spark):
    config = IndexConfig("b", "TAB", ("a", "b"), {"a": WORDS, "b": WORDS}, {"a": "z", "b": "z"}, longest_line=10)
    got = index.tokens(numbered(spark, ["q\tq", "long enough\tto go"]), config).collect()
    assert [(r.field, r.token) for r in got] == [("z", "q")] * 2


def test_config():
    text = """{"common": {"bussiness": "b{host}", "line_per_doc": 64, "indexgzmeta_section": "100",}, "inverted_index": {"data_format": "XML", "field_names": ["t"],
        "tokenizer": {"t": ["keyword", {"split": ","}]}, "alias": {"t": "u"}}}"""
    config = IndexConfig.from_json(text, {"host": "1"})
    assert (config.business, config.format, config.lines_per_doc, config.shard_width, config.output_field("t")) == ("b1", "TAB", 64, 100, "u")
    assert config.tokenizers["t"] == (Step("keyword"), Step("split", ",")) and steps("ip") == (Step("ip"),)
    with pytest.raises(ValueError):
        IndexConfig("")
    with pytest.raises(ValueError):
        IndexConfig("b", "TAB", (), {"t": WORDS})


def test_request():
    r = SearchRequest.from_json('{"query": {"business": "b", "days": ["2024-01-01", ""], "page_size": 5, "page_number": 2, "keywords": {"f": "A\\tb"}, "options": {"pv_only": 1, "filter": "x"}}}')
    assert (r.days, r.begin, r.pv_only, r.where) == (("2024-01-01",), 10, True, "x")
    assert search.terms(r.keywords) == [("f", "a"), ("f", "b")]
    for bad in ("{}", '{"query": {"keywords": 3}}', '{"query": {"keywords": {}, "business": "b"}}'):
        with pytest.raises(ValueError):
            SearchRequest.from_json(bad)


def test_engine(spark, tmp_path):
    engine = Engine(spark, CONFIG, str(tmp_path))
    after = engine.ingest(spark.createDataFrame([(1, "\n".join(LINES)), (2, "the cat\tA\n")], "file_id long, text string"), "2024-01-01")
    assert after == 4
    engine.build_index("2024-01-01")
    request = SearchRequest("b", {"text": "the\tCAT"}, ("2024-01-01", "2024-01-02"), 2)
    counts, page = engine.search(request)
    assert [(r.total, r.pv, r.uv) for r in counts.collect()] == [(3, 3, 3)]
    assert sorted(r.line for r in page.collect()) == ["the cat\tA", "the-cat,dog\tB\tC"]
    body = json.loads(engine.responses(request).first().response)
    assert body["hits"]["total"] == 3 and len(body["hits"]["hits"]) == 2
    one, none = engine.search(SearchRequest("b", {"kind": "a"}, ("2024-01-01",), pv_only=True))
    assert [(r.total, r.pv, r.uv) for r in one.collect()] == [(3, 3, 0)] and none is None
    _, filtered = engine.search(SearchRequest("b", {"text": "the"}, ("2024-01-01",), where="line like '%B%'"))
    assert filtered.count() == 2
    engine.put("doc", spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, seq long"))
    got = {r.key: r.value for r in engine.get("doc", spark.createDataFrame([("k",), ("none",)], "key string")).collect()}
    assert got == {"k": "Mg==", "none": ""}


def test_ids(spark):
    asked = spark.createDataFrame([("b", "20240101", 1, 3), ("b", "20240101", 2, 0), ("b", "20240101", 3, None), ("c", "20240101", 1, 5)], "business string, day string, seq long, count long")
    got = {(r.business, r.seq): (r.start_index, r["count"]) for r in ids.allocate(asked).collect()}
    assert got == {("b", 1): (0, 3), ("b", 2): (3, 1), ("b", 3): (4, 1), ("c", 1): (0, 5)}
    mark = ids.new_high_water(ids.allocate(asked))
    again = ids.allocate(asked.where("business = 'c'"), mark).first()
    assert again.start_index == 5
    with pytest.raises(Exception, match="business"):
        ids.allocate(spark.createDataFrame([(None, "d", 1, 1)], "business string, day string, seq long, count long")).collect()


def test_kv(spark):
    store = spark.createDataFrame([(f"pos{i}", str(i), 1) for i in range(6)], "key string, value string, seq long")
    changed = kv.upsert(store, spark.createDataFrame([("pos0", "9", 2), ("new", "n", 1)], "key string, value string, seq long"))
    assert {r.key: r.value for r in changed.collect()}["pos0"] == "9" and changed.count() == 7
    assert kv.get(changed, "pos0").first().value == "9" and kv.get(changed, "zz").count() == 0
    assert kv.delete(changed, spark.createDataFrame([("pos1",)], "key string")).count() == 6
    good = spark.createDataFrame([("a\tMQ==",), ("b Mg==",), ("",)], "line string")
    assert sorted((r.key, r.value) for r in kv.parse_set(good).collect()) == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="malformed"):
        kv.parse_set(good.unionByName(spark.createDataFrame([("broken",)], "line string"))).collect()
    stores = kv.Stores()
    stores.register("doc", "b", store)
    assert stores["doc", "b"] is store
    with pytest.raises(KeyError):
        stores["index", "b"]
    with pytest.raises(ValueError):
        stores.register("other", "b", store)


def test_numbering_by_prefix_sums(spark):
    counts = spark.createDataFrame([(i, i % 5) for i in range(50)], "k long, n long")
    got = ids.starts(counts, "k", "n", F.expr("k div 7")).orderBy("k").collect()
    total = 0
    for r in got:
        assert r.start == total
        total += r.n
    begun = documents.number_documents(spark.createDataFrame([(1, 7), (2, 3)], "k long, n_lines long"), "k", 3, F.lit(0), 100)
    assert [(r.n_docs, r.begin) for r in begun.orderBy("k").collect()] == [(3, 100), (1, 103)]


def test_a_lookup_prunes(spark, tmp_path):
    postings = index.tokens(numbered(spark, LINES), CONFIG).select(F.lit("b").alias("business"), F.lit("2024-01-01").cast("date").alias("day"), "*")
    index.write(postings, str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p")).where("business = 'b' and day = date'2024-01-01'")

    def filters(df):
        scan = df._jdf.queryExecution().optimizedPlan().collectLeaves().head()
        physical = df._jdf.queryExecution().sparkPlan().collectLeaves().head()
        return physical.partitionFilters().mkString(" "), physical.dataFilters().mkString(" "), scan

    partition, data, _ = filters(search.hits(stored, [("text", "the")], "day"))
    assert "field" in partition and "token" in data
    found = search.hits(stored, [("text", "the"), ("kind", "a")], "day")
    partition, data, _ = filters(found)
    assert "field" in partition and "OR" in partition and "token" in data
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_hot_token_is_several_files(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("text").alias("field"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("w"), "id")).otherwise("the").alias("token"), F.col("id").alias("doc_id"), F.lit(0).alias("row_index"))
    index.write(rows, str(tmp_path / "p"), 6)
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert stored.where("token = 'the'").select(F.input_file_name()).distinct().count() >= 3
    assert stored.count() == 4000


def test_engine_by_batch(spark, tmp_path):
    day, frame = "2024-01-01", lambda *rows: spark.createDataFrame(rows, "file_id long, text string")
    engine = Engine(spark, IndexConfig("b", "TAB", ("text",), {"text": WORDS}, lines_per_doc=2), str(tmp_path))
    pv = lambda: {r.token: r.pv for r in engine.stats().collect()}
    assert engine.ingest(frame((1, "the cat\nthe dog\nthe end")), day, "one") == 2
    engine.build_index(day)
    assert engine.ingest(frame((1, "the cat\nthe dog\nthe end")), day, "one") == 2  # again
    engine.build_index(day)
    assert pv()["the"] == 3
    assert engine.ingest(frame((9, "the fox"), (10, None)), day, "two") == 3
    engine.build_index(day)
    engine.build_index(day, again=True)
    assert pv()["the"] == 4 and pv()["fox"] == 1
    with pytest.raises(ValueError, match="batch"):
        engine.ingest(frame((1, "one line")), day, "one")
    counts, page = engine.search(SearchRequest("b", {"text": "The"}, (day,)))
    assert sorted((r.doc_id, r.line) for r in page.collect()) == [(0, "the cat"), (0, "the dog"), (1, "the end"), (2, "the fox")]
    assert [(r.total, r.pv) for r in counts.collect()] == [(4, 4)]
    for words in ("the\t--", "the\tnone", "--"):
        counts, page = engine.search(SearchRequest("b", {"text": words}, (day,)))
        assert counts.count() == page.count() == 0
    assert engine.shards(day).agg(F.sum("length")).first()[0] > 0
    found = lambda word: engine.search(SearchRequest("b", {"text": word}, (day,)))[1].count()
    engine.ingest(frame((9, "a wolf"), (10, None)), day, "two")  # other lines, as many documents
    engine.build_index(day)
    assert pv() == {"the": 3, "cat": 1, "dog": 1, "end": 1, "a": 1, "wolf": 1} and found("wolf") == 1 and found("fox") == 0
    engine.ingest(frame((9, "---"), (10, None)), day, "two")  # no token at all
    engine.build_index(day)
    assert found("wolf") == 0 and pv() == {"the": 3, "cat": 1, "dog": 1, "end": 1}
    engine.ingest(frame((9, "the fox"), (10, None)), day, "two")
    engine.build_index(day)
    rows = lambda *fields: spark.createDataFrame([("b", datetime.date(2024, 1, 2), f, "t", 1, 0) for f in fields], "business string, day date, field string, token string, doc_id long, row_index int")
    engine.merge_index(rows("x", "y"), "m")
    engine.merge_index(rows("x"), "m")  # y is gone
    assert {r.field for r in engine.stats().where("token = 't'").collect()} == {"x"} and engine._table("postings").where("token = 't'").count() == 1
    assert not list(tmp_path.glob("_aside/*"))
    engines = Engines(engine)
    assert engines.search(SearchRequest("b", {"text": "fox"}, (day,)))[1].count() == 1
    with pytest.raises(KeyError):
        engines.search(SearchRequest("c", {"text": "fox"}, (day,)))


def test_terms_keep_their_case(spark, tmp_path):
    engine = Engine(spark, IndexConfig("b", "TAB", ("u",), {"u": (Step("urlencode"),)}), str(tmp_path))
    engine.ingest(spark.createDataFrame([(1, "É")], "file_id long, text string"), "2024-01-01")
    engine.build_index("2024-01-01")
    assert engine.search(SearchRequest("b", {"u": "É"}, ("2024-01-01",)))[1].first().line == "É"


def test_more_terms_than_bits(spark):
    rows = spark.createDataFrame([(1, 0, "f", f"w{i}") for i in range(130)] + [(2, 0, "f", f"w{i}") for i in range(129)], "doc_id long, row_index int, field string, token string")
    wanted = [("f", f"w{i}") for i in range(130)]
    assert [r.doc_id for r in search.hits(rows, wanted).collect()] == [1]


def test_dumps_are_read_row_by_row(spark):
    rows = spark.createDataFrame([("t\tf\t1,0;2,1\t2",), ("t\tf\t10,0;5,0\t2",), ("short\tf",)], "value string")
    assert sorted([(p.doc_id, p.row_index) for p in r.postings] for r in index.parse_text_rows(rows).collect()) == [[(1, 0), (3, 1)], [(10, 0), (15, 0)]]


def test_filter_files_of_the_configuration(spark):
    text = '{"common": {"business": "b"}, "inverted_index": {"data_format": "TAB", "field_names": ["t"], "tokenizer": {"t": [{"split": " "}, {"tokenfilter": "stop.txt"}]}}}'
    config = IndexConfig.from_json(text, filters={"stop.txt": ["the"]})
    assert config.token_filters == {"t": ("the",)}
    assert [r.token for r in index.tokens(numbered(spark, ["the cat"]), config).collect()] == ["cat"]


def test_a_long_row_is_parsed_in_proportion_to_its_length(spark, monkeypatch):
    n = 400_000
    rows = spark.createDataFrame([("hot\tf\t" + ";".join(f"1,{i % 7}" for i in range(n)) + f"\t{n}",), ("cold\tf\t5,1;-3,2;4;0,9,9\t4",)], "value string")
    began = time.monotonic()
    got = {r.token: r for r in index.parse_text_rows(rows).select("token", F.size("postings").alias("n"), F.element_at("postings", -1).alias("last"), F.slice("postings", 1, 4).alias("first")).collect()}
    assert time.monotonic() - began < 60
    assert got["hot"].n == n and tuple(got["hot"].last) == (n, (n - 1) % 7)
    assert [tuple(p) for p in got["cold"].first] == [(2, 2), (5, 1), (6, None), (6, 9)]
    monkeypatch.setattr(index, "PIECE", 10)
    texts = pa.record_batch({"field": ["f"] * 3, "token": ["a", "b", "c"], "pv": [1, 12, 1], "steps": ["1,1", ";".join(["1,0"] * 12), "2,2"]})
    found = [p for b in index._parse([texts]) for p in b.column("postings").to_pylist()]
    assert [[(x["doc_id"], x["row_index"]) for x in p] for p in found] == [[(1, 1)], [(i, 0) for i in range(1, 13)], [(2, 2)]]


def test_postings_are_made_once_when_they_are_stored(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(2000).select(F.lit("f").alias("field"), F.expr("concat('w', id % 50)").alias("token"), F.col("id").alias("doc_id"), F.lit(0).alias("row_index"))
    index.write(rows.mapInArrow(count, rows.schema), str(tmp_path / "p"))
    assert made.value == 2000 and spark.read.parquet(str(tmp_path / "p")).count() == 2000
