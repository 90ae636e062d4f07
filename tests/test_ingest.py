"""Sources, windows and streams."""

import datetime
import gzip

import pytest

from tracewell.operators import documents
from tracewell.sources import files
from tracewell.sources.registry import new_files_table
from tracewell.streaming.ingest import append_batches, counters, flush_windows, once, stream_index, windowed_files


def test_messages(spark):
    long_path = "/data/logs/somewhere/file.gz"
    body = f"{long_path}\nid1\thost\t {long_path} \n\thost\t{long_path}\na\tb\nshort\n"
    got = documents.parse_messages(spark.createDataFrame([(body,)], "message string"), "bj").collect()
    assert [(r.id, r.content, r.path) for r in got] == [(":" + long_path, "bj", long_path), ("id1", "bj", long_path), ("host:" + long_path, "bj", long_path)]


def listed(spark, rows):
    return spark.createDataFrame([(f"/l/info.2024-01-01-{h:02}-{m:02}.{i}", size, "x") for i, (h, m, size) in enumerate(rows)], "path string, size long, idc string")


def test_gather_and_due(spark):
    rows = listed(spark, [(1, 0, 5), (1, 14, 5), (1, 15, 7), (1, 1, 0)])
    got = documents.gather(rows, 15).orderBy("window").collect()
    assert [(r.window.minute, r.files, r.bytes) for r in got] == [(0, 2, 10), (15, 1, 7)]
    from pyspark.sql import functions as F

    now = F.lit("2024-01-01 01:30:00").cast("timestamp")
    assert [r.window.minute for r in documents.due(documents.gather(rows, 15), now, 30).collect()] == [0]
    for bad in (0, 7, 60):
        with pytest.raises(ValueError):
            documents.gather(rows, bad)


def test_flush_by_size(spark):
    rows = listed(spark, [(1, i, s) for i, s in enumerate([4, 4, 4, 12, 1, 9, 1])])
    got = documents.flush_by_size(rows, 60, 10).orderBy("path").collect()
    assert [r.flush for r in got] == [0, 0, 0, 1, 2, 2, 3]


def test_lines_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\n\nthree")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"four\n") + gzip.compress(b"five"))
    (tmp_path / "empty").write_bytes(b"")
    got = sorted((r.path[-5:], r.line) for r in files.read_lines(spark, f"{tmp_path}/*,").collect())
    assert got == [("/b.gz", "five"), ("/b.gz", "four"), ("a.txt", ""), ("a.txt", "one\r"), ("a.txt", "three"), ("a.txt", "two")]
    whole = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_files(spark, str(tmp_path)).collect()}
    assert whole == {"a.txt": "one\r\ntwo\n\nthree", "b.gz": "four\nfive"}
    lines = documents.lines_of(spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, "x")], "k long, t string"), "k", "t")
    assert sorted((r.k, r.n, r.line) for r in lines.collect()) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, ""), (3, 0, "x")]


def test_ranges(spark, tmp_path):
    files.write_bytes(spark, f"{tmp_path}/f.gz", gzip.compress(b"first") + b"broken")
    n = len(gzip.compress(b"first"))
    asked = [("f.gz", 0, n), ("f.gz", n, 6), ("f.gz", n, 99), ("g", 0, 1), ("f.gz", -1, 2)]
    ranges = spark.createDataFrame([(f"file://{tmp_path}/{f}", a, b) for f, a, b in asked], "path string, offset long, length long")
    got = files.read_ranges(ranges, unpack=True).collect()
    assert {(r.path.rsplit("/", 1)[1], r.offset, r.length, r.content and bytes(r.content), r.error) for r in got} == {
        ("f.gz", -1, 2, None, "range beyond the end"), ("f.gz", 0, n, b"first", None), ("f.gz", n, 6, None, None), ("f.gz", n, 99, None, "range beyond the end"), ("g", 0, 1, None, "no such file"),
    }


def test_gz_documents_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, d, r, f"line {d} {r}") for d in range(3) for r in range(4)], "file_id long, doc_id long, row_index int, line string")
    docs = documents.gz_documents(documents.documents(lines, "file_id"), "file_id").orderBy("doc_id").collect()
    stored = b"".join(bytes(r.member) for r in docs)
    for r in docs:
        assert gzip.decompress(stored[r.offset : r.offset + r.length]).decode().split("\n")[2] == f"line {r.doc_id} 2"


def test_stream_is_the_batch(spark, tmp_path):
    rows = listed(spark, [(h, m, 10) for h in range(3) for m in range(0, 60, 7)])
    rows.repartition(5).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        append_batches(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.path for r in got.collect()) == sorted(r.path for r in rows.collect())


def test_windows_come_by_watermark(spark, tmp_path):
    first, later = listed(spark, [(1, 0, 5), (1, 3, 5), (1, 40, 7)]), listed(spark, [(3, 0, 1), (1, 1, 50)])
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(first.schema).json(str(tmp_path / "in"))
    query = lambda: windowed_files(stream, 15, 25).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    for batch in (first, later):
        batch.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query().awaitTermination()
    got = {(r.window, r.files, r.bytes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (datetime.datetime(2024, 1, 1, 1, 0), 2, 10) in got  # the late file is left out


def test_once(spark, tmp_path):
    rows = listed(spark, [(1, 0, 5)])
    rows.unionByName(rows).write.json(str(tmp_path / "in"))
    stream = once(spark.readStream.schema(rows.schema).json(str(tmp_path / "in")), 10)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_index(spark, tmp_path):
    from tests.test_index import CONFIG, LINES, numbered
    from tracewell.operators.index import tokens

    lines = numbered(spark, LINES)
    lines.repartition(2).write.parquet(str(tmp_path / "in"))
    stream_index(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == tokens(lines, CONFIG).count()


def test_late_files_reach_a_further_output(spark, tmp_path):
    batches = [[(1, 0, 5), (1, 3, 5), (1, 20, 7)], [(3, 0, 1)], [(1, 1, 50), (3, 1, 2)], [(5, 0, 1)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("path string, size long, idc string").json(str(tmp_path / "in"))
    for rows in batches:
        listed(spark, rows).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = flush_windows(stream, str(tmp_path / "flushed"), str(tmp_path / "mark"), 15, 30)
        query.awaitTermination()
    assert counters(query)[0][1] == 1
    got = sorted((r.batch, r.window.hour, r.window.minute, r.files, r.bytes) for r in spark.read.parquet(str(tmp_path / "flushed/out")).collect())
    assert got == [(1, 1, 0, 2, 10), (1, 1, 15, 1, 7), (2, 1, 0, 1, 50), (3, 3, 0, 2, 3)]
    with pytest.raises(ValueError):
        flush_windows(stream, "", "", 15, 10)


def test_checkpoint_after_every_file(spark):
    files = spark.createDataFrame([("d", "a"), ("d", "b")], "dir string, name string")
    assert new_files_table(files, "a").count() == 1
    with pytest.raises(Exception, match="later than every file"):
        new_files_table(files, "c").collect()


def test_rezip_sends_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        files = spark.createDataFrame([("a", b"x")], "path string, content binary")
        assert documents.rezip(files, zip=True, unzip=False).first().path == "a.gz"
        assert spark.conf.get(key) == str(8 * 1024 * 1024)
        spark.conf.set(key, "1000")
        documents.rezip(files, zip=True, unzip=False)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, held)
