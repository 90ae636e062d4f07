"""The pipeline's stages one by one, on planted documents."""

import os
import random
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.conftest import ODD
from tracewell import session
from tracewell.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        rows.append((i, prose(60) + (" you scoundrel " if bad else " ") + prose(60)))
        labels.append((i, 1, int(bad)))
    passage = prose(60)
    rows += [(200, rows[1][1]), (201, rows[2][1] + " tail"), (202, prose(50) + " " + passage), (203, passage + " " + prose(50)), (204, prose(40) + " mail me at some.one@mail.example.com now")]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, planted, tmp_path):
    folder, rows = planted
    docs, texts = spark.read.parquet(f"{folder}/documents.parquet"), dict(rows)
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == COLUMNS, name
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        kept.append({r.doc_id: r for r in docs.collect()})
    assert kept[0].keys() == {d for d, t in rows if "scoundrel" not in t}
    assert kept[1].keys() == kept[0].keys() - {200, 201}
    assert kept[2].keys() == kept[1].keys()
    expected = plain.substring([(d, texts[d]) for d in kept[1]])
    assert {d: len(plain.words(r.text)) for d, r in kept[2].items()} == {d: n - gone for d, (n, gone, _) in expected.items()}
    assert expected[203][1] >= 60
    assert "some.one@" not in kept[3][204].text and kept[3][1].text == texts[1]
    assert kept[4].keys() == kept[3].keys()


def test_run(spark, planted, tmp_path, monkeypatch):
    """The stages one after the other, and no more left behind than the last one reads."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, planted[0])
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, planted[0]), "stage")
    expected = corpus_pipeline.STAGES[-1][1](spark, docs, planted[0])
    pieces = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(out) == pieces(expected)
    assert sum(name.startswith("pipeline-") for name in os.listdir(tmp_path)) == 1


def test_shuffle_files_go_with_what_is_stored(spark):
    """They don't wait for the driver to collect its memory; the session's setting comes back."""
    files = lambda: {n for n in disk.getAllBlocks().mkString("\n").split("\n") if n.startswith("shuffle_")}
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), files()
    held = spark.range(1000).repartition(5, "id").groupBy(F.expr("id % 7")).count()
    stored = common.materialise(held, "held")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(key) == setting
    assert stored.count() == held.count() == 7


@pytest.mark.parametrize("number", range(5))
def test_a_stage_on_odd_tables(spark, planted, odd, repeated, empty, number):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, no rows."""
    name, stage = corpus_pipeline.STAGES[number]
    nothing = spark.createDataFrame([(None,) * 5], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, repeated, empty, nothing):
        out = stage(spark, df, planted[0])
        rows = out.collect()
        if number < 4:
            assert out.columns == df.columns, name
            assert len(rows) <= df.count()
        if df is empty:
            assert not rows
        elif df is odd:
            assert {r.doc_id for r in rows} == {d for d, _ in ODD}
        elif df is nothing:
            assert [r.doc_id for r in rows] == [None]
        elif number in (0, 2, 3):
            assert len(rows) == 25
