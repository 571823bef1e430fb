"""What the pipeline's Python workers hold follows neither the rows of an input split nor the words of a stage."""

import pyarrow as pa
import pytest

import corpus_pipeline as c
from cairn.llm import bpe, mixing, shared
from cairn.llm.queries import vocabulary

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def fresh(spark):
    before = spark.conf.get(shared.ROWS_SETTING, None)
    spark.conf.unset(shared.ROWS_SETTING)
    yield spark
    spark.conf.unset(shared.ROWS_SETTING) if before is None else spark.conf.set(shared.ROWS_SETTING, before)


def most_rows(df) -> int:
    """The rows of the largest batch that reaches a Python worker."""

    def run(text):
        return [pa.array([len(text)] * len(text), pa.int32())]

    return shared.carried(df, run, {"rows": "int"}).agg({"rows": "max"}).first()[0]


def test_every_stage_hands_few_rows_at_a_time(fresh, sf):
    rows = [(i, f"word{i} and some words of text number {i}", "en", f"s{i % 2}", 10) for i in range(3000)]
    docs = fresh.createDataFrame(rows, DDL).coalesce(1)
    for _, stage in c.STAGES:
        fresh.conf.unset(shared.ROWS_SETTING)
        stage(fresh, docs, sf)
        assert most_rows(docs) <= shared.BATCH_ROWS
    fresh.conf.set(shared.ROWS_SETTING, "700")  # a size of the session's own stays
    c.bpe_tokens(fresh, docs, sf)
    assert shared.BATCH_ROWS < most_rows(docs) <= 700


def test_rows_do_not_depend_on_the_batches(fresh):
    docs = fresh.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(2)
    found = []
    for rows in ("10000", "7"):
        fresh.conf.set(shared.ROWS_SETTING, rows)
        found.append([sorted(map(str, stage(fresh, docs, "/root/testdata/sf0.001").collect())) for _, stage in c.STAGES])
    assert found[0] == found[1]


def test_a_small_table_of_words_gives_the_same_ids(monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    large, small = bpe.ByteBPE(path), bpe.ByteBPE(path, 50)
    for k in range(6):
        texts = [f"common words w{k * 40 + i}x{i}" for i in range(40)]
        a, b = large.encode_batch(texts), small.encode_batch(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        assert len(small.table) <= 50 + 3 * 40 + 2
    assert len(large.table) > len(small.table)


def test_factors_of_languages_need_no_python_worker(spark, monkeypatch):
    """Local rows from a list go through Python workers of their own, which stay beside the others."""
    docs = spark.createDataFrame([(i, f"letters word{i % 9}", (None, "en", "de")[i % 3], "s", 9) for i in range(60)], DDL)
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(type(data)) or create(self, data, *a, **b))
    assert mixing.mix(docs).count() == 60
    assert made == [pa.Table]
