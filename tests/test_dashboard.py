"""Live means and histograms against the batch reports."""

import os

import pytest
from pyspark.sql import functions as F

from tidings.operators import reports as R
from tidings.operators.score import analyze
from tidings.sources.news import news_from_documents
from tidings.streaming import dashboard as D
from tidings.streaming.live import document_stream, score_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, tmp_path):
    """The documents as a folder of part files; more can be added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "data" / "documents.parquet")

    def add(low, high):
        docs.filter(F.col("doc_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)

    return str(tmp_path / "data"), add


def _round(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def _same_as_batch(spark, data, state):
    batch = analyze(news_from_documents(spark.read.parquet(f"{data}/documents.parquet")))
    states = D.read_state(spark, state)
    assert _round(D.state_summary(states).collect()) == _round(R.summary_metrics(batch).collect())
    assert _round(D.state_histogram(states).collect()) == _round(R.materiality_histogram(batch).collect())


def _run(spark, data, state, checkpoint):
    scored = score_stream(news_from_documents(document_stream(spark, data, 1)))
    query = D.start_dashboard(scored, state, checkpoint)
    query.awaitTermination()
    assert query.exception() is None


def test_several_files_with_moving_bounds_equal_the_batch_reports(spark, folder, tmp_path):
    data, add = folder
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "ckpt")
    for low, high in ((0, 40), (40, 41), (41, 120)):
        add(low, high)
    _run(spark, data, state, checkpoint)
    assert len([n for n in os.listdir(state) if n.startswith("batch=")]) == 3
    _same_as_batch(spark, data, state)
    add(120, 200)  # a later start goes on where the last stopped
    _run(spark, data, state, checkpoint)
    _same_as_batch(spark, data, state)


def test_a_merged_state_is_continued(spark, folder, tmp_path):
    data, add = folder
    state, target, checkpoint = str(tmp_path / "state"), str(tmp_path / "merged"), str(tmp_path / "ckpt")
    add(0, 90)
    _run(spark, data, state, checkpoint)
    D.merge_state(spark, state, target)
    add(90, 200)
    _run(spark, data, target, checkpoint)
    _same_as_batch(spark, data, target)


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    state = str(tmp_path / "state")
    rows = spark.createDataFrame([(True, 0.5, 0.1), (False, 0.25, -0.2), (None, None, None), (True, float("nan"), 0.3)],
                                 "esg_flag boolean, materiality_score double, cumulative_score double")
    for _ in range(2):
        D.state_of(rows).write.mode("overwrite").parquet(f"{state}/batch=0")
    assert _round(D.state_summary(D.read_state(spark, state)).collect()) == _round(R.summary_metrics(rows).collect())


def test_rounding_bounds_the_state_and_an_empty_one_reports(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 2 == 0).alias("esg_flag"), (F.col("id") / 5000.0).alias("materiality_score"),
                                    F.lit(0.5).alias("cumulative_score"))
    state = D.state_of(rows, digits=2)
    assert state.count() <= 202 and state.agg(F.sum("n")).first()[0] == 5000
    empty = D.state_of(rows.filter("false"))
    got = D.state_summary(empty).first()
    assert got.total_headlines == 0 and got.avg_materiality_score is None and D.state_histogram(empty).count() == 0
