"""The trained pipeline behind the scorer contract."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.catalog import QUERIES
from tidings.operators.pipeline_scorer import PipelineScorer
from tidings.operators.score import analyze

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    good, bad, rest = ["profit", "growth", "wins"], ["loss", "probe", "weak"], [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(rng.choice(rest, 10)) + list(rng.choice(good if i % 2 else bad, 2))
        rows.append((" ".join(rng.permutation(words)), i % 2))
    df = spark.createDataFrame(rows + [(None, 1), ("profit", None)], "t string, y int")
    scorer = PipelineScorer.train(df, "t", "y", max_chars=None, features=1 << 10)
    path = str(tmp_path_factory.mktemp("model"))
    scorer.save(path)
    return scorer, path


def test_loaded_scores_equal_the_trained_ones_and_follow_the_contract(spark, headlines, trained):
    scorer, path = trained
    df = headlines([(1, "Profit and growth w1"), (2, "weak LOSS w2"), (3, None), (4, ""), (5, "zzz " * 3000 + "profit wins")])
    loaded = PipelineScorer.load(spark, path)
    a, b = ({r.doc_id: r.s for r in s.add(df, "Headline", "s").collect()} for s in (scorer, loaded))
    assert a == b and loaded.classes == ("negative", "positive") and loaded.max_chars is None
    assert a[1].positive > 0.8 and a[2].negative > 0.8 and a[5].positive > 0.5
    assert all(abs(sum(r[:3]) - 1) < 1e-9 and r.score_error is None for r in a.values())
    assert tuple(a[3][:3]) == (0.0, 0.0, 1.0)
    chain = {r.doc_id: r for r in analyze(df.withColumn("kept", F.lit(7)), scorer=loaded).collect()}
    assert chain[1].sentiment == "Positive" and chain[2].sentiment == "Negative" and chain[3].sentiment == "Neutral" and chain[1].kept == 7


def test_scores_from_the_saved_coefficients_in_sql(spark, trained):
    """The saved parquet files alone, in DuckDB: tf * idf, unit length, logistic."""
    scorer, path = trained
    texts = ["profit growth w1 w2 w2", "loss weak w3", "w1 w2 w3 profit probe", "unknown words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.s.positive for r in scorer.add(df, "t", "s").collect()}
    hashing = scorer.model.stages[1]
    terms = sorted({w for t in texts for w in t.split()})
    con = duckdb.connect()
    con.execute("CREATE TABLE bucket(term VARCHAR, b INTEGER)")
    con.executemany("INSERT INTO bucket VALUES (?, ?)", [(w, hashing.indexOf(w)) for w in terms])
    con.execute("CREATE TABLE texts(id INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(texts)))
    idf = spark.read.parquet(f"{path}/model/stages/2_*/data").first()["idf"].toArray()
    lr = spark.read.parquet(f"{path}/model/stages/4_*/data").first()
    weights, offset = lr["coefficientMatrix"].toArray()[0], float(lr["interceptVector"].toArray()[0])
    con.execute("CREATE TABLE w(b INTEGER, idf DOUBLE, w DOUBLE)")
    con.executemany("INSERT INTO w VALUES (?, ?, ?)", [(b, float(idf[b]), float(weights[b])) for b in {hashing.indexOf(x) for x in terms}])
    rows = con.sql(f"""
        WITH tf AS (SELECT id, b, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM texts)
                    JOIN bucket USING (term) GROUP BY ALL),
        x AS (SELECT id, sum(n * idf * w) AS dot, sqrt(sum((n * idf) * (n * idf))) AS length FROM tf JOIN w USING (b) GROUP BY id)
        SELECT id, 1 / (1 + exp(-(CASE WHEN length = 0 THEN 0 ELSE dot / length END + {offset}))) FROM x""").fetchall()
    assert len(rows) == 4 and all(math.isclose(p, got[i], abs_tol=1e-9) for i, p in rows)


def test_three_classes_and_unknown_names(spark):
    rows = [(w, y) for w, y in (("up up", 0), ("down", 1), ("same", 2), ("up", 0), ("down down", 1), ("same same", 2))] * 4
    df = spark.createDataFrame(rows, "t string, y int")
    scorer = PipelineScorer.train(df, "t", "y", classes=("positive", "negative", "neutral"), features=64)
    got = {r.t: r.s for r in scorer.add(df.distinct(), "t", "s").collect()}
    assert got["up"].positive > 0.6 and got["down"].negative > 0.6 and got["same"].neutral > 0.6
    with pytest.raises(ValueError):
        PipelineScorer(scorer.model, ("good", "bad"))


def test_held_out_accuracy_on_the_labels(spark):
    rows = QUERIES["pipeline_scores"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["neutral"] == 0.0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = np.mean([(r["positive"] > 0.5) == bool(r["quality"]) for r in held])
    often = max(np.mean([r["quality"] for r in held]), 1 - np.mean([r["quality"] for r in held]))
    good, bad = ([r["positive"] for r in held if bool(r["quality"]) == q] for q in (True, False))
    ordered = np.mean([a > b for a in good for b in bad])
    assert len(held) > 50 and right > often and right > 0.88 and ordered > 0.8
