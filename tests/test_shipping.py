"""Package and weights sent to workers that have neither."""

import os
import subprocess
import sys

import pytest

from tidings.operators.scorers import ModelScorer, lexicon_from_weights, lexicon_model_loader, save_lexicon_weights
from tidings.shipping import Weights, ship_package, ship_weights, weights_loader

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

FOREIGN = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[3])
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
sys.path.append(sys.argv[1])  # of the driver alone
import tidings
from tidings.operators.scorers import ModelScorer, lexicon_from_weights
tidings.ship_package(spark)
weights = tidings.ship_weights(spark, sys.argv[2])
df = spark.createDataFrame([(1, "record profit"), (2, "weak loss"), (3, None)], "doc_id long, Headline string")
model = ModelScorer(tidings.weights_loader(weights, lexicon_from_weights))
rows = tidings.score(df, scorer=model).orderBy("doc_id").collect()
print("GOT", [(r.sentiment, round(r.positive, 6), r.score_error) for r in rows])
print("WORDS", [len(r.env_phi or []) for r in tidings.attribute_sampled(df, permutations=2).orderBy("doc_id").collect()])
spark.stop()
"""


def test_a_session_in_a_foreign_folder(tmp_path):
    folder, work = tmp_path / "weights", tmp_path / "elsewhere"
    folder.mkdir(), work.mkdir()
    save_lexicon_weights(str(folder))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FOREIGN, REPO, str(folder), str(work)], cwd=work, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "GOT [('Positive', 0.666667, None), ('Negative', 0.0, None), ('Neutral', 0.0, None)]" in done.stdout
    assert "WORDS [2, 2, 0]" in done.stdout


def test_shipping_twice_sends_once_and_models_agree(spark, headlines, tmp_path):
    save_lexicon_weights(str(tmp_path))
    first, again = ship_weights(spark, str(tmp_path)), ship_weights(spark, str(tmp_path))
    assert first == again and first.folder
    assert ship_package(spark) == ship_package(spark)
    assert len([f for f in spark.sparkContext.listFiles if first.name in f]) == 1
    df = headlines([(i, t) for i, t in enumerate(["record profit", "weak loss loss", "", None])])
    shipped = ModelScorer(weights_loader(first, lexicon_from_weights)).expr("Headline")
    plain = ModelScorer(lexicon_model_loader(fail_on=None)).expr("Headline")
    for r in df.select(shipped.alias("a"), plain.alias("b")).collect():
        assert r.a == r.b


def test_a_single_file_and_a_wrong_sum(spark, headlines, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("profit")
    weights = ship_weights(spark, str(path))

    def build(name):
        word = open(name).read()
        return lambda texts: [{"label": "positive", "score": float(word in t)} for t in texts]

    df = headlines([(1, "record profit"), (2, "x")])
    rows = df.select("doc_id", ModelScorer(weights_loader(weights, build)).expr("Headline").alias("s")).collect()
    assert {r.doc_id: r.s.positive for r in rows} == {1: 1.0, 2: 0.0}
    wrong = Weights(weights.name, "0" * 64, False)
    with pytest.raises(Exception, match="SHA-256"):
        df.select(ModelScorer(weights_loader(wrong, build)).expr("Headline").alias("s")).collect()
