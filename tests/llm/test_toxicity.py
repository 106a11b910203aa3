"""Toxicity: features against plain loops, counterfactual penalty, held-out accuracy, edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidings.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def plain_logit(model, text):
    """The worst word's logit by loops over words and grams."""
    worst = 0.0
    for word in text.translate(T._FOLD).split():
        code = 0
        for i, b in enumerate(word):
            code = (code + int(T._BYTE[b]) * pow(T._BASE, i, 1 << 64)) % (1 << 64)
        buckets = [int(T.mix64(np.array([(code + len(word)) % (1 << 64)], np.uint64))[0]) >> (64 - T.BITS)]
        padded = b" " + word + b" "
        for n in (3, 4, 5):
            for i in range(len(padded) - n + 1):
                v = np.array([int.from_bytes(padded[i:i + n], "little")], np.uint64) * T._SALT + np.uint64(n)
                buckets.append(int(T.mix64(v)[0]) >> (64 - T.BITS))
        worst = max(worst, float(sum(model.weights[b] for b in buckets)) / len(buckets) ** 0.5)
    return worst


def test_logits_against_loops():
    weights = np.random.default_rng(2).normal(size=1 << T.BITS).astype(np.float32)
    model = T.ToxicityModel(weights, 1.0, 2.0)
    texts = [b"", b"  ", b"a", b"An IDIOT, a clown!", "élève ß 漢字 x9".encode(), b"w" * 40 + b" b-c.d", b"!!!", "naïve\n\ttab".encode()]
    want = [plain_logit(model, t) for t in texts]
    assert np.allclose(model.logits(texts), want) and np.allclose(model.logits(texts[::-1]), want[::-1])
    long = b"some plain words " * 80_000 + b"zzz"
    assert np.isclose(model.logits([long])[0], plain_logit(model, b"some plain words zzz"))


def _samples(rng, biased):
    fillers = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        words = list(rng.choice(fillers, 12))
        if toxic:
            words.append(str(rng.choice(["idiot", "scum", "moron"])))
        # The biased corpus names one group in toxic texts only.
        if toxic and biased and rng.random() < 0.9:
            words.append("muslims")
        text = " ".join(words).encode()
        rows.append((T._distinct(text), [T._distinct(text)] if b"muslims" in text else []))
        labels.append(toxic)
    return rows, np.array(labels)


def test_counterfactuals_clear_neutral_mentions():
    rows, y = _samples(np.random.default_rng(1), biased=True)
    plain = T.train_toxicity(rows, y, strength=0.0)
    fair = T.train_toxicity(rows, y, strength=1.0)
    mention, other = b"word7 word9 muslims word3", b"word7 word9 christians word3"
    assert plain.logits([mention])[0] > 2 * fair.logits([mention])[0]
    assert abs(fair.logits([mention])[0] - fair.logits([other])[0]) < abs(plain.logits([mention])[0] - plain.logits([other])[0]) / 2
    assert fair.scores([mention])[0] < 0.5
    assert min(fair.scores([b"word7 idiot word1", b"scum word4", b"muslims idiot"])) > 0.7
    again = T.train_toxicity(rows, y, strength=1.0)
    assert (again.weights == fair.weights).all() and again.offset == fair.offset


def test_without_group_terms_the_penalty_changes_nothing():
    rows, y = _samples(np.random.default_rng(3), biased=False)
    assert (T.train_toxicity(rows, y, strength=0.0).weights == T.train_toxicity(rows, y, strength=5.0).weights).all()


def test_held_out_accuracy(spark):
    out = T.op13_toxicity(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    caught = np.mean([r["predicted"] for r in held if r["toxic"]])
    blamed = np.mean([r["predicted"] for r in held if not r["toxic"]])
    assert caught >= 0.75 and blamed <= 0.05  # a few labels contradict their texts


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score double, label string, toxic int")


def test_edges(spark):
    rows = [(i, ("you idiot clown " if i % 2 else "kind words here ") + f"w{i}", 0.5, "x", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", 0.1, "", 0), (None, "you idiot", 0.5, "x", 0), (3, "you idiot again", 0.5, "x", 0), (102, "y " * 400_000 + "idiot", 0.5, "x", 0)]
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(40)] + [(1, 0, 9), (2, None, 9), (None, 1, 9), (555, 1, 9)], "doc_id long, toxic int, score int")
    model = T.fit_toxicity(docs, labels, F.lit(True))
    got = T.predict_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got if r["doc_id"] != 3}
    assert by_id[100] == by_id[101] < 0.5 < 0.7 < min(by_id[None], by_id[102], by_id[1])
    assert max(by_id[i] for i in range(0, 40, 2)) < 0.5
    assert T.predict_toxicity(docs.filter("false"), model).count() == 0
    assert T.fit_toxicity(docs, labels.filter("false"), F.lit(True)) == 0.5
    assert T.fit_toxicity(docs, labels, F.lit(False)) == 0.5
    assert T.fit_toxicity(docs, labels.filter("toxic = 0 and doc_id > 1"), F.lit(True)) == 0.05
    assert T.fit_toxicity(docs, labels.filter("toxic = 1"), F.lit(True)) == 0.95
    assert T.predict_toxicity(docs, 0.5).filter("score = 0.5").count() == len(rows)


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = _docs(spark, [(i, "some text of a page " * 50, 0.0, "x", 0) for i in range(300)])
    ids = [(i, i % 2) for i in range(300)]
    rows, y = T._sampled(docs, ids, T.IDENTITY, 40_000)
    assert len(rows) == len(y) == 2 * (20_000 // 1000) and set(y.tolist()) == {0, 1}
    assert rows[0] == (b"a of page some text", [])
    rows, _ = T._sampled(_docs(spark, [(1, "Old men. The women came! X", 0.0, "", 0)]), [(1, 0)], T.IDENTITY, 1000)
    assert rows == [(b"came men old the women x", [b"came the women", b"men old"])]
