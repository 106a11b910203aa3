"""Scalar score rules, scorer contracts and properties."""

import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidings.functions import scores as S
from tidings.operators.scorers import (LexiconScorer, ModelScorer, label_list_to_columns,
                                       lexicon_model_loader)
from tidings.operators.score import analyze, score


def _one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (0.5000001,), (-0.5000001,), (float("nan"),), (None,)],
                               "c double")
    got = [r.s for r in df.select(S.sentiment_class("c").alias("s")).collect()]
    assert got == ["Neutral", "Neutral", "Positive", "Negative", "Neutral", "Neutral"]


def test_direction_ties_and_negative_zero(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.0), (0.0, 0.0, 0.0), (0.6, 0.1, 0.2)], "p double, n double, m double")
    rows = df.select(S.direction("p", "n").alias("d"),
                     S.adjusted(S.direction("p", "n"), "m").alias("a")).collect()
    assert [r.d for r in rows] == [-1, -1, 1]
    assert all(math.copysign(1.0, r.a) == 1.0 for r in rows[:2])  # no -0.0


def test_clamp_and_argmax(spark):
    df = spark.createDataFrame([(1.5, 0.2, 0.2, 0.2), (-3.0, 0.1, 0.5, 0.5), (0.0, 0.1, 0.2, 0.7)],
                               "c double, p double, n double, u double")
    rows = df.select(S.clamp("c").alias("c"), S.argmax_label("p", "n", "u").alias("l")).collect()
    assert [r.c for r in rows] == [1.0, -1.0, 0.0]
    assert [r.l for r in rows] == ["positive", "negative", "neutral"]


def test_label_list_top1_zero_fill(spark):
    df = spark.sql("SELECT array(named_struct('label', 'POSITIVE', 'score', 0.9D)) AS raw")
    r = df.select(label_list_to_columns("raw").alias("s")).first().s
    assert (r.positive, r.negative, r.neutral) == (0.9, 0.0, 0.0)


def test_sentiment_sees_first_512_chars_materiality_whole(spark, headlines):
    text = "x " * 300 + "profit solar"
    df = headlines([(1, text)])
    r = score(df).first()
    assert r.positive == 0.0 and r.neutral == 1.0
    assert r.materiality_score > 0


def test_model_scorer_fallback_is_per_row(spark, headlines):
    df = headlines([(i, h) for i, h in enumerate(
        ["record profit", "fly ash spill", "weak loss", "plain"])]).repartition(1)
    out = score(df, scorer=ModelScorer(lexicon_model_loader(), batch_size=16)).orderBy("doc_id").collect()
    assert out[1].score_error and (out[1].positive, out[1].negative, out[1].neutral) == (0.0, 0.0, 1.0)
    assert out[1].sentiment == "Neutral" and out[1].esg_adjusted_score == -out[1].materiality_score + 0.0
    assert out[0].score_error is None and out[0].positive > out[0].negative
    assert out[2].negative > out[2].positive


def test_model_and_lexicon_agree(spark):
    from tidings.sources.news import news_items

    news = news_items(spark, "/root/testdata/sf0.001").filter(~F.lower("Headline").contains("fly ash"))
    a = score(news).select("doc_id", "positive", "negative", "neutral")
    b = score(news, scorer=ModelScorer(lexicon_model_loader())).select("doc_id", "positive", "negative", "neutral")
    assert sorted(a.collect()) == sorted(b.collect())


words = st.sampled_from(["profit", "loss", "solar", "energy", "weak", "growth", "the", "and", "EV", "x"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(words, min_size=0, max_size=12).map(" ".join), min_size=1, max_size=6))
def test_properties(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), ["doc_id", "Headline"])
    for r in analyze(df).collect():
        assert abs(r.positive + r.negative + r.neutral - 1.0) < 1e-12
        assert r.sentiment == ("Positive" if r.cumulative_score > 0.5 else
                               "Negative" if r.cumulative_score < -0.5 else "Neutral")
        assert abs(abs(r.esg_adjusted_score) - abs(r.materiality_score)) < 1e-15
        assert -1.0 - 1e-12 <= r.materiality_score <= 1.0 + 1e-12


def test_null_headline_default_and_compat(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, Headline string")
    r = analyze(df).first()
    assert r.Headline is None and (r.positive, r.negative, r.neutral) == (0.0, 0.0, 1.0)
    assert r.sentiment == "Neutral" and r.company is None and r.esg_flag is False
    c = analyze(df, compat_nan=True).first()
    assert c.Headline == "nan" and c.neutral == 1.0 and c.materiality_score == 0.0


def test_single_mode_matches_batch(spark):
    from tidings.operators.single import analyze_single, explain_single

    h = "  Tata Power commissions 500MW solar plant, targets net zero by 2045\t"
    one = analyze_single(spark, h).first()
    batch = analyze(spark.createDataFrame([(0, h.strip())], ["doc_id", "Headline"])).first()
    assert one.asDict() == batch.asDict()
    report, sent, env = explain_single(spark, h)
    r = report.first()
    assert r.company == "Tata Power" and r.esg_label == "Environmental"
    assert sent.count() == 11 and env.count() == 11  # every word is a player
    from tidings.operators.materiality import EncoderCosine, anchor_vocabulary_encoder_loader

    model, enc = ModelScorer(lexicon_model_loader(fail_on=None)), EncoderCosine(anchor_vocabulary_encoder_loader())
    other, _, env = explain_single(spark, h, scorer=model, materiality=enc)
    assert other.first().cumulative_text == r.cumulative_text and env.count() == 11
    try:
        analyze_single(spark, " \t ")
    except ValueError:
        return
    raise AssertionError("blank input must be rejected")


def test_bow_vectorized_equals_native(spark):
    """The Arrow-batched token counter and the native fold agree, Unicode and
    nulls included."""
    from pyspark.sql import functions as F

    from tidings.operators.materiality import BowCosine
    from tidings.sources.news import news_items

    extra = spark.createDataFrame(
        [(-1, "Solar ſolar SOLAR power, power; énergie energy2 energy_energy"), (-2, None), (-3, ""),
         (-4, "İstanbul AMMONıA carbon carbon carbon and and")], "doc_id long, Headline string")
    df = news_items(spark, "/root/testdata/sf0.001").select("doc_id", "Headline").unionByName(extra)
    fast = BowCosine().expr(F.col("Headline"))
    slow = BowCosine(vectorized=False).expr(F.col("Headline"))
    bad = df.select("doc_id", fast.alias("a"), slow.alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
    assert bad.count() == 0


def test_count_words_equals_token_count(spark):
    """The bounded regex count equals counting the lexical tokens that are in
    the vocabulary: prefixes, suffixes, digits, Unicode and nulls included."""
    from pyspark.sql import functions as F

    from tidings.config import NEGATIVE_WORDS, POSITIVE_WORDS
    from tidings.functions.text import count_in, count_words, lexical_tokens

    texts = ["profit profits profit2 2profit nonprofit PROFIT, profit.", "loss-loss_loss (loss) lossy",
             "ſolar énergie growth growthé ıgrowth", "", None, "growth\tgrowth\ngrowth"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for vocab in (POSITIVE_WORDS, NEGATIVE_WORDS, ("profit", "loss", "growth", "a b")):
        fast = count_words(F.lower("t"), vocab)
        slow = count_in(lexical_tokens("t"), tuple(vocab))
        rows = df.select("id", fast.alias("a"), slow.alias("b")).collect()
        assert all(r.a == r.b for r in rows), rows


def test_fixed_decimals_round_the_binary_value(spark):
    import random

    rng = random.Random(1)
    xs = [0.03125, 0.30005, 0.0625, -0.30005, 0.00005, -0.00001, 0.0, 1.0, 0.99995, -1.5, 12345.67895] + [rng.uniform(-2, 2) for _ in range(500)]
    xs += [j / 32 for j in range(-64, 65)] + [(2 * k + 1) / 20000 for k in range(-500, 500)] + [(2 * k + 1) / 2000 for k in range(-200, 200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", S.signed("x", 4).alias("a"), S.unsigned("x", 4).alias("b"), S.signed("x", 3).alias("c")).collect():
        assert (r.a, r.b, r.c) == (f"{r.x:+.4f}", f"{r.x:.4f}", f"{r.x:+.3f}")
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(S.signed("x", 4).alias("v")).collect()
    assert [r.v for r in odd] == [None, "+nan"]


def test_a_repeated_label_counts_last(spark):
    df = spark.sql("SELECT array(named_struct('label', 'POSITIVE', 'score', 0.9D), named_struct('label', 'positive', 'score', 0.2D), "
                   "named_struct('label', 'x', 'score', CAST(NULL AS DOUBLE))) AS raw UNION ALL SELECT array() UNION ALL SELECT NULL")
    assert [tuple(r.s) for r in df.select(label_list_to_columns("raw").alias("s")).collect()] == [(0.2, 0.0, 0.0), (0.0,) * 3, (0.0,) * 3]


def test_null_text_and_token_free_anchor(spark, headlines):
    from tidings.operators.materiality import BowCosine, EncoderCosine, anchor_vocabulary_encoder_loader

    df = spark.createDataFrame([(1, None), (2, "solar none")], "doc_id long, Headline string")
    enc = EncoderCosine(anchor_vocabulary_encoder_loader("none solar"), "none solar")
    rows = {r.doc_id: r for r in df.select("doc_id", enc.expr("Headline").alias("e"), BowCosine("!!").expr("Headline").alias("b")).collect()}
    assert rows[1].e == 0.0 and abs(rows[2].e - 1.0) < 1e-9 and rows[1].b == rows[2].b == 0.0
