"""Tree (Owen) and paired orders, known errors, and distinct masked texts."""

import itertools
import math
import os
import re

import numpy as np
import pytest

from tidings import config as C
from tidings.operators.attribution import attribute, attribute_sampled, attribution_table
from tidings.operators.explain import Game, attribute_models
from tidings.operators.games import sampled_orders, tree_depth, tree_keys
from tidings.operators.materiality import EncoderCosine, anchor_counts, anchor_vocabulary_encoder_loader
from tidings.operators.scorers import ModelScorer, lexicon_model_loader
from tidings.operators.scoretable import known_scores, score_resumable


def scored(words, label):
    toks = re.findall(C.LEXICAL_TOKEN, " ".join(words).lower())
    p, q = (sum(t in v for t in toks) for v in (C.POSITIVE_WORDS, C.NEGATIVE_WORDS))
    ss = sum(toks.count(t) ** 2 for t in set(toks))
    anchor = anchor_counts()
    norm = math.sqrt(sum(v * v for v in anchor.values()))
    cos = sum(anchor.get(t, 0) for t in toks) / (math.sqrt(ss) * norm) if ss else 0.0
    return {"positive": p, "negative": q}.get(label, 1) / (p + q + 1), (1 if p > q else -1) * cos


def tree_orders(lo, hi, size):
    """All orders that keep the halves of every block of ``size`` leaves together."""
    if hi <= lo:
        return [[]]
    if size == 1:
        return [[lo]]
    mid = lo + size // 2
    left, right = tree_orders(lo, min(mid, hi), size // 2), tree_orders(mid, hi, size // 2)
    out = []
    for a, b in itertools.product(left, right):
        out += [a + b] if not a or not b else [a + b, b + a]
    return out


def owen(words, label, which):
    """Exact Owen values: the mean over all orders of the tree."""
    orders = tree_orders(0, len(words), 1 << int(tree_depth(len(words))))
    phi = [0.0] * len(words)
    for order in orders:
        for n, player in enumerate(order):
            before, after = sorted(order[:n]), sorted(order[:n + 1])
            phi[player] += (scored([words[i] for i in after], label)[which] - scored([words[i] for i in before], label)[which]) / len(orders)
    return phi


@pytest.mark.parametrize("m", [1, 2, 3, 6, 8, 13])
def test_tree_orders_are_all_orders_of_the_tree(m):
    want = {tuple(o) for o in tree_orders(0, m, 1 << int(tree_depth(m)))}
    got = {tuple(o) for doc in range(60) for o in sampled_orders(1, doc, 40, m, tree=True).tolist()}
    assert got <= want and (len(want) > 200 or got == want)
    coef = [np.arange(5)[:, None] + c for c in range(5)]
    keys = tree_keys(coef, np.arange(m)[None, :], tree_depth(m))
    assert all(len(set(row)) == m for row in keys.tolist())


def test_six_words_against_all_tree_orders(spark, headlines):
    texts = ["Solar profit, weak solar power loss", "loss loss growth carbon and record", "a b c d e f"]
    df = headlines(list(enumerate(texts)))
    rows = {r.doc_id: r for r in attribute_sampled(df, permutations=6000, tree=True, paired=True).collect()}
    for i, t in enumerate(texts):
        for phi, error, which in ((rows[i].sent_phi, rows[i].sent_stderr, 0), (rows[i].env_phi, rows[i].env_stderr, 1)):
            want = owen(t.split(), rows[i].label, which)
            assert all(abs(a - b) <= 5 * e + 1e-9 for a, b, e in zip(phi, want, error))
            assert max(error) < 0.01
        assert abs(rows[i].sent_base + sum(rows[i].sent_phi) - rows[i].sent_full) < 1e-12
        assert abs(rows[i].env_base + sum(rows[i].env_phi) - rows[i].env_full) < 1e-12


def test_two_words_are_exact_after_one_pair(spark, headlines):
    df = headlines([(1, "solar profit"), (2, "weak"), (3, "")])
    got = {r.doc_id: r for r in attribute_sampled(df, permutations=1, tree=True, paired=True).collect()}
    exact = {r.doc_id: r for r in attribute(df).collect()}
    for i in exact:
        assert np.allclose(got[i].sent_phi, exact[i].sent_phi) and np.allclose(got[i].env_phi, exact[i].env_phi)
        assert got[i].sent_stderr is None


def test_each_sample_is_efficient_on_long_texts(spark, headlines):
    text = "solar power weak profit " * 3000 + "end"
    row = attribute_sampled(headlines([(5, text)]), permutations=2, tree=True, paired=True).first()
    assert len(row.sent_phi) == row.n_players == 12001
    assert abs(row.env_base + sum(row.env_phi) - row.env_full) < 1e-9 and abs(row.sent_base + sum(row.sent_phi) - row.sent_full) < 1e-9


def test_errors_cover_the_exact_values(spark, headlines):
    rng = np.random.default_rng(5)
    words = ["solar", "profit", "weak", "loss", "power", "and", "x", "carbon", "growth"]
    df = headlines([(i, " ".join(rng.choice(words, 8))) for i in range(60)])
    exact = {r.doc_id: r for r in attribute(df).collect()}
    for paired in (False, True):
        inside, total, wide = 0, 0, []
        for r in attribute_sampled(df, permutations=40, paired=paired).collect():
            for phi, want, error in ((r.sent_phi, exact[r.doc_id].sent_phi, r.sent_stderr), (r.env_phi, exact[r.doc_id].env_phi, r.env_stderr)):
                for a, b, e in zip(phi, want, error):
                    inside += abs(a - b) <= 2 * e + 1e-9
                    total += 1
                wide += list(error)
        assert 0.90 <= inside / total <= 1.0
        if paired:
            assert np.mean(wide) < 0.75 * before  # same number of samples, each steadier
        before = np.mean(wide)


def test_samples_are_added_until_the_error_is_small(spark, headlines):
    df = headlines([(1, "plain words only here and there"), (2, "profit loss solar weak growth power carbon x"), (3, None), (4, "")])
    rows = {r.doc_id: r for r in attribute_sampled(df, permutations=256, paired=True, tolerance=0.02, least=4).collect()}
    assert rows[1].n_samples <= rows[2].n_samples and rows[2].n_samples in (4, 8, 16, 32, 64, 128, 256)
    assert max(*rows[2].sent_stderr, *rows[2].env_stderr) <= 0.02 or rows[2].n_samples == 256
    assert rows[3].n_samples is None and rows[4].n_samples == 0
    # A settled row equals the same row with that many samples asked for.
    same = {r.doc_id: r for r in attribute_sampled(df, permutations=rows[2].n_samples, paired=True).collect()}[2]
    assert np.allclose(same.sent_phi, rows[2].sent_phi) and np.allclose(same.env_stderr, rows[2].env_stderr)


def test_rows_without_attributions_keep_a_row_and_a_reason(spark, headlines):
    df = headlines([(1, None), (2, ""), (3, "solar profit")])
    for out in (attribute(df), attribute_sampled(df, permutations=2)):
        for side in ("sentiment", "env_impact"):
            rows = attribution_table(out, side).collect()
            assert {(r.doc_id, r.attribution_error) for r in rows} == {(1, "no text"), (2, "no words"), (3, None)}
            assert len(rows) == 4 and [r.phi for r in rows if r.doc_id < 3] == [None, None]


def test_ids_of_any_type_seed_the_orders(spark):
    df = spark.createDataFrame([("a-1", "solar profit weak"), ("b", "solar profit weak"), (None, "x")], "doc_id string, Headline string")
    rows = {r.doc_id: r for r in attribute_sampled(df, permutations=3).collect()}
    assert rows["a-1"].env_phi and len(rows) == 3


# -- distinct masked texts --------------------------------------------------------

def counting_model(folder):
    """The stub classifier; every text it sees is noted in a file."""
    load = lexicon_model_loader(fail_on=None)

    def noted():
        model = load()

        def classify(texts):
            name = os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}-{os.urandom(4).hex()}")
            with open(name, "w") as f:
                f.write("\x00".join(texts) + "\x00")
            return model(texts)

        return classify

    return ModelScorer(noted, max_chars=None)


def seen(folder):
    return [t for n in os.listdir(folder) for t in open(os.path.join(folder, n)).read().split("\x00")[:-1]]


def test_models_see_every_distinct_text_once(spark, headlines, tmp_path):
    texts = ["record profit on solar", "weak loss", "record profit on solar", "", None, "profit", "weak loss record"] + ["same copy"] * 50
    df = headlines([(7, t) for t in texts]).repartition(4)
    out = attribute_models(df, counting_model(str(tmp_path)), players=4, permutations=None)
    rows = out.collect()
    wanted = set()
    for t in texts:
        if t is not None:
            game = Game(t, 7, 4, None, 0, False, False, 512)
            wanted |= {game.text(i) for i in range(game.size + 1)}
    calls = seen(str(tmp_path))
    assert sorted(calls) == sorted(wanted)
    assert len(rows) == len(texts) and sum(r.attribution_error is None for r in rows) == len(texts) - 1


def test_tree_orders_through_models_equal_the_counts(spark, headlines):
    df = headlines([(1, "Solar profit, weak solar power loss on Tata"), (2, "growth"), (3, "")])
    model = ModelScorer(lexicon_model_loader(fail_on=None), max_chars=None)
    a = {r.doc_id: r for r in attribute_models(df, model, permutations=3, tree=True, paired=True).collect()}
    b = {r.doc_id: r for r in attribute_sampled(df, permutations=3, tree=True, paired=True).collect()}
    for i in a:
        assert list(a[i].chunks) == list(b[i].chunks) and a[i].label == b[i].label
        assert np.allclose(a[i].sent_phi, b[i].sent_phi) and abs(a[i].sent_full - b[i].sent_full) < 1e-12


def test_model_errors_reach_the_table(spark, headlines):
    df = headlines([(1, "record profit zzz solar"), (2, "record profit")])
    model = ModelScorer(lexicon_model_loader(fail_on="zzz"), max_chars=None)
    enc = EncoderCosine(anchor_vocabulary_encoder_loader())
    rows = attribution_table(attribute_models(df, model, enc, players=4, permutations=None), "env_impact").collect()
    bad = [r for r in rows if r.doc_id == 1]
    assert len(bad) == 1 and bad[0].attribution_error.startswith("ValueError") and bad[0].token is None
    assert len([r for r in rows if r.doc_id == 2]) == 2


def test_explanations_use_a_table_of_an_earlier_run(spark, headlines, tmp_path):
    df = headlines([(1, "record profit on solar"), (2, "weak loss")])
    notes, table = tmp_path / "notes", str(tmp_path / "table")
    notes.mkdir()
    model = counting_model(str(notes))
    first = attribute_models(df, model, players=4, permutations=None, table=table).orderBy("doc_id").collect()
    n = len(seen(str(notes)))
    again = attribute_models(df.union(headlines([(3, "weak loss")])), model, players=4, permutations=None, table=table).orderBy("doc_id").collect()
    assert len(seen(str(notes))) == n and again[:2] == first and again[2].sent_phi == first[1].sent_phi
    attribute_models(df, model, players=4, permutations=None, table=table, version="2").collect()
    assert len(seen(str(notes))) == 2 * n


# -- resumable scoring ------------------------------------------------------------

def test_a_run_that_was_cut_goes_on_without_scoring_twice(spark, headlines, tmp_path):
    texts = [f"record profit {i % 40} solar" for i in range(100)] + [None, "", "weak loss"] + ["hot copy"] * 300
    df = headlines(list(enumerate(texts))).repartition(3)
    notes, table = tmp_path / "notes", str(tmp_path / "table")
    notes.mkdir()
    model = counting_model(str(notes))
    assert score_resumable(df, model, table, parts=6, stop_after=2) is None
    half = len(seen(str(notes)))
    assert 0 < half < 43 and known_scores(spark, table).count() == half
    rows = score_resumable(df, model, table, parts=6).collect()
    calls = seen(str(notes))
    assert sorted(calls) == sorted({t for t in texts if t is not None}) and len(rows) == len(texts)
    want = {r.doc_id: r.s for r in df.select("doc_id", ModelScorer(lexicon_model_loader(fail_on=None), max_chars=None).expr("Headline").alias("s")).collect()}
    for r in rows:
        assert [round(x, 12) for x in r.scores[:3]] == [round(x, 12) for x in want[r.doc_id][:3]]
    score_resumable(df, model, table, parts=6).collect()
    assert len(seen(str(notes))) == len(calls)


def test_failed_texts_are_kept_with_their_reason(spark, headlines, tmp_path):
    df = headlines([(1, "fly ash profit"), (2, "profit"), (3, None)])
    rows = {r.doc_id: r.scores for r in score_resumable(df, ModelScorer(lexicon_model_loader()), str(tmp_path / "t")).collect()}
    assert rows[1].neutral == 1.0 and rows[1].score_error.startswith("ValueError") and rows[2].score_error is None
    assert (rows[3].positive, rows[3].neutral, rows[3].score_error) == (0.0, 1.0, None)
