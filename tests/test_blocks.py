"""Attributions and counts that work in blocks: equal to plain loops, and bounded whatever the Arrow batch."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidings import config as C
from tidings.functions.scores import half_up
from tidings.functions.vectors import arrow_blocks, token_counter
from tidings.operators import games
from tidings.operators.explain import Game, games_of
from tidings.operators.games import Block, Lexicons, game_udf, ragged_tree_keys, order_coefficients, sampled_orders
from tidings.operators.materiality import anchor_counts, squared_token_counts
from tidings.operators.scorers import lexicon_model_loader

WORDS = ("solar profit weak loss growth carbon power and the the the record-loss profit, emissions x9 - énergie").split()


def texts(n, longest, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, longest))) for _ in range(n)]


def lexicons():
    anchor = anchor_counts()
    return Lexicons.of(C.POSITIVE_WORDS, C.NEGATIVE_WORDS, anchor, float(np.sqrt(sum(v * v for v in anchor.values()))))


@pytest.mark.parametrize("players", [4, 16])
@pytest.mark.parametrize("tree,paired", [(False, False), (True, True)])
def test_few_players_by_gram_matrix_equal_the_walk_over_tokens(monkeypatch, players, tree, paired):
    data = [t.encode() for t in texts(40, 60)] + [b"", b"solar"]
    ids, label = np.arange(len(data)) * 11, np.arange(len(data)) % 3
    args = (ids, label, 6, 1, tree, paired, 2, None)
    near = Block(data, players, lexicons())
    found = near.attribute(*args)
    monkeypatch.setattr(games, "_FEW", 0)
    far = Block(data, players, lexicons())
    assert near.few and not far.few
    for a, b in zip(found, far.attribute(*args)):
        assert np.allclose(a, b, atol=1e-12)


def test_tree_keys_from_the_root_give_the_sampled_orders():
    size, docs = np.array([1, 2, 7, 8, 9, 40]), np.array([5, 0, -3, 12, 9, 1 << 40])
    keys = ragged_tree_keys(order_coefficients(2, docs, np.zeros(6, np.int64)), size)
    for part, m, doc in zip(np.split(keys, np.cumsum(size)[:-1]), size.tolist(), docs.tolist()):
        assert np.argsort(part).tolist() == sampled_orders(2, doc, 1, m, tree=True)[0].tolist()


@pytest.mark.parametrize("udf,columns", [("game", 3), ("squares", 1)])
def test_memory_is_a_block_whatever_the_batch(spark, udf, columns):
    """F2, F4, F8, F9, F10: a batch of four times the rows takes no more working memory."""
    work = game_udf(lexicons(), None, 2, 0, True, True, 8, None).func if udf == "game" else squared_token_counts.func
    peaks = []
    for n in (1500, 6000):
        lowered = pa.array([t.lower() for t in texts(1500, 300)] * (n // 1500))
        batch = (pa.array(np.arange(n)), lowered, pa.array(["neutral"] * n))[:columns]
        tracemalloc.start()
        rows = sum(len(x) for x in work(iter([batch if columns > 1 else lowered])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 1.5 * peaks[0]


def test_blocks_of_an_arrow_column_hold_every_text():
    column = pa.array(["a" * 30, None, "", "b" * 200, "c"] * 50).slice(3)
    blocks = list(arrow_blocks(column, 64))
    assert [b for _, block in blocks for b in block] == [(t or "").encode() for t in column.to_pylist()]
    assert [at for at, _ in blocks] == np.cumsum([0] + [len(b) for _, b in blocks[:-1]]).tolist()


def test_games_of_many_rows_are_the_games_of_each():
    """orders drawn together are those drawn row by row."""
    some = [*texts(30, 40), None, ""]
    settings = (16, 1, 0, True, True, 512)
    for code, text, game in zip(range(len(some)), some, games_of(list(range(len(some))), some, settings)):
        if text is None:
            assert game is None
            continue
        want = Game(text, code, *settings)
        assert [game.text(i) for i in range(game.size + 1)] == [want.text(i) for i in range(want.size + 1)]


def test_token_counter_and_stub_model_equal_plain_counts():
    some = [*texts(20, 50), "", "SOLAR ſolar Profitİ profit profit_loss", "RİSK ris\u212a wea\u212a WEA\u212a É\u212b", "\n", "loss\n", "x\nprofit"]
    words = [*dict.fromkeys([*C.POSITIVE_WORDS])][:3] + ["no token", "the", "weak", "risk"]
    want = [[re.findall(C.LEXICAL_TOKEN, t.lower()).count(w) for w in words] for t in some]
    assert token_counter(words)(some).tolist() == want and token_counter(words)([]).shape == (0, len(words))
    for t, scores in zip(some, lexicon_model_loader(None)()(some)):
        found = re.findall(C.LEXICAL_TOKEN, t.lower())
        p, n = (sum(w in v for w in found) for v in (C.POSITIVE_WORDS, C.NEGATIVE_WORDS))
        assert [s["score"] for s in scores] == [p / (p + n + 1.0), n / (p + n + 1.0), 1 / (p + n + 1.0)]


def test_half_up_is_round(spark):
    values = [0.0, -0.0, 5e-7, -5e-7, 4.9999999e-7, 1.0000005, 2.5e-6, 0.1234565, -0.1234565, 1e300, float("inf"), float("nan"), None, -1e-9,
              123456.7890125, *np.random.default_rng(1).normal(size=400).tolist(), *(i / 2e6 for i in range(-50, 50))]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(half_up(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b"))
    assert [repr(r.a) for r in df.collect()] == [repr(r.b) for r in df.collect()]
