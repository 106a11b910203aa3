"""Attribution of any classifier and encoder, as black boxes on masked texts.

Every masked text of every row is an address (``scoretable``): the tasks that read
the texts write only 16-byte keys, one per coalition. Equal keys, in one row or
in many (the empty coalition of all rows, copies of a headline, common runs), become
one; the row that first uses a key rebuilds that text and the models score it. So the
models see each distinct text once. What is shuffled is keys and values, and
each text that has work once per 512 of its coalitions. Values go back to the rows
by key, and a row's values become its attributions in one numpy step.

The calls that build a frame run jobs: the games, the score table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.config import MAX_EXACT_PLAYERS, SENTIMENT_CHAR_LIMIT, WORD_TOKEN
from tidings.operators.attribution import order_id, shapley
from tidings.operators.games import orders_of, sampled_orders
from tidings.operators.materiality import EncoderCosine
from tidings.operators.scorers import SCORE_FIELDS, ModelScorer
from tidings.operators.scoretable import append_scores, known_scores, model_rows, with_values
from tidings.plans.chain import spread
from tidings.session import fresh_path

#: Coalitions of one text scored in one piece.
_SLICE = 512


def split_players(text: str, players: int | None) -> list[str]:
    """The words of a text, or ``players`` runs of neighbouring words."""
    found = re.findall(WORD_TOKEN, text)
    n = len(found)
    if players is None or n <= players:
        return found
    return [" ".join(found[i * n // players:(i + 1) * n // players]) for i in range(players)]


class Game:
    """The coalitions of one text, numbered; the last number is the text that
    the label is read from (its first ``label_chars`` characters)."""

    def __init__(self, text: str, code: int, players: int | None, permutations: int | None, seed: int, tree: bool, paired: bool,
                 label_chars: int, chunks: list[str] | None = None, orders: np.ndarray | None = None):
        self.chunks = split_players(text, players) if chunks is None else chunks
        self.head = text[:label_chars]
        m = len(self.chunks)
        self.orders = None
        if permutations is not None and m:
            if orders is None:
                orders = sampled_orders(seed, code, permutations, m, tree)
            self.orders = np.concatenate([orders, orders[:, ::-1]]) if paired else orders
            self.size = len(self.orders) * (m + 1)
        else:
            if m > MAX_EXACT_PLAYERS:
                raise ValueError(f"exact enumeration takes at most {MAX_EXACT_PLAYERS} players; pass permutations")
            self.size = 1 << m

    def text(self, at: int) -> str:
        if at == self.size:
            return self.head
        m = len(self.chunks)
        if self.orders is None:
            return " ".join(c for i, c in enumerate(self.chunks) if at >> i & 1)
        order, n = divmod(at, m + 1)
        kept = np.zeros(m, bool)
        kept[self.orders[order, :n]] = True
        return " ".join(compress(self.chunks, kept.tolist()))

    def phi(self, v: np.ndarray) -> np.ndarray:
        """Attributions from the values of coalitions 0 to size - 1."""
        m = len(self.chunks)
        if self.orders is None:
            return shapley(v[None, :], m)[0]
        steps = np.diff(v.reshape(len(self.orders), m + 1), axis=1)
        return np.bincount(self.orders.ravel(), weights=steps.ravel(), minlength=m) / len(self.orders)


def games_of(codes: list, texts: list, settings: tuple) -> list[Game | None]:
    """The games of rows (none for a null text): the orders of those with equally many players are drawn together."""
    players, permutations, seed, tree, *_ = settings
    chunks = [None if t is None else split_players(t, players) for t in texts]
    orders: list = [None] * len(texts)
    if permutations is not None:
        size = np.array([len(c or ()) for c in chunks])
        for m in np.unique(size[size > 0]).tolist():
            alike = np.flatnonzero(size == m)
            step = max(1, (1 << 16) // (permutations * m))
            for a in range(0, len(alike), step):
                some = alike[a:a + step]
                for i, drawn in zip(some.tolist(), orders_of(seed, [codes[i] for i in some], np.arange(permutations), m, tree)):
                    orders[i] = drawn
    return [None if t is None else Game(t, code, *settings, chunks=c, orders=o) for code, t, c, o in zip(codes, texts, chunks, orders)]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_RESULT = ("struct<chunks: array<string>, n_players: int, label: string, sent_base: double, sent_phi: array<double>, "
           "sent_full: double, env_base: double, env_phi: array<double>, env_full: double, attribution_error: string>")
_RESULT_ARROW = pa.struct([
    ("chunks", pa.list_(pa.string())), ("n_players", pa.int32()), ("label", pa.string()), ("sent_base", pa.float64()),
    ("sent_phi", pa.list_(pa.float64())), ("sent_full", pa.float64()), ("env_base", pa.float64()), ("env_phi", pa.list_(pa.float64())),
    ("env_full", pa.float64()), ("attribution_error", pa.string())])
_EMPTY = dict.fromkeys(("chunks", "n_players", "label", "sent_base", "sent_phi", "sent_full", "env_base", "env_phi", "env_full", "attribution_error"))
_LABELS = ("positive", "negative", "neutral")


def attribute_models(df: DataFrame, scorer: ModelScorer, encoder: EncoderCosine | None = None, id_col: str = "doc_id",
                     text_col: str = "Headline", players: int | None = None, permutations: int | None = 16, seed: int = 0,
                     label_chars: int = SENTIMENT_CHAR_LIMIT, keep: tuple[str, ...] = (), tree: bool = False, paired: bool = False,
                     table: str | None = None, version: str = "1", parts: int = 1) -> DataFrame:
    """Sentiment and environmental attribution of any classifier and encoder.

    Players are the words of the text (``players=n``: n runs of words). A text
    has ``permutations * (words + 1)`` coalitions (twice that with ``paired``: each
    order also backwards), or all ``2 ** players`` with ``permutations=None``.
    ``tree``: orders of a balanced binary tree over the words (Owen values, see
    ``games``). The environmental value of a masked text is the sign of its
    sentiment times its cosine to the anchor. ``table`` and ``version`` keep the scores for later
    runs, in ``parts`` commits.

    A null text, or one with a masked text that a model fails on, has null values
    and the reason in ``attribution_error``; other rows are not affected.
    Without an encoder the environmental columns are null.
    """
    if permutations is None and (players is None or players > MAX_EXACT_PLAYERS):
        raise ValueError(f"exact enumeration takes players of at most {MAX_EXACT_PLAYERS}")
    spark = df.sparkSession
    settings = (players, permutations, seed, tree, paired, label_chars)
    kept = [c for c in keep if c != id_col]
    own = df.select(F.monotonically_increasing_id().alias("__row"), order_id(df, id_col).alias("__code"), F.col(text_col).alias("__text"),
                    F.col(id_col).alias("__id"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)])

    def add_keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys = [[hashlib.md5(game.text(i).encode()).digest() for i in range(game.size + 1)] if game else []
                        for game in games_of(part.column(1).to_pylist(), part.column(2).to_pylist(), settings)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.list_(pa.binary()))], names=[*part.schema.names, "__keys"])

    schema = T.StructType([*own.schema.fields, T.StructField("__keys", T.ArrayType(T.BinaryType()))])
    games = _stored(own.mapInArrow(add_keys, schema), "games")
    uses = games.select("__row", F.posexplode("__keys").alias("at", "key"))
    firsts = _stored(uses.groupBy("key").agg(F.min(F.struct("__row", "at")).alias("first"), F.count(F.lit(1)).alias("uses")), "distinct-texts")

    # The row that first uses a key rebuilds its text; a text is sent once per slice of work.
    todo = firsts
    if table is not None:
        todo = firsts.join(known_scores(spark, table).filter(F.col("version") == version).select("key"), "key", "left_anti")
    slices = (todo.select(F.col("first.__row").alias("__row"), F.col("first.at").alias("at"), "key")
              .groupBy("__row", F.floor(F.col("at") / _SLICE).alias("__slice")).agg(F.collect_list(F.struct("at", "key")).alias("work")))
    work = _stored(games.select("__row", "__code", "__text").join(slices, "__row"), "masked-work")

    def expand(batch: pa.RecordBatch) -> Iterator[tuple[bytes, str]]:
        games = games_of(batch.column("__code").to_pylist(), batch.column("__text").to_pylist(), settings)
        for game, items in zip(games, batch.column("work")):
            for at, key in zip(*(items.values.field(c).to_pylist() for c in ("at", "key"))):
                yield key, game.text(at)

    table = table or fresh_path(spark, "masked-scores")
    append_scores(spread(work), expand, model_rows(scorer, encoder), table, version, F.col("__row"), parts)
    values = known_scores(spark, table).filter(F.col("version") == version).join(firsts.select("key", "uses"), "key")
    back = with_values(uses, values.select("key", *SCORE_FIELDS, "cosine", "score_error", "uses"))
    found = back.groupBy("__row").agg(F.collect_list(F.struct("at", *SCORE_FIELDS, "cosine", "score_error")).alias("values"))
    explained = encoder is not None

    @F.arrow_udf(_RESULT)
    def result(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for codes, texts, values in batches:
            for at in range(0, len(codes), 64):
                games = games_of(codes.slice(at, 64).to_pylist(), texts.slice(at, 64).to_pylist(), settings)
                out = [_row(game, rows, explained) for game, rows in zip(games, values.slice(at, 64))]
                yield pa.array(out, _RESULT_ARROW)

    joined = games.drop("__keys").join(found, "__row", "left")
    shown = [F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)]]
    return joined.withColumn("__x", result("__code", "__text", "values")).select(*shown, "__x.*")


def _row(game: Game | None, rows: pa.ListScalar, explained: bool) -> dict:
    if game is None:
        return _EMPTY | {"n_players": 0, "attribution_error": "no text"}
    one = _EMPTY | {"chunks": game.chunks, "n_players": len(game.chunks)}
    order = np.argsort(rows.values.field("at").to_numpy())
    errors = rows.values.field("score_error")
    if errors.null_count < len(errors):
        said = errors.to_pylist()
        return one | {"attribution_error": next(said[i] for i in order if said[i])}
    return one | _values(game, {c: rows.values.field(c).to_numpy(zero_copy_only=False)[order] for c in (*SCORE_FIELDS, "cosine")}, explained)


def _values(game: Game, scores: dict[str, np.ndarray], explained: bool) -> dict:
    p = np.stack([scores[f] for f in SCORE_FIELDS], axis=1)
    label = int(np.argmax(p[-1]))
    # The full coalition is the last of every order and of the enumeration, the empty one the first.
    v = p[:-1, label]
    out = {"label": _LABELS[label], "sent_base": float(v[0]), "sent_phi": game.phi(v).tolist(), "sent_full": float(v[-1])}
    if explained:
        cos = scores["cosine"][:-1].astype(np.float64)
        e = np.where(p[:-1, 0] > p[:-1, 1], 1.0, -1.0) * cos + 0.0
        full = -1 if game.orders is None else len(game.chunks)
        out |= {"env_base": float(e[0]), "env_phi": game.phi(e).tolist(), "env_full": float(e[full])}
    if game.orders is not None:
        out["sent_full"] = float(v[len(game.chunks)])
    return out


def attribute_with_scorer(df: DataFrame, scorer: ModelScorer, id_col: str = "doc_id", text_col: str = "Headline",
                          players: int = 8) -> DataFrame:
    """Sentiment attribution of a classifier over all coalitions of ``players``
    runs of words."""
    return attribute_models(df, scorer, None, id_col, text_col, players, None)
