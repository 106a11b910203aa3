"""Token attribution with exact Shapley values, computed inside each row.

Players. The text is split into blank-separated words; adjacent words are
grouped into ``m = min(n_words, T)`` chunks, chunk ``i`` holding words
``floor(i*n/m) .. floor((i+1)*n/m) - 1`` (no chunk is empty). A coalition
``S`` (a bit mask) stands for the text made of the kept chunks joined by a
space.

Value functions. Both default backends only need additive statistics of
the kept chunks, so no masked text is ever built or re-tokenised:

* lexicon sentiment: p_S = sum p_i, n_S = sum n_i over i in S; the
  probability of a label is p_S/(p_S+n_S+1), n_S/(...), 1/(...);
* bag-of-words cosine: dot_S = sum d_i and |v_S|^2 = sum_i |v_i|^2 +
  sum_{i<j in S} 2<v_i,v_j> over the chunks' token-count vectors v_i;
* composite (environmental impact): (+1 if p_S > n_S else -1) * cosine_S.

Shapley values. phi_i = sum_{S without i} w(|S|) (v(S + i) - v(S)) with
w(k) = k!(m-k-1)!/m!, over all 2^m coalitions. Splitting, chunking,
tokenising and the additive counts are native array expressions inside the
row. The coalition algebra runs in numpy in an Arrow-batched pandas UDF, rows
with equally many players in one matrix product; the composite output also
hands it the lower-cased chunks, from which it takes the m x m Gram matrices of
token counts. No explode, no shuffle: a document's cost is
O(len(text) + 2^m m^2) and documents are independent, so the work spreads over
every partition of the input.
Efficiency holds: base + sum(phi) = v(all players).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.config import DEFAULT, MAX_EXACT_PLAYERS, Settings
from tidings.functions.scores import argmax_label
from tidings.functions.text import count_words, weighted_words, words
from tidings.functions.vectors import token_codes
from tidings.operators.games import Lexicons, game_udf
from tidings.operators.materiality import BowCosine
from tidings.operators.scorers import LexiconScorer


def player_texts(df: DataFrame, text_col: str, players: int | None) -> DataFrame:
    """Add ``chunks``, the players' texts, and ``n_players``. ``players=None``:
    every word is a chunk. A null text has no players (its values are nulled by
    ``_known``)."""
    w = "__words"
    out = df.withColumn(w, F.coalesce(words(text_col), F.array().cast("array<string>")))
    n = F.size(F.col(w))
    m = n if players is None else F.least(n, F.lit(players))
    out = out.withColumn("__n", n).withColumn("n_players", m)
    n, m = F.col("__n"), F.col("n_players")

    def start(i: Column) -> Column:
        return F.floor(i * n / m).cast("int")

    chunks = F.col(w) if players is None else F.when(m == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), m - 1),
                    lambda i: F.array_join(F.slice(F.col(w), start(i) + 1, start(i + 1) - start(i)), " ")))
    return out.withColumn("chunks", chunks).drop(w, "__n")


def chunk_statistics(df: DataFrame, text_col: str, players: int, scorer: LexiconScorer, materiality: BowCosine) -> DataFrame:
    """Add chunks and their additive statistics to every row."""
    # __lex: the lower-cased chunks; the UDFs that need token counts take
    # the tokens from these strings themselves (the token class is ASCII, so
    # Python finds the same tokens as Spark's regex).
    out = player_texts(df, text_col, players).withColumn("__lex", F.transform("chunks", lambda c: F.lower(c)))
    low = F.col("__lex")
    return (out
            .withColumn("__p", F.transform(low, lambda c: count_words(c, scorer.positive)))
            .withColumn("__q", F.transform(low, lambda c: count_words(c, scorer.negative)))
            .withColumn("__d", F.transform(low, lambda c: weighted_words(c, materiality.weights))))


_SENT_TYPE = ("struct<sent_base: double, sent_phi: array<double>, sent_full: double>")
_ENV_TYPE = ("struct<env_base: double, env_phi: array<double>, env_full: double>")


class _Coalitions:
    """Per player count m: the coalition bit matrix, sizes and Shapley weights."""

    _cache: dict = {}

    @classmethod
    def get(cls, m: int):
        if m not in cls._cache:
            masks = np.arange(1 << m)
            bits = ((masks[:, None] >> np.arange(m)) & 1).astype(np.int64)
            size = bits.sum(axis=1)
            fact = [math.factorial(k) for k in range(m + 1)]
            weight = np.array([fact[k] * fact[m - k - 1] / fact[m] for k in range(m)] or [0.0])
            without = [masks[bits[:, i] == 0] for i in range(m)]
            cls._cache[m] = (bits, size, weight, without)
        return cls._cache[m]


def shapley(values: np.ndarray, m: int) -> np.ndarray:
    """phi_i = sum over coalitions S without i of w(|S|) (v(S + i) - v(S)), for
    many games of m players at once (a row of ``values`` each). Differences come
    first, so a player without influence gets exactly 0."""
    _, size, weight, without = _Coalitions.get(m)
    if m == 0:
        return np.zeros((len(values), 0))
    return np.stack([(values[:, s | (1 << i)] - values[:, s]) @ weight[size[s]] for i, s in enumerate(without)], axis=1)


def _matrix(rows: pd.Series, at: np.ndarray, m: int) -> np.ndarray:
    return np.array([np.asarray(rows.iloc[i], dtype=np.int64)[:m] for i in at], dtype=np.int64).reshape(len(at), m)


def _by_players(counts: pd.Series, step: int = 256):
    """Row numbers of equal player count, a block at a time."""
    m = counts.to_numpy(dtype=np.int64)
    for k in np.unique(m):
        rows = np.flatnonzero(m == k)
        for a in range(0, len(rows), step):
            yield int(k), rows[a:a + step]


def _collected(names: tuple[str, str, str], base, phi, full) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names, (base, phi, full))))


def _sentiment_udf():
    """Sentiment attribution from per-chunk lexicon counts (small int arrays),
    rows with equally many players in one matrix product."""

    @F.pandas_udf(_SENT_TYPE)
    def sentiment(m: pd.Series, p: pd.Series, q: pd.Series, label: pd.Series) -> pd.DataFrame:
        base, full, phis = np.zeros(len(m)), np.zeros(len(m)), [None] * len(m)
        for k, rows in _by_players(m):
            bits = _Coalitions.get(k)[0]
            ps, qs = _matrix(p, rows, k) @ bits.T, _matrix(q, rows, k) @ bits.T
            which = label.iloc[rows].to_numpy()[:, None]
            v = np.where(which == "positive", ps, np.where(which == "negative", qs, 1)) / (ps + qs + 1.0)
            base[rows], full[rows] = v[:, 0], v[:, -1]
            for i, phi in zip(rows, shapley(v, k)):
                phis[i] = phi.tolist()
        return _collected(("sent_base", "sent_phi", "sent_full"), base, phis, full)

    return sentiment


def _grams(rows: list, m: int) -> np.ndarray:
    """Per row the m x m Gram matrix of its chunks' token-count vectors (chunks
    given lower-cased)."""
    out = np.zeros((len(rows), m, m), np.int64)
    if m == 0:
        return out
    chunk, code = token_codes([c.encode() for row in rows for c in row[:m]])
    if not len(chunk):
        return out
    row = chunk // m
    order = np.lexsort((code, row))
    row, code, chunk = row[order], code[order], chunk[order] % m
    head = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    word = np.cumsum(head) - 1  # a distinct token of one row
    count = np.bincount(word * m + chunk, minlength=(word[-1] + 1) * m).reshape(-1, m)
    owner = row[head]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for i in range(m):
        for j in range(i, m):
            out[owner[first], i, j] = out[owner[first], j, i] = np.add.reduceat(count[:, i] * count[:, j], first)
    return out


def _environment_udf(anchor_norm: float):
    """Composite (direction x bag-of-words cosine) attribution from per-chunk
    counts and the lower-cased chunks (for the norm of each coalition)."""

    @F.pandas_udf(_ENV_TYPE)
    def environment(m: pd.Series, p: pd.Series, q: pd.Series, d: pd.Series, lex: pd.Series) -> pd.DataFrame:
        base, full, phis = np.zeros(len(m)), np.zeros(len(m)), [None] * len(m)
        for k, rows in _by_players(m):
            bits = _Coalitions.get(k)[0]
            ps, qs, ds = (_matrix(x, rows, k) @ bits.T for x in (p, q, d))
            sq = np.einsum("si,rij,sj->rs", bits, _grams([lex.iloc[i] for i in rows], k), bits, optimize=True)
            cos = np.divide(ds, np.sqrt(sq.astype(np.float64)) * anchor_norm, out=np.zeros(ds.shape), where=sq != 0)
            v = np.where(ps > qs, 1.0, -1.0) * cos + 0.0
            base[rows], full[rows] = v[:, 0], v[:, -1]
            for i, phi in zip(rows, shapley(v, k)):
                phis[i] = phi.tolist()
        return _collected(("env_base", "env_phi", "env_full"), base, phis, full)

    return environment


_OUTPUTS = ("sent_base", "sent_phi", "sent_full", "env_base", "env_phi", "env_full")


def _known(source: dict[str, Column], text: Column) -> list[Column]:
    """The output columns, null with a reason where there is no text."""
    return [*[F.when(text.isNotNull(), source[c]).alias(c) for c in _OUTPUTS],
            F.when(text.isNull(), F.lit("no text")).alias("attribution_error")]


def attribute(df: DataFrame, id_col: str = "doc_id", text_col: str = "Headline",
              settings: Settings = DEFAULT, scorer: LexiconScorer | None = None,
              materiality: BowCosine | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: chunks, sentiment attribution (for the label the batch scorer
    picks) and environmental-impact attribution, with base values.

    Output: id, *keep, chunks, n_players, label, sent_base, sent_phi,
    sent_full, env_base, env_phi, env_full, attribution_error (a null text has
    null values and a reason; other rows are not affected). Text work (splitting, chunking,
    token counts, sums of squares) is native; only the coalition algebra over
    at most 2^T small integer sums runs in an Arrow-batched pandas UDF, one
    per output so that a query reading one output never computes the other.
    """
    players = settings.attribution_players
    if players > MAX_EXACT_PLAYERS:
        raise ValueError(f"exact Shapley enumeration supports at most {MAX_EXACT_PLAYERS} players")
    # The label comes from the batch scorer (first characters only); the value
    # functions see the whole masked text.
    batch = scorer or LexiconScorer(max_chars=settings.sentiment_chars)
    whole = LexiconScorer(batch.positive, batch.negative, max_chars=None)
    materiality = materiality or BowCosine(settings.anchor)

    s = batch.expr(F.col(text_col))
    base = df.select(id_col, *[c for c in keep if c not in (id_col, text_col)], text_col,
                     F.col(text_col).alias("__text_kept")).withColumn(
        "label", F.when(F.col(text_col).isNotNull(), argmax_label(s["positive"], s["negative"], s["neutral"])))
    stats = chunk_statistics(base, text_col, players, whole, materiality).drop(text_col)
    m = F.col("n_players")
    sent = _sentiment_udf()(m, F.col("__p"), F.col("__q"), F.col("label"))
    env = _environment_udf(materiality.anchor_norm)(
        m, F.col("__p"), F.col("__q"), F.col("__d"), F.col("__lex"))
    out = stats.withColumn("__sent", sent).withColumn("__env", env)
    kept = [F.col(c) for c in keep if c not in (id_col, text_col)]
    if text_col in keep:
        kept.append(F.col("__text_kept").alias(text_col))
    return out.select(
        id_col, *kept, "chunks", "n_players", "label",
        *_known({c: F.col(f"__sent.{c}" if c.startswith("sent") else f"__env.{c}") for c in _OUTPUTS}, F.col("__text_kept")))


def row_error() -> Column:
    """Why a row has no attributions: the captured error, or a text without words."""
    return F.coalesce(F.col("attribution_error"), F.when(F.col("n_players") == 0, F.lit("no words")))


def attribution_table(attributed: DataFrame, output: str, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Long form (id, player, token, phi, weight, attribution_error) of one output.

    ``output`` is ``"sentiment"`` (the per-row label) or ``"env_impact"``.
    ``weight`` = phi / max|phi| of the row (0 when all are 0), computed on the
    row's own array: no window, no shuffle. A row without attributions (null
    text, failed model, no words) is one row with the reason and nulls. Sampled
    attributions also have each value's standard error, ``phi_stderr``; ``carry``
    names further columns to repeat.
    """
    side = "sent" if output == "sentiment" else "env"
    phi = f"{side}_phi"
    top = F.array_max(F.transform(F.col(phi), lambda x: F.abs(x)))
    label = F.col("label") if output == "sentiment" else F.lit("env_impact")
    known = F.col(phi).isNotNull()
    parts = [F.when(known, F.col("chunks")).alias("token"), F.col(phi).alias("phi")]
    if f"{side}_stderr" in attributed.columns:
        parts.append(F.col(f"{side}_stderr").alias("phi_stderr"))
    # Whatever reads the arrays comes before the explode: an expression beside it would
    # be evaluated for, and carry the arrays into, every exploded row.
    ready = attributed.select(id_col, *carry, label.alias("output"), top.alias("__top"), row_error().alias("attribution_error"),
                              F.arrays_zip(*parts).alias("__zipped"))
    rows = ready.select(id_col, *carry, "output", "__top", "attribution_error", F.posexplode_outer("__zipped").alias("player", "z"))
    weight = F.when(F.col("__top") == 0, F.lit(0.0)).otherwise(F.col("z.phi") / F.col("__top"))
    return rows.select(
        id_col, *carry, "output", "player", F.col("z.token").alias("token"), F.col("z.phi").alias("phi"), weight.alias("weight"),
        *([F.col("z.phi_stderr").alias("phi_stderr")] if len(parts) > 2 else []), "attribution_error")


def audit_scores(attributed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Environmental audit score = base + sum(phi); equals the value of the
    whole text by efficiency (``env_full``). A failed row has nulls and the reason."""
    total = F.aggregate(F.col("env_phi"), F.lit(0.0), lambda a, x: a + x)
    return attributed.select(
        id_col, "n_players",
        F.col("env_base").alias("base_value"),
        total.alias("phi_sum"),
        (F.col("env_base") + total).alias("audit_score"),
        F.col("env_full").alias("full_value"),
        "attribution_error",
    )


# ---------------------------------------------------------------------------
# Any number of players: sampled orders
# ---------------------------------------------------------------------------

def order_id(df: DataFrame, id_col: str) -> Column:
    """The number that seeds a row's player orders: the id itself where it is a
    whole number, a hash of any other id; 0 for none."""
    kind = dict(df.dtypes)[id_col]
    code = F.col(id_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(
        F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return F.coalesce(code, F.lit(0).cast("long"))


def attribute_sampled(df: DataFrame, id_col: str = "doc_id", text_col: str = "Headline", players: int | None = None,
                      permutations: int = 64, seed: int = 0, settings: Settings = DEFAULT,
                      scorer: LexiconScorer | None = None, materiality: BowCosine | None = None,
                      keep: tuple[str, ...] = (), tree: bool = False, paired: bool = False,
                      tolerance: float | None = None, least: int = 8) -> DataFrame:
    """Like ``attribute`` with sampled orders, for any number of players: the
    words of the text, or ``players`` runs of words (``games`` has the method).

    ``permutations`` samples a row (the sample size is the feature; every row and the
    whole text are used). ``tree``: orders of a balanced binary tree over the words
    (Owen values) instead of uniform ones (Shapley values). ``paired``: a sample is
    the mean of an order and its reverse. ``tolerance``: at least ``least`` samples, doubled
    until every player's standard error is within it, at most ``permutations``.
    Efficiency holds exactly for every sample. Output: the columns of
    ``attribute``, ``sent_stderr``, ``env_stderr`` (null with one sample) and ``n_samples``.
    """
    if permutations < 1 or least < 2:
        raise ValueError("at least one sample, and two to know an error")
    batch = scorer or LexiconScorer(max_chars=settings.sentiment_chars)
    materiality = materiality or BowCosine(settings.anchor)
    lexicons = Lexicons.of(batch.positive, batch.negative, materiality.weights, materiality.anchor_norm)
    s = batch.expr(F.col(text_col))
    kept = [c for c in keep if c not in (id_col, text_col)]
    base = df.select(id_col, text_col, *kept).withColumn(
        "label", F.when(F.col(text_col).isNotNull(), argmax_label(s["positive"], s["negative"], s["neutral"])))
    play = game_udf(lexicons, players, permutations, seed, tree, paired, least, tolerance)
    out = player_texts(base, text_col, players).withColumn("__r", play(order_id(df, id_col), F.lower(F.col(text_col)), F.col("label")))
    shown = [*([text_col] if text_col in keep else []), *kept]
    known = F.col(text_col).isNotNull()
    errors = [F.when(known & (F.col("__r.n_samples") > 1), F.col(f"__r.{c}")).alias(c) for c in ("sent_stderr", "env_stderr")]
    return out.select(id_col, *shown, "chunks", "n_players", "label", *_known({c: F.col(f"__r.{c}") for c in _OUTPUTS}, F.col(text_col)),
                      *errors, F.when(known, F.col("__r.n_samples")).alias("n_samples"))
