"""Sentiment scorers behind one contract.

A scorer turns a text Column into ``struct<positive, negative, neutral,
score_error>`` (doubles and a nullable error string).

* ``LexiconScorer`` (default) is a native expression. It STANDS IN for a
  learned financial-sentiment classifier: no weights ship with this
  repository, so its numbers are not a learned model's numbers. With
  ``p``/``n`` positive/negative lexicon hits: positive = p/(p+n+1),
  negative = n/(p+n+1), neutral = 1/(p+n+1).
* ``ModelScorer`` wraps any user model (``loader() -> callable(list[str])``
  returning, per text, a list of ``{label, score}`` or a single top-1
  ``{label, score}``) in ``predict_batch_udf``: Arrow batches of
  ``batch_size`` rows, model loaded once per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.config import (
    FALLBACK_SCORES,
    LEXICAL_TOKEN,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    SENTIMENT_BATCH_SIZE,
    SENTIMENT_CHAR_LIMIT,
)
from tidings.functions.text import col_, count_words, let, truncate
from tidings.functions.vectors import token_counter

SCORE_FIELDS = ("positive", "negative", "neutral")
SCORE_TYPE = T.StructType(
    [T.StructField(f, T.DoubleType(), True) for f in SCORE_FIELDS]
    + [T.StructField("score_error", T.StringType(), True)]
)
RAW_OUTPUT_TYPE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
]))


class LexiconScorer:
    reports_errors = False

    def __init__(self, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, max_chars: int | None = SENTIMENT_CHAR_LIMIT):
        self.positive = tuple(positive)
        self.negative = tuple(negative)
        self.max_chars = max_chars

    def counts(self, text: Column | str) -> tuple[Column, Column]:
        t = col_(text)
        if self.max_chars is not None:
            t = truncate(t, self.max_chars)
        lowered = F.lower(t)
        return count_words(lowered, self.positive), count_words(lowered, self.negative)

    @staticmethod
    def from_counts(p: Column, n: Column) -> Column:
        total = (p + n + 1).cast("double")
        return F.struct(
            (p / total).alias("positive"),
            (n / total).alias("negative"),
            (F.lit(1.0) / total).alias("neutral"),
            F.lit(None).cast("string").alias("score_error"),
        )

    def expr(self, text: Column | str) -> Column:
        """Both counts are bound once and read by the three quotients: two
        scans of the text, wherever the expression is inlined."""
        p, n = self.counts(text)
        scores = let(F.struct(p.alias("p"), n.alias("n")), lambda c: self.from_counts(c["p"], c["n"]))
        return F.when(col_(text).isNull(), fallback_struct(None)).otherwise(scores)


def fallback_struct(error: str | None) -> Column:
    pos, neg, neu = FALLBACK_SCORES
    return F.struct(F.lit(pos).alias("positive"), F.lit(neg).alias("negative"), F.lit(neu).alias("neutral"),
                    F.lit(error).cast("string").alias("score_error"))


def label_list_to_columns(raw: Column | str) -> Column:
    """array<struct<label, score>> -> struct<positive, negative, neutral>.

    Labels are lower-cased; a class missing from the list (top-1 output)
    scores 0.0, and of a label that occurs twice the last entry counts.
    """
    def last(field: str) -> Column:
        found = F.filter(col_(raw), lambda x: F.lower(x["label"]) == F.lit(field))
        return F.coalesce(F.try_element_at(found, F.lit(-1))["score"], F.lit(0.0))

    return F.struct(*[last(f).alias(f) for f in SCORE_FIELDS])


def raw_to_scores(res) -> dict:
    """Python twin of ``label_list_to_columns`` for one model result."""
    out = {f: 0.0 for f in SCORE_FIELDS}
    if isinstance(res, dict):
        out[res["label"].lower()] = float(res["score"])
    else:
        for item in res:
            out[item["label"].lower()] = float(item["score"])
    return out


class ModelScorer:
    """A learned classifier through ``predict_batch_udf``.

    Failures are handled per row: when a batch raises, its rows are retried
    one by one and only the rows that still fail get the (0, 0, 1) fallback
    plus ``score_error``.
    """

    reports_errors = True

    def __init__(self, loader: Callable[[], Callable], batch_size: int = SENTIMENT_BATCH_SIZE,
                 max_chars: int | None = SENTIMENT_CHAR_LIMIT):
        self.loader = loader
        self.batch_size = batch_size
        self.max_chars = max_chars

    def _make_predict_fn(self):
        loader = self.loader

        def make():
            model = loader()

            def one(text):
                try:
                    return raw_to_scores(model([text])[0]), None
                except Exception as exc:  # per-row fallback
                    pos, neg, neu = FALLBACK_SCORES
                    return {"positive": pos, "negative": neg, "neutral": neu}, f"{type(exc).__name__}: {exc}"

            def predict(texts: np.ndarray):
                batch = [str(t) for t in texts]
                try:
                    rows = [(raw_to_scores(r), None) for r in model(batch)]
                except Exception:
                    rows = [one(t) for t in batch]
                return {
                    **{f: np.array([r[0][f] for r in rows], dtype=np.float64) for f in SCORE_FIELDS},
                    "score_error": np.array([r[1] for r in rows], dtype=object),
                }

            return predict

        return make

    def expr(self, text: Column | str) -> Column:
        from pyspark.ml.functions import predict_batch_udf

        udf = predict_batch_udf(self._make_predict_fn(), return_type=SCORE_TYPE, batch_size=self.batch_size)
        t = col_(text)
        if self.max_chars is not None:
            t = truncate(t, self.max_chars)
        return F.when(col_(text).isNull(), fallback_struct(None)).otherwise(udf(t))


# ---------------------------------------------------------------------------
# A stub model with the raw-output shape of a text-classification pipeline.
# Used to exercise ModelScorer end to end without weights.
# ---------------------------------------------------------------------------

def lexicon_model_loader(fail_on: str | None = "fly ash"):
    """Loader for a stub classifier.

    Returns all three labels (upper-case, as some pipelines do) with the
    lexicon probabilities. A batch holding a text that contains ``fail_on``
    raises, as a model would on bad input, to exercise the fallback.
    """
    pos, neg = sorted(set(POSITIVE_WORDS)), sorted(set(NEGATIVE_WORDS))

    def load():
        count = token_counter([*pos, *neg])

        def model(texts: list[str]):
            if fail_on is not None and any(fail_on in t.lower() for t in texts):
                raise ValueError(f"cannot score text containing {fail_on!r}")
            out = []
            found = count(texts)
            for p, n in zip(found[:, :len(pos)].sum(axis=1).tolist(), found[:, len(pos):].sum(axis=1).tolist()):
                z = p + n + 1.0
                out.append([{"label": "POSITIVE", "score": p / z}, {"label": "NEGATIVE", "score": n / z},
                            {"label": "NEUTRAL", "score": 1 / z}])
            return out

        return model

    return load


def save_lexicon_weights(folder: str, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> None:
    """The stub classifier's parameters as a weights file, ``words.npz``."""
    np.savez(f"{folder}/words.npz", words=np.array([*positive, *negative]), signs=np.array([1] * len(positive) + [-1] * len(negative)))


def lexicon_from_weights(folder: str):
    """The stub classifier made of a folder of weights (``shipping.weights_loader``)."""
    with np.load(f"{folder}/words.npz") as data:
        sign = dict(zip(data["words"].tolist(), data["signs"].tolist()))
    token = re.compile(LEXICAL_TOKEN)

    def model(texts: list[str]):
        out = []
        for t in texts:
            found = [sign.get(w, 0) for w in token.findall(t.lower())]
            p, n = found.count(1), found.count(-1)
            z = p + n + 1.0
            out.append([{"label": "Positive", "score": p / z}, {"label": "Negative", "score": n / z}, {"label": "Neutral", "score": 1 / z}])
        return out

    return model
