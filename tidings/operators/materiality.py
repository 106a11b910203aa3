"""Materiality: similarity of each text to the ESG anchor.

* ``BowCosine`` (default) STANDS IN for a sentence encoder: bag-of-words
  cosine between the text and the anchor sentence,
  ``sum_{t in anchor} a_t*c_t / (sqrt(sum_t c_t^2) * |a|)``, 0 for a text
  without tokens. Computed inside the row: no explode, no shuffle. The
  anchor-word count is one compiled regex scan; sum_t c_t^2 comes from an
  Arrow-batched pandas UDF (token counter), or natively on request.
* ``VectorCosine`` scores precomputed vectors against an anchor vector that
  is read once (one row, bounded) and folded into the plan as a literal.
* ``EncoderCosine`` wraps a user encoder in ``predict_batch_udf``; the
  anchor is encoded once on the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.config import ENCODER_BATCH_SIZE, ESG_ANCHOR, LEXICAL_TOKEN
from tidings.functions.text import col_, lexical_tokens, sum_of_squared_counts, weighted_words
from tidings.functions.vectors import arrow_blocks, cosine, literal_vector, token_codes, token_counter


def anchor_counts(anchor: str = ESG_ANCHOR) -> dict[str, int]:
    """Token counts of the anchor sentence (same token rule as the texts)."""
    return dict(Counter(re.findall(LEXICAL_TOKEN, anchor.lower())))


@F.arrow_udf(T.LongType())
def squared_token_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """sum(count(t)**2) over the distinct lexical tokens of each lower-cased
    text (0 for null), Arrow-batched.

    Per-row token frequencies have no compiled built-in; the native form
    (``sum_of_squared_counts``: sort, then a lambda fold) runs interpreted at
    a few microseconds per token. Here all tokens of a block of texts are
    found, hashed and counted at once in numpy (``vectors.token_codes``). Memory is
    that of a block, whatever the size of an Arrow batch.
    """
    for lowered in batches:
        out = np.zeros(len(lowered), dtype=np.int64)
        for first, texts in arrow_blocks(lowered, 1 << 18):
            row, code = token_codes(texts)
            if len(row):
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
                count = np.diff(np.append(head, len(row)))
                out[first:first + len(texts)] = np.bincount(row[head], weights=count * count, minlength=len(texts))
        yield pa.array(out)


class BowCosine:
    """``vectorized=False`` keeps every step native (sort + lambda fold)."""

    def __init__(self, anchor: str = ESG_ANCHOR, vectorized: bool = True):
        self.anchor = anchor
        self.weights = anchor_counts(anchor)
        self.anchor_norm = math.sqrt(sum(v * v for v in self.weights.values()))
        self.vectorized = vectorized

    def from_stats(self, dot: Column, sumsq: Column) -> Column:
        if self.anchor_norm == 0:  # an anchor without tokens is similar to nothing
            return F.lit(0.0)
        return F.when(sumsq == 0, F.lit(0.0)).otherwise(
            dot.cast("double") / (F.sqrt(sumsq.cast("double")) * F.lit(self.anchor_norm)))

    def expr(self, text: Column | str) -> Column:
        lowered = F.lower(col_(text))
        dot = weighted_words(lowered, self.weights)
        if self.vectorized:
            sumsq = squared_token_counts(lowered)
        else:
            sumsq = sum_of_squared_counts(lexical_tokens(lowered, lowered=True))
        cos = self.from_stats(dot, sumsq)
        return F.when(col_(text).isNull(), F.lit(0.0)).otherwise(cos)


class VectorCosine:
    def __init__(self, anchor_vector):
        self.anchor = [float(x) for x in anchor_vector]

    @classmethod
    def from_table(cls, vectors: DataFrame, key_col: str, key, vec_col: str) -> "VectorCosine":
        """Anchor = the vector stored under ``key``; exactly one row is fetched."""
        rows = vectors.filter(F.col(key_col) == F.lit(key)).select(vec_col).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"expected one anchor row for {key_col} = {key!r}, got {len(rows)}")
        return cls(rows[0][0])

    def expr(self, vec: Column | str) -> Column:
        return cosine(col_(vec), literal_vector(self.anchor))


def anchor_vocabulary_encoder_loader(anchor: str = ESG_ANCHOR):
    """Loader for a stub sentence encoder: a text becomes the vector of counts
    of the anchor's distinct words (in first-seen order). Exercises the
    encoder adapter without weights."""
    vocab = list(dict.fromkeys(re.findall(LEXICAL_TOKEN, anchor.lower())))

    def load():
        count = token_counter(vocab)

        def encode(texts: list[str]):
            return count(texts).astype(np.float32)

        return encode

    return load


class EncoderCosine:
    """A learned sentence encoder through ``predict_batch_udf``."""

    def __init__(self, loader: Callable[[], Callable], anchor: str = ESG_ANCHOR, batch_size: int = ENCODER_BATCH_SIZE):
        self.loader = loader
        self.batch_size = batch_size
        self.anchor_vector = [float(x) for x in np.asarray(loader()([anchor]))[0]]

    def vectors(self, text: Column | str) -> Column:
        from pyspark.ml.functions import predict_batch_udf

        loader = self.loader

        def make():
            model = loader()

            def predict(texts: np.ndarray) -> np.ndarray:
                return np.asarray(model([str(t) for t in texts]), dtype=np.float32)  # never null, see expr

            return predict

        udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size,
                                input_tensor_shapes=None)
        return udf(F.coalesce(col_(text), F.lit("")))

    def expr(self, text: Column | str) -> Column:
        """0 for a null text, as in the other two backends."""
        score = cosine(self.vectors(text), literal_vector(self.anchor_vector))
        return F.when(col_(text).isNull(), F.lit(0.0)).otherwise(score)


def join_vectors(df: DataFrame, vectors: DataFrame, id_col: str, key_col: str, vec_col: str) -> DataFrame:
    """``df`` with the precomputed vector of each row's id (null: none): a left
    equi-join; the planner broadcasts the vectors only if their size allows."""
    right = vectors.select(F.col(key_col).alias("__key"), F.col(vec_col).alias(vec_col))
    return df.join(right, F.col(id_col) == F.col("__key"), "left").drop("__key")
