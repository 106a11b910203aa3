"""Operator 9, quality classifier.

Supervised subword embeddings: learned hashed word, word-pair and character
n-gram vectors averaged per document, softmax output, trained by numpy stochastic
gradient descent.

Learning reads labels only of rows in the learning folds, at most ``per_class``
of each label value, picked by a hash of the id, as many as 32 MB of text hold
(``language.SAMPLE_BYTES``; the documented sample bound).

Defined results: null and empty texts score the model's bias; without labelled
rows every score is 0.5; with one label value only, every score is 0.95 or
0.05; several labels of an id count as their maximum; null labels are ignored;
repeated rows are each scored; a null id is never held out and never learned
from; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import column_bytes, fold_of, small, table
from tidings.llm.language import feature_rows, sample_ids
from tidings.llm.subword import Features, Model, calibrate, train

_SPACES = bytes(32 if b in (9, 10, 11, 12, 13) else 48 if 48 <= b <= 57 else b for b in range(256))
FEATURES = Features(bits=17, words=True, table=_SPACES)


#: What the task that learns returns: a score for all texts, or a model.
_MADE = pa.schema([("same", pa.float64()), ("scores", pa.binary()), ("bias", pa.list_(pa.float64())), ("temperature", pa.float64()), ("accept", pa.float64())])


def learned(rows: list[tuple[np.ndarray, np.ndarray]], values: list[int], dim: int) -> Model | float:
    """A model from the features and labels of the sample, every fifth row kept
    aside, or the score to give where there is nothing to tell apart."""
    if len(set(values)) < 2:
        return 0.5 if not values else 0.95 if values[0] else 0.05
    y = np.array(values)
    aside = np.arange(len(rows)) % 5 == 4
    pick = np.flatnonzero(~aside)
    model = train(FEATURES, [rows[i] for i in pick], y[pick], [0, 1], dim)
    return calibrate(model, [rows[i] for i in np.flatnonzero(aside)], y[aside])


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1000, dim: int = 16) -> Model | float:
    """docs: doc_id, text; labels: doc_id, quality; learn: a condition on
    doc_id. Returns a model, or the score to give where there is nothing to
    tell apart. One task learns from the bounded sample; the driver gets the
    model only, never the sample."""
    labelled = (labels.filter(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
                .groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") > 0).cast("int").alias("label")))
    ids = sample_ids(labelled, per_class, 2)
    if not ids:
        return 0.5

    def learn_all(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "numbers", "shares")))]
        rows.sort(key=lambda r: str(r[0]))
        got = learned([(np.frombuffer(n, np.uint32), np.frombuffer(s, np.float32)) for _, _, n, s in rows], [int(y) for _, y, _, _ in rows], dim)
        one = {"same": got} if isinstance(got, float) else {
            "scores": got.scores.tobytes(), "bias": got.bias.tolist(), "temperature": got.temperature, "accept": got.accept}
        yield pa.RecordBatch.from_arrays([pa.array([one.get(f.name)], f.type) for f in _MADE], schema=_MADE)

    made = (feature_rows(docs, ids, FEATURES).repartition(1)
            .mapInArrow(learn_all, "same double, scores binary, bias array<double>, temperature double, accept double").collect())
    if not made:
        return 0.5
    if made[0]["same"] is not None:
        return made[0]["same"]
    one = made[0]
    return Model(FEATURES, [0, 1], np.frombuffer(one["scores"], np.float32).reshape(-1, 2), np.array(one["bias"]), one["temperature"], one["accept"])


def predict_quality(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score (probability of label 1) of every row."""

    def work(batches):
        for batch in small(batches):
            texts = column_bytes(batch, "text")
            score = np.full(len(texts), model) if isinstance(model, float) else model.probabilities(texts)[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"))


def _model(docs: DataFrame, spark, sf_dir: str) -> Model | float:
    learn = F.coalesce(fold_of(F.col("doc_id"), 5) != 0, F.lit(False))
    return fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"), learn)


def op9_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return predict_quality(docs, _model(docs, spark, sf_dir)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Pipeline stage: documents that the classifier doesn't reject, all their
    columns unchanged. Scoring happens in the pass that filters (a filter on a
    row-wise function of the text): no join and no shuffle."""
    model = _model(docs, spark, sf_dir)
    at = docs.columns.index("text")
    schema = docs.schema

    def work(batches):
        for batch in small(batches):
            texts = [(t or "").encode() if not isinstance(t, bytes) else t for t in batch.column(at).to_pylist()]
            score = np.full(len(texts), model) if isinstance(model, float) else model.probabilities(texts)[:, 1]
            yield batch.filter(pa.array(score >= threshold, pa.bool_()))

    return docs.mapInArrow(work, schema)
