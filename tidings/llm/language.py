"""Operator 4, language identification.

Averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy, with calibrated rejection.

Learning reads only (text, lang) of documents in the learning folds: at most
``per_lang`` documents of each language, and ``sample_rows`` in all (then fewer of
each), picked by a hash of the id, so reruns agree; of these, in hash order, as many as
``SAMPLE_BYTES`` of text hold. That sample is the documented
bound on what reaches the driver; features are made in the tasks. Every language is
learned: with more than 256 the features are hashed to fewer buckets, so that
buckets x languages, the size of the model, keeps its bound. One document
in five of the sample is kept out of the descent to fit the temperature and
the rejection threshold.

Defined results: null text or a text without a letter gives ``und`` with score
0; a table without labelled documents gives ``und`` everywhere; a null id is
never held out and never learned from; repeated ids are learned from once and
each row is predicted; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import string
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import column_bytes, fold_of, small
from tidings.llm.subword import Features, Model, calibrate, train

_FOLD = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b >= 128 else 32 for b in range(256))
#: Text that a sample of labelled documents may hold, shared by its labels.
SAMPLE_BYTES = 32 << 20
FEATURES = Features(bits=16, words=False, table=_FOLD)


def sample_ids(labelled: DataFrame, per_class: int, max_classes: int | None = None, sample_rows: int | None = None) -> list[tuple]:
    """At most ``per_class`` (expected) ids of each label (of the ``max_classes`` most
    frequent), fewer where all labels would have more than ``sample_rows``.

    labelled: columns id, label, neither null, one row per id. The counts are
    partial aggregates; what is collected is bounded by the two parameters.
    """
    counts = labelled.groupBy("label").count().orderBy(F.desc("count"), "label")
    counts = (counts if max_classes is None else counts.limit(max_classes)).collect()
    if not counts:
        return []
    if sample_rows is not None:
        per_class = max(1, min(per_class, sample_rows // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, per_class / r["count"])))])
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = (labelled.filter(F.col("label").isin([r["label"] for r in counts]))
              .filter(part < share[F.col("label")])
              .orderBy(F.xxhash64("id"), "id").limit(2 * per_class * len(counts)).collect())
    return [(r["id"], r["label"]) for r in picked]


def within_bytes(sampled: DataFrame, sample_bytes: int, labels: int) -> DataFrame:
    """The ids of sampled texts (id, label, text: a bounded number of rows) whose
    label's texts, in hash order, hold up to its share of ``sample_bytes``; a label's
    first text always counts."""
    ahead = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    sized = sampled.select("id", "label", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    upto = sized.withColumns({"upto": F.sum("size").over(ahead), "nth": F.row_number().over(ahead)})
    return upto.filter((F.col("upto") <= F.lit(sample_bytes // max(labels, 1))) | (F.col("nth") == 1)).select("id")


def feature_rows(docs: DataFrame, ids: list[tuple], features: Features, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id, label (as text), numbers, shares: the features of the documents in ``ids``
    (a bounded list of ids and labels, not empty), one row per id, as many as
    ``sample_bytes`` of text hold."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    wanted = spark.createDataFrame([(i, str(y)) for i, y in ids], ["id", "label"]).select(F.col("id").cast(kind).alias("id"), "label")

    def work(batches):
        for batch in small(batches):
            rows = [features.counts(t) for t in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([b.tobytes() for _, b in rows], pa.binary())],
                names=["id", "label", "numbers", "shares"])

    held = (docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(wanted), "id")
            .groupBy("id", "label").agg(F.min("text").alias("text")))
    small_enough = within_bytes(held, sample_bytes, len({y for _, y in ids}))
    return (held.join(F.broadcast(small_enough), "id", "left_semi").select("id", "label", "text")
            .mapInArrow(work, f"id {kind.simpleString()}, label string, numbers binary, shares binary"))


def sample_features(docs: DataFrame, ids: list[tuple], features: Features, sample_bytes: int = SAMPLE_BYTES) -> tuple[list, list]:
    """What ``feature_rows`` has, in the order of the ids as text, and the labels."""
    if not ids:
        return [], []
    made = feature_rows(docs, ids, features, sample_bytes).select("id", F.struct("numbers", "shares").alias("f")).collect()
    label = dict(ids)
    made.sort(key=lambda r: str(r["id"]))
    return ([(np.frombuffer(r["f"]["numbers"], np.uint32), np.frombuffer(r["f"]["shares"], np.float32)) for r in made],
            [label[r["id"]] for r in made])


def buckets_for(languages: int) -> int:
    """Bits of the feature hash: 16 up to 256 languages, one less per doubling."""
    return max(8, FEATURES.bits - max(0, (languages - 1).bit_length() - 8))


def fit_language(docs: DataFrame, learn: Column, per_lang: int = 500, sample_rows: int = 128_000, dim: int = 16) -> Model | None:
    """docs: doc_id, text, lang. learn: which rows may be learned from."""
    labelled = (docs.filter(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
                .groupBy(F.col("doc_id").alias("id")).agg(F.min("lang").alias("label")))
    ids = sample_ids(labelled, per_lang, sample_rows=sample_rows)
    features = replace(FEATURES, bits=buckets_for(len({y for _, y in ids})))
    rows, labels = sample_features(docs, ids, features)
    if not rows:
        return None
    classes = sorted(set(labels))
    y = np.array([classes.index(v) for v in labels])
    aside = np.arange(len(rows)) % 5 == 4
    pick = [i for i in range(len(rows)) if not aside[i]] or list(range(len(rows)))
    model = train(features, [rows[i] for i in pick], y[pick], classes, dim)
    return calibrate(model, [r for r, a in zip(rows, aside) if a], y[aside])


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted (score reaches the calibrated
    threshold) of every row, from the whole text alone."""
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean"
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def work(batches):
        for batch in small(batches):
            texts = column_bytes(batch, "text")
            some = np.array(batch.column(2).to_pylist(), bool) if len(texts) else np.zeros(0, bool)
            langs, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None and some.any():
                p = model.probabilities([t for t, s in zip(texts, some) if s])
                langs[some] = np.array(model.classes, object)[p.argmax(axis=1)]
                score[some] = p.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(langs), pa.string()), pa.array(score), pa.array(some & (score >= (model.accept if model else 1.0)))],
                names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), letter.alias("letter")).mapInArrow(work, out)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    from tidings.llm.common import table

    docs = table(spark, sf_dir, "documents")
    learn = F.coalesce(fold_of(F.col("doc_id"), 4) != 2, F.lit(False))
    model = fit_language(docs.select("doc_id", "text", "lang"), learn)
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
