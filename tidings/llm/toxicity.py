"""Operator 13, toxicity: a counterfactual-regularised classifier.

A word's logit is the sum of the weights of its features (the hashed word and its
character 3- to 5-grams, edges marked), divided by the root of their number. A
sentence is as toxic as its worst word, a text as its worst sentence, so a
short insult in a long text isn't averaged away. The score is a calibrated logistic
of that maximum, at least 0 (an empty text has 0).

Training: weights start as smoothed log odds of a feature's document frequencies in
toxic and clean texts, then follow stochastic gradient descent in numpy on the logistic
loss. *Counterfactuals*: every sentence of a sampled labelled text that names a
group (``IDENTITY``) is rewritten with each other term of its list, and the squared
change of the sentence's summed word logits is penalised, ``strength`` times (its
maximum would hide the group behind an insult beside it). Each list ends with a
neutral word that the penalty doesn't move, so a term that occurs in toxic texts
only is pulled to that word's logit, not merely to that of other groups.

Learning reads labels of rows in the learning folds only: at most ``per_class``
texts of each label value, picked by a hash of the id, and of these, in hash order,
as many as ``sample_bytes`` of text hold (the documented bounds of the sample, which
is made of distinct words in the tasks). One in five of the sample is kept out of
the descent and sets the logistic's scale and offset.

Defined results: null and empty texts score as texts without any known word;
without labelled rows every score is 0.5; with one label value only 0.95 or 0.05;
several labels of an id count as their maximum, null labels are ignored; repeated
rows are each scored; a null id is never held out and never learned from; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import column_bytes, fold_of, mix64, packs, small, table
from tidings.llm.language import sample_ids, within_bytes

#: Terms that may be exchanged for each other; the last of each list is neutral.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "people"),
    ("woman", "man", "girl", "boy", "mother", "father", "wife", "husband", "person"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "believers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "religious"),
    ("africans", "asians", "europeans", "americans", "arabs", "latinos", "immigrants", "refugees", "neighbours"),
    ("african", "asian", "european", "american", "arab", "latino", "black", "white", "foreign", "local"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "married"),
    ("blind", "deaf", "disabled", "autistic", "old", "young", "elderly", "ordinary"),
)
BITS = 18
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")
_GRAMS = (3, 4, 5)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2B


def word_features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded texts to (text number of every word, word number and bucket of every feature)."""
    joined = b" " + b" ".join(parts) + b"      "
    buf = np.frombuffer(joined, np.uint8)
    inside = buf != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    limits = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(limits, start, side="left")
    word = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]])) - 1  # of a non-blank byte
    n = len(buf)
    forward = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * forward)])
    whole = mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    down = np.uint64(64 - BITS)
    words, buckets = [np.arange(len(start))], [(whole >> down).astype(np.int64)]
    wide = buf.astype(np.uint64)
    value = wide[:-1] | (wide[1:] << np.uint64(8))
    clear = inside[1:-1]  # bytes 1 to n-2 of the gram are not blank
    for size in _GRAMS:
        value = value[:-1] | (wide[size - 1:] << np.uint64(8 * (size - 1)))
        if size > _GRAMS[0]:
            clear = clear[:-1] & inside[size - 2: size - 2 + len(clear) - 1]
        at = np.flatnonzero(clear)
        words.append(word[at + 1])
        buckets.append((mix64(value[at] * _SALT + np.uint64(size)) >> down).astype(np.int64))
    return owner, np.concatenate(words), np.concatenate(buckets)


def _word_logits(weights: np.ndarray, words: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    number = np.bincount(words, minlength=n)
    return np.bincount(words, weights=weights[buckets], minlength=n) / np.sqrt(np.maximum(number, 1))


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, one per bucket
    scale: float
    offset: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """The worst word's logit of every text, at least 0."""
        worst = np.zeros(len(texts))
        for rows, parts in packs([t.translate(_FOLD) for t in texts]):
            owner, words, buckets = word_features(parts)
            if len(owner):
                z = _word_logits(self.weights, words, buckets, len(owner))
                np.maximum.at(worst, np.asarray(rows)[owner], z)
        return worst

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.scale * self.logits(texts) - self.offset)


def _logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


# -- training --------------------------------------------------------------------

class _Vocabulary:
    """The features of every distinct word of the sample, by word number."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        found = []
        for at in range(0, len(words), 20_000):
            _, w, b = word_features(words[at:at + 20_000])
            found.append((w + at, b))
        word, bucket = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        self.bucket = bucket[order]
        self.edge = np.searchsorted(word[order], np.arange(len(words) + 1))

    def of(self, word: int) -> np.ndarray:
        return self.bucket[self.edge[word]:self.edge[word + 1]]

    def logits(self, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        size = self.edge[rows + 1] - self.edge[rows]
        first = np.cumsum(size) - size
        at = np.repeat(self.edge[rows] - first, size) + np.arange(size.sum())
        return np.add.reduceat(weights[self.bucket[at]], first) / np.sqrt(size)


def train_toxicity(samples: list[tuple[bytes, list[bytes]]], labels: np.ndarray, groups=IDENTITY, strength: float = 1.0,
                   epochs: int = 6, rate: float = 0.3, prior: float = 2.0, seed: int = 1) -> ToxicityModel:
    """samples: per text its distinct words and, per sentence that names a group,
    the sentence's distinct words (blank-separated, folded)."""
    terms = {w.encode(): [o.encode() for o in g] for g in groups for w in g}
    named = {w for words, sentences in samples if sentences for w in terms}
    words = sorted({w for text, _ in samples for w in text.split()} | named)
    vocabulary = _Vocabulary(words)
    number = vocabulary.number
    bags = [np.array(sorted(number[w] for w in text.split()), np.int64) for text, _ in samples]
    aside = np.arange(len(samples)) % 5 == 4
    if len(set(labels[~aside].tolist())) < 2 or len(set(labels[aside].tolist())) < 2:
        aside[:] = False

    # Log odds of document frequencies; a feature not seen has weight 0.
    share = [max(float(np.mean(labels[~aside] == y)), 1e-9) for y in (0, 1)]
    seen = [np.full(1 << BITS, prior * share[y]) for y in (0, 1)]
    for i in np.flatnonzero(~aside):
        if len(bags[i]):
            found = np.unique(np.concatenate([vocabulary.of(w) for w in bags[i]]))
            seen[labels[i]][found] += 1.0
    weights = np.log(seen[1] / share[1]) - np.log(seen[0] / share[0])

    def worst(rows: np.ndarray) -> tuple[float, int]:
        if not len(rows):
            return 0.0, -1
        z = vocabulary.logits(weights, rows)
        at = int(z.argmax())
        return (float(z[at]), int(rows[at])) if z[at] > 0 else (0.0, -1)

    def move(word: int, by: float) -> None:
        if word >= 0:
            f = vocabulary.of(word)
            np.add.at(weights, f, by / np.sqrt(len(f)))

    neutral = {g[-1].encode() for g in groups}
    swaps = [[] for _ in samples]  # (term, other, whether the other is neutral) of every rewritten sentence
    for i, (_, sentences) in enumerate(samples):
        for sentence in sentences:
            here = set(sentence.split())
            swaps[i] += [(number[term], number[other], other in neutral) for term in sorted(here & terms.keys() - neutral)
                         for other in terms[term] if other not in here]

    rng = np.random.default_rng(seed)
    pick = np.flatnonzero(~aside)
    offset = 3.0
    steps, done = max(epochs * len(pick), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(pick):
            pace = rate * (1.0 - done / steps)
            done += 1
            z, word = worst(bags[i])
            wrong = float(_logistic(z - offset)) - float(labels[i])
            move(word, -pace * wrong)
            offset += 0.1 * pace * wrong
            for term, other, fixed in swaps[i]:
                za, zb = vocabulary.logits(weights, np.array([term, other]))
                change = strength * pace / len(swaps[i]) * float(za - zb)
                move(term, -change)
                if not fixed:
                    move(other, change)
    use = np.flatnonzero(aside) if aside.any() else pick
    z = np.array([worst(bags[i])[0] for i in use])
    scale, offset = _calibrated(z, labels[use])
    return ToxicityModel(weights.astype(np.float32), scale, offset)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and middle of the logistic with the least log loss; classes weigh the
    same, and one smoothed case each keeps separable classes finite."""
    best = (np.inf, 1.0, 3.0)
    ends = [float(np.quantile(z[y == c], q)) for c in (0, 1) for q in (0.01, 0.5, 0.99)]
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    eps = 1.0 / (len(y) + 2)
    target = y * (1 - 2 * eps) + eps
    for scale in np.geomspace(0.25, 8.0, 21):
        for middle in np.linspace(min(ends), max(ends), 61):
            p = np.clip(_logistic(scale * (z - middle)), 1e-12, 1 - 1e-12)
            loss = float(-(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum())
            best = min(best, (loss, float(scale), float(scale * middle)))
    return best[1], best[2]


# -- on Spark --------------------------------------------------------------------

def _distinct(text: bytes) -> bytes:
    return b" ".join(sorted(set(text.translate(_FOLD).split())))


def _sampled(docs: DataFrame, ids: list[tuple], groups, sample_bytes: int) -> tuple[list, np.ndarray]:
    """Distinct words and group sentences of the texts in ``ids`` (a bounded list), one per id."""
    if not ids:
        return [], np.zeros(0, int)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    terms = {w.encode() for g in groups for w in g}
    wanted = spark.createDataFrame([(i, int(y)) for i, y in ids], ["id", "label"]).select(F.col("id").cast(kind).alias("id"), F.col("label").cast("int").alias("label"))
    held = (docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(wanted), "id")
            .groupBy("id", "label").agg(F.min("text").alias("text")))
    within = within_bytes(held, sample_bytes, 2)

    def work(batches):
        for batch in small(batches):
            texts = column_bytes(batch, "text")
            sentences = []
            for text in texts:
                low = text.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
                hit = any(t in low for t in terms)
                some = {_distinct(s) for s in _SENTENCE.split(low)} if hit else ()
                sentences.append(sorted(s for s in some if terms.intersection(s.split())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([_distinct(t) for t in texts], pa.binary()), pa.array(sentences, pa.list_(pa.binary()))],
                names=["id", "label", "words", "sentences"])

    made = (held.join(F.broadcast(within), "id", "left_semi").select("id", "label", "text")
            .mapInArrow(work, f"id {kind.simpleString()}, label int, words binary, sentences array<binary>").collect())
    made.sort(key=lambda r: str(r["id"]))
    return [(bytes(r["words"]), [bytes(s) for s in r["sentences"]]) for r in made], np.array([r["label"] for r in made], int)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, sample_bytes: int = 32 << 20,
                 groups=IDENTITY, strength: float = 1.0) -> ToxicityModel | float:
    """docs: doc_id, text; labels: doc_id, toxic; learn: a condition on doc_id.
    Returns a model, or the score to give where there is nothing to tell apart."""
    labelled = (labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
                .groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("label")))
    samples, y = _sampled(docs, sample_ids(labelled, per_class, 2), groups, sample_bytes)
    if len(set(y.tolist())) < 2:
        return 0.5 if not len(y) else 0.95 if y[0] else 0.05
    return train_toxicity(samples, y, groups, strength)


def predict_toxicity(docs: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """doc_id and score of every row, from its whole text alone."""

    def work(batches):
        for batch in small(batches):
            texts = column_bytes(batch, "text")
            score = np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"))


def op13_toxicity(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.coalesce(fold_of(F.col("doc_id"), 3) != 1, F.lit(False))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn)
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
