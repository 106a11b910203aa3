"""Averaged hashed subword embeddings with a softmax output (numpy).

A text is the average of the embeddings of its features: hashed character
n-grams (2 to 4 bytes, spaces included) and, optionally, hashed words and
hashed pairs of neighbouring words. The
model is ``softmax(W . mean(E[features]) + b)``, trained by stochastic
gradient descent. Because the output is linear in the average, prediction
folds ``E @ W`` into one score table of ``buckets x classes`` and adds up
table rows; features never leave the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidings.llm.common import mix64, packs

_GRAM = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA6B), 4: np.uint32(0xC2B2AE35)}
_RATIO = 0x5851F42D4C957F2B  # odd base of the rolling word hash
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))


@dataclass
class Features:
    """How bytes become feature numbers below ``2**bits``."""

    bits: int
    words: bool
    table: bytes  # 256-byte translation applied first (case folding, separators)

    def _word_hashes(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Start and bucket of every run of non-space bytes, and of every pair
        of neighbours within a text."""
        solid = buf != 32
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1  # buf starts and ends with a space
        start, end = edge[::2], edge[1::2]
        n = len(buf)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * _powers(_RATIO, n))])
        value = mix64((total[end] - total[start]) * _powers(pow(_RATIO, -1, 1 << 64), n)[start] + (end - start).astype(np.uint64))
        pair = mix64(value[1:] ^ value[:-1])  # 0 before mixing: a word repeated, whichever it is
        down = np.uint64(64 - self.bits)
        owner = np.searchsorted(offsets, start, side="right")
        near = np.flatnonzero(owner[1:] == owner[:-1])
        return [(start, (value >> down).astype(np.int64)), (start[near + 1], (pair[near] >> down).astype(np.int64))]

    def of(self, parts: list[bytes]):
        """For texts joined with spaces: ``(offsets, [(positions, buckets)])``
        where text i owns positions offsets[i] to offsets[i + 1]."""
        joined = b" " + b"    ".join(p.translate(self.table) for p in parts) + b"        "
        buf = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(p) + 4 for p in parts], np.int64)  # no n-gram reaches the next text
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        last = int(offsets[-1])
        found = []
        value = buf[:last].astype(np.uint32)
        shift = np.uint32(32 - self.bits)
        same = buf[: last + 1] == 32
        # A feature starts at a position of the text's own span; runs of spaces
        # (separators between texts) start none.
        blank = same[:last] & (buf[1 : last + 1] == 32)
        keep = np.flatnonzero(~blank)
        for n in (2, 3, 4):
            value = value | (buf[n - 1 : last + n - 1].astype(np.uint32) << np.uint32(8 * (n - 1)))
            found.append((keep, ((value[keep] * _GRAM[n]) ^ (value[keep] >> np.uint32(15))) * _GRAM[2] >> shift))
        if self.words:
            found.extend(self._word_hashes(buf, offsets))
        return offsets, found

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers of one text, and their shares (sum 1)."""
        ids = np.concatenate([np.asarray(b, np.int64) for _, part in packs([text]) for _, b in self.of(part)[1]] or
                             [np.zeros(0, np.int64)])
        if not len(ids):
            return np.zeros(0, np.uint32), np.zeros(0, np.float32)
        values, n = np.unique(ids, return_counts=True)
        return values.astype(np.uint32), (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    features: Features
    classes: list
    scores: np.ndarray  # buckets x classes, float32: E @ W
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0  # top probability below which a prediction is rejected

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One row per text; a text without features scores the bias alone."""
        total = np.zeros((len(texts), len(self.classes)))
        number = np.zeros(len(texts))
        for rows, parts in packs(texts):
            offsets, found = self.features.of(parts)
            at = np.asarray(rows)
            for where, bucket in found:
                if not len(where):
                    continue
                edge = np.searchsorted(where, offsets)
                np.add.at(number, at, np.diff(edge))
                for c in range(len(self.classes)):
                    run = np.concatenate([np.zeros(1), np.cumsum(self.scores[bucket, c], dtype=np.float64)])
                    np.add.at(total[:, c], at, run[edge[1:]] - run[edge[:-1]])
        return total / np.maximum(number, 1)[:, None] + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(features: Features, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: list, dim: int = 16,
          epochs: int = 5, rate: float = 60.0, seed: int = 1) -> Model:
    """Stochastic gradient descent, one text a step, linearly falling rate.

    rows: (feature numbers, shares) per text. An average of a thousand
    embeddings moves each by a thousandth, hence the large rate on E.
    """
    rng = np.random.default_rng(seed)
    buckets, k = 1 << features.bits, len(classes)
    table = rng.uniform(-0.5, 0.5, (buckets, dim)).astype(np.float32)
    weight = rng.uniform(-0.5, 0.5, (dim, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    steps = epochs * len(rows)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            pace = 1.0 - done / steps
            done += 1
            if not len(ids):
                continue
            vectors = table[ids]
            hidden = share @ vectors
            wrong = softmax((hidden @ weight + bias).astype(np.float64)).astype(np.float32)
            wrong[labels[i]] -= 1.0
            back = weight @ wrong
            weight -= np.float32(0.5 * pace) * np.outer(hidden, wrong)
            bias -= np.float32(0.05 * pace) * wrong
            table[ids] = vectors - np.float32(rate * pace) * np.outer(share / max(float(np.sqrt(share @ share)), 1e-6), back) * np.float32(0.05)
    return Model(features, classes, (table @ weight).astype(np.float32), bias.astype(np.float64))


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, keep: float = 0.99) -> Model:
    """Temperature with the least log loss on rows not trained on, and the top
    probability that ``keep`` of their right predictions reach."""
    if not rows:
        return model
    z = np.array([share.astype(np.float64) @ model.scores[ids] + model.bias for ids, share in rows])
    grid = np.geomspace(0.2, 20.0, 41)
    at = np.arange(len(rows))
    loss = [-np.log(np.maximum(softmax(z / t)[at, labels], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == labels]
    model.accept = float(np.quantile(right, 1.0 - keep)) if len(right) else 1.0
    return model
