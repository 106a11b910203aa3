"""Vector expressions over ``array<float|double>`` columns, and token codes
of text blocks for the Arrow-batched counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import col_


def dot(a: Column, b: Column) -> Column:
    """sum(a[i] * b[i]) accumulated in double."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Unclamped cosine similarity; 0 when either vector has zero length."""
    a, b = col_(a), col_(b)
    denom = norm(a) * norm(b)
    return F.when(denom == 0, F.lit(0.0)).otherwise(dot(a, b) / denom)


def literal_vector(values: Sequence[float]) -> Column:
    """A constant vector, folded into the plan once (the anchor)."""
    return F.array(*[F.lit(float(v)) for v in values])


_TOKEN_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
_BYTE_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C13
_POWERS = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


#: Powers of the base and of its inverse, for texts up to that length.
_FORWARD, _BACK = _powers(_BASE, _POWERS), _powers(pow(_BASE, -1, 1 << 64), _POWERS)


def byte_blocks(texts, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts (null: empty) in blocks of about ``size`` bytes, with
    the number of each block's first text."""
    first, block, total = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode() if isinstance(text, str) else b""
        if block and total + len(data) > size:
            yield first, block
            first, block, total = i, [], 0
        block.append(data)
        total += len(data)
    if block:
        yield first, block


def arrow_blocks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """``byte_blocks`` of an Arrow column: of a batch of any length only a few texts
    at a time are Python objects."""
    first, block, total = 0, [], 0
    for at in range(0, len(texts), 64):
        for i, data in enumerate(texts.slice(at, 64).cast(pa.binary()).to_pylist(), at):
            data = data or b""
            if block and total + len(data) > size:
                yield first, block
                first, block, total = i, [], 0
            block.append(data)
            total += len(data)
    if block:
        yield first, block


def token_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit code of every lexical token (run of a-z, 0-9) of
    lower-cased UTF-8 bytes that end in another byte: a rolling hash read off one
    running sum, so there is no loop over tokens."""
    inside = np.concatenate([[False], _TOKEN_BYTE[buf]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    n = len(buf)
    forward, back = (_FORWARD[:n], _BACK) if n <= _POWERS else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[buf] * forward)])
    return start, (total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)


def token_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and code (``token_spans``) of every lexical token of
    lower-cased UTF-8 texts, in text order."""
    start, code = token_spans(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    offsets = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(offsets, start, side="right"), code


def _lowered(text: str) -> bytes:
    """Lower-cased bytes with the lexical tokens of ``text.lower()``. Two letters beyond
    ASCII have ASCII in their lower case; without them lowering A-Z is enough."""
    return (text.lower() if "\u0130" in text or "\u212a" in text else text).encode(errors="replace").lower()


def token_counter(words: Sequence[str]) -> Callable[[list[str]], np.ndarray]:
    """A function of texts: how often each word is a lexical token of each (texts x words)."""
    at = [j for j, w in enumerate(words) if w and w.isascii() and w.isalnum() and w == w.lower()]
    codes = token_codes([words[j].encode() for j in at])[1]
    order = np.argsort(codes)
    codes, column = codes[order], np.array(at, np.int64)[order]
    seen = np.zeros(1 << 12, bool)
    seen[(codes & np.uint64(0xFFF)).astype(np.int64)] = True

    def count(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(words)), np.int64)
        if len(texts) and len(codes):
            lowered = [_lowered(t) for t in texts]
            start, code = token_spans(np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8))
            likely = np.flatnonzero(seen[(code & np.uint64(0xFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(codes, code[likely]), len(codes) - 1)
            hit = codes[place] == code[likely]
            row = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), start[likely[hit]], side="right")
            np.add.at(out, (row, column[place[hit]]), 1)
        return out

    return count
