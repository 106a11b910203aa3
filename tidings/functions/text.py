"""Text Column expressions: truncation, stripping, tokens, count statistics.

Everything here is a native Spark expression (JVM side, no Python UDF).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.config import LEXICAL_TOKEN, WORD_TOKEN

# Python's str.strip() removes every character for which isspace() is true;
# Java's (?U)\s covers the Unicode White_Space set, the extra class adds the
# four ASCII separators Python also counts as space.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(text: Column | str, n: int) -> Column:
    """First ``n`` characters (code points), like ``s[:n]``."""
    return F.substring(col_(text), 1, n)


def strip(text: Column | str) -> Column:
    """Unicode-aware strip matching Python ``str.strip()``."""
    return F.regexp_replace(col_(text), _STRIP, "")


def abbreviate(text: Column | str, n: int) -> Column:
    """First ``n`` characters, plus ``...`` when the text is longer."""
    t = col_(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def words(text: Column | str) -> Column:
    """Blank-separated words (attribution players are runs of these)."""
    return F.regexp_extract_all(col_(text), F.lit(WORD_TOKEN), 0)


def lexical_tokens(text: Column | str, lowered: bool = False) -> Column:
    """Lower-case letter/digit runs used by the lexicon and bag-of-words scorers."""
    t = col_(text) if lowered else F.lower(col_(text))
    return F.regexp_extract_all(t, F.lit(LEXICAL_TOKEN), 0)


def _token_pattern(vocabulary) -> str | None:
    """A regex that matches exactly the lexical tokens in ``vocabulary``.

    Tokens are maximal runs of LEXICAL_TOKEN's character class, so a word is
    a token when no token character touches it on either side. Words that
    are not tokens themselves can never equal one and are left out.
    """
    assert LEXICAL_TOKEN.endswith("+")
    char = LEXICAL_TOKEN[:-1]
    vocab = sorted({w for w in vocabulary if re.fullmatch(LEXICAL_TOKEN, w)})
    if not vocab:
        return None
    return f"(?<!{char})(?:{'|'.join(vocab)})(?!{char})"


def word_hits(lowered: Column, vocabulary) -> Column:
    """The lexical tokens of ``lowered`` that belong to ``vocabulary``, in text order."""
    pattern = _token_pattern(vocabulary)
    if pattern is None:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(lowered, F.lit(pattern), 0)


def count_words(lowered: Column, vocabulary) -> Column:
    """How many lexical tokens of ``lowered`` belong to ``vocabulary``.

    Same number as ``count_in(lexical_tokens(text), vocabulary)``, but one
    compiled regex scan (whole-stage codegen) instead of a lambda per token.
    """
    return F.size(word_hits(lowered, vocabulary))


def weighted_words(lowered: Column, weights: dict[str, int]) -> Column:
    """sum(weights[t]) over the lexical tokens of ``lowered``."""
    if len(set(weights.values())) == 1:
        return count_words(lowered, tuple(weights)) * F.lit(next(iter(weights.values())))
    return weighted_count(word_hits(lowered, tuple(weights)), weights)


def count_in(tokens: Column, vocabulary: tuple[str, ...]) -> Column:
    """How many elements of ``tokens`` belong to ``vocabulary`` (with repeats)."""
    return F.size(F.filter(tokens, lambda t: t.isin(*vocabulary)))


def weighted_count(tokens: Column, weights: dict[str, int]) -> Column:
    """sum(weights[t] for t in tokens), 0 for tokens outside the map."""
    if len(set(weights.values())) == 1:
        return count_in(tokens, tuple(weights)) * F.lit(next(iter(weights.values())))

    def weight(t: Column) -> Column:
        expr = F.lit(0)
        for word, w in weights.items():
            expr = F.when(t == F.lit(word), F.lit(w)).otherwise(expr)
        return expr

    return F.aggregate(tokens, F.lit(0), lambda acc, t: acc + weight(t))


def let(value: Column, body) -> Column:
    """Evaluate ``body(v)`` with ``value`` computed once per row.

    The value is bound as a lambda variable, so a body that reads it many
    times (or inside another lambda) does not re-evaluate it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sum_of_squared_counts(tokens: Column) -> Column:
    """sum(count(t)**2) over the distinct values of ``tokens``.

    On the sorted array the k-th element of a run of equal values adds
    2k-1, and 1 + 3 + ... + (2c-1) = c*c, so one ordered pass suffices.
    Runs inside the row: no explode, no shuffle.
    """
    init = F.struct(
        F.lit(None).cast("string").alias("prev"),
        F.lit(0).cast("long").alias("run"),
        F.lit(0).cast("long").alias("acc"),
    )

    def step(state: Column, t: Column) -> Column:
        run = F.when(t == state["prev"], state["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(t.alias("prev"), run.alias("run"), (state["acc"] + run * 2 - 1).alias("acc"))

    return F.aggregate(F.array_sort(tokens), init, step, lambda s: s["acc"])
