"""The per-row scoring chain: tag -> sentiment -> class -> materiality -> adjusted.

One lazy lineage of projections. The scorer's struct is computed once and
its three fields are read from it, so a model scorer runs once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.config import DEFAULT, Settings
from tidings.functions import scores as S
from tidings.operators.materiality import BowCosine
from tidings.operators.scorers import LexiconScorer
from tidings.operators.tag import require_headline, tag

OUTPUT_COLUMNS = (
    "company", "esg_flag", "noise_flag", "positive", "negative", "neutral",
    "cumulative_score", "sentiment", "materiality_score", "esg_adjusted_score",
)


def score(df: DataFrame, text_col: str = "Headline", scorer=None, materiality=None,
          settings: Settings = DEFAULT) -> DataFrame:
    """Add sentiment, class, materiality and adjusted score to a frame."""
    scorer = scorer or LexiconScorer(max_chars=settings.sentiment_chars)
    materiality = materiality or BowCosine(settings.anchor)
    s = "__scores"
    # A fitted pipeline transforms frames; the other scorers are Columns.
    out = scorer.add(df, text_col, s) if hasattr(scorer, "add") else df.withColumn(s, scorer.expr(F.col(text_col)))
    cols = [
        F.col(f"{s}.positive").alias("positive"),
        F.col(f"{s}.negative").alias("negative"),
        F.col(f"{s}.neutral").alias("neutral"),
    ]
    if getattr(scorer, "reports_errors", False):
        cols.append(F.col(f"{s}.score_error").alias("score_error"))
    out = out.select("*", *cols).drop(s)
    out = out.withColumn("cumulative_score", S.cumulative("positive", "negative"))
    out = out.withColumn("sentiment", S.sentiment_class("cumulative_score", settings.positive_threshold,
                                                         settings.negative_threshold))
    out = out.withColumn("materiality_score", materiality.expr(F.col(text_col)))
    out = out.withColumn("esg_adjusted_score",
                         S.adjusted(S.direction("positive", "negative"), "materiality_score"))
    return out


def analyze(df: DataFrame, text_col: str = "Headline", scorer=None, materiality=None,
            settings: Settings = DEFAULT, compat_nan: bool = False) -> DataFrame:
    """The whole batch chain: guard, cast, tag, score. Input columns pass through."""
    df = require_headline(df, text_col, compat_nan)
    return score(tag(df, text_col, settings), text_col, scorer, materiality, settings)


def normalize_single(df: DataFrame, text_col: str = "Headline") -> DataFrame:
    """Single-headline input rules: strip Unicode space, reject blank input."""
    from tidings.functions.text import strip

    stripped = df.withColumn(text_col, strip(F.col(text_col)))
    return stripped.filter(F.col(text_col).isNotNull() & (F.length(F.col(text_col)) > 0))
