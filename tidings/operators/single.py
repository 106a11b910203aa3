"""Single-headline mode: one text in, the full chain and its explanation out.

The same operators as batch mode run on a one-row frame, so a single
headline and the same headline inside a batch get identical numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.config import ABBREVIATE_AT, DEFAULT, Settings
from tidings.functions import scores as S
from tidings.functions.text import abbreviate
from tidings.operators.attribution import attribute_sampled, attribution_table
from tidings.operators.explain import attribute_models
from tidings.operators.materiality import EncoderCosine
from tidings.operators.score import analyze, normalize_single
from tidings.operators.scorers import ModelScorer


def headline_frame(spark: SparkSession, headline: str) -> DataFrame:
    """Strip the text and reject blank input before any job runs."""
    if headline is None or not headline.strip():
        raise ValueError("enter a headline")
    df = spark.createDataFrame([(0, headline)], "doc_id long, Headline string")
    return normalize_single(df)


def analyze_single(spark: SparkSession, headline: str, settings: Settings = DEFAULT, scorer=None, materiality=None) -> DataFrame:
    """Tags, scores and adjusted score of one headline (one row), with any
    scorer and encoder."""
    return analyze(headline_frame(spark, headline), scorer=scorer, materiality=materiality, settings=settings)


REPORT_INPUT = ("Headline", "company", "esg_flag", "sentiment", "cumulative_score", "materiality_score", "esg_adjusted_score")


def report_rows(explained: DataFrame, *ids: str) -> DataFrame:
    """The display fields of explained headlines (``REPORT_INPUT`` kept), and
    the audit score. Sums of attributions are cut to 12 decimals before they
    are shown, so that their order can't decide a digit or a sign."""
    audit = F.round(F.col("env_base") + F.aggregate(F.col("env_phi"), F.lit(0.0), lambda acc, x: acc + x), 12) + F.lit(0.0)
    return explained.select(
        *ids,
        abbreviate("Headline", ABBREVIATE_AT).alias("headline_short"),
        S.company_display("company").alias("company"),
        S.esg_display("esg_flag").alias("esg_label"),
        "sentiment",
        S.signed("cumulative_score", 4).alias("cumulative_text"),
        S.unsigned("materiality_score", 4).alias("materiality_text"),
        S.signed("esg_adjusted_score", 4).alias("adjusted_text"),
        S.signed(audit, 4).alias("audit_text"),
        audit.alias("audit_score"),
        "attribution_error",
    )


def explain_single(spark: SparkSession, headline: str, settings: Settings = DEFAULT, scorer=None, materiality=None,
                   permutations: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, sentiment attribution, environmental attribution) of one headline.

    The report has one row with the display fields; the attribution tables
    are long (player, token, phi, weight), with every word a player. A model
    scorer and an encoder (given together) are explained as black boxes.
    """
    scored = analyze_single(spark, headline, settings, scorer, materiality)
    if isinstance(scorer, ModelScorer) and isinstance(materiality, EncoderCosine):
        a = attribute_models(scored, scorer, materiality, permutations=permutations, keep=REPORT_INPUT)
    elif scorer is None and materiality is None:
        a = attribute_sampled(scored, permutations=permutations, settings=settings, keep=REPORT_INPUT)
    else:
        raise ValueError("give both a model scorer and an encoder, or neither")
    return report_rows(a), attribution_table(a, "sentiment"), attribution_table(a, "env_impact")
