"""tidings: headline signals on Spark.

Public API (all functions take and return DataFrames or Columns)::

    from tidings import analyze, tag, score, reports, attribute
    scored = analyze(spark.read.parquet(path))          # tags + scores, one pass
    reports.company_sentiment_top(scored)               # top-6 company x sentiment
"""

from tidings.config import DEFAULT, Settings
from tidings.operators import reports
from tidings.operators.attribution import attribute, attribute_sampled, attribution_table, audit_scores
from tidings.operators.explain import attribute_models, attribute_with_scorer
from tidings.operators.materiality import BowCosine, EncoderCosine, VectorCosine
from tidings.operators.score import analyze, normalize_single, score
from tidings.operators.scorers import LexiconScorer, ModelScorer, label_list_to_columns
from tidings.operators.scoretable import score_resumable
from tidings.operators.single import analyze_single, explain_single
from tidings.operators.tag import company_dimension, filter_funnel, funnel_rows, keyword_counts, tag, tag_from_table
from tidings.shipping import ship_package, ship_weights, weights_loader
from tidings.sources.csv_io import read_headlines_csv, read_headlines_folder, write_results_csv, write_results_parquet
from tidings.sources.news import news_items

__all__ = [
    "DEFAULT", "Settings", "reports", "attribute", "attribute_sampled", "attribute_models", "attribute_with_scorer",
    "attribution_table", "audit_scores", "BowCosine", "EncoderCosine", "VectorCosine", "analyze",
    "normalize_single", "score", "LexiconScorer", "ModelScorer", "label_list_to_columns", "analyze_single",
    "explain_single", "score_resumable", "company_dimension", "filter_funnel", "funnel_rows", "keyword_counts", "tag",
    "tag_from_table", "read_headlines_csv", "read_headlines_folder", "write_results_csv", "write_results_parquet", "news_items",
    "ship_package", "ship_weights", "weights_loader",
]
