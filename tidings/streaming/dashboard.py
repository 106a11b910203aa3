"""Live means and histograms: a mergeable state of exact counts.

A histogram over a group's own minimum and maximum can't be kept as bins: the next
file may move the bounds. The state is therefore one row per (flag, distinct
materiality score) with the number of headlines and the sums behind the means.
Every micro-batch writes its own rows, one partial aggregate with a single
shuffle, into its own folder (``batch=<id>``); a batch that runs again after a
failure writes the same folder again. States of batches merge by adding. Reading merges
them and bins the distinct values, weighted by their counts, so the
report equals the batch report on all rows seen so far, whatever the bounds
do. ``digits`` bounds the state: scores are rounded to so many decimals before they
are counted (2 * 10^digits + 1 values of a cosine), and the report is that of the
rounded scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidings.config import HISTOGRAM_BINS
from tidings.functions.scores import no_nan
from tidings.operators.reports import materiality_histogram
from tidings.session import fresh_path
from tidings.sources.news import news_from_documents
from tidings.streaming.live import DRAINED, document_stream, score_stream

STATE = "esg_flag boolean, materiality_score double, n long, cumulative_sum double, cumulative_n long"


def state_of(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """The mergeable state of scored rows."""
    v, c = no_nan("materiality_score"), no_nan("cumulative_score")
    if digits is not None:
        v = F.round(v, digits)
    return (scored.select("esg_flag", v.alias("materiality_score"), c.alias("c")).groupBy("esg_flag", "materiality_score")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("cumulative_sum"), F.count("c").alias("cumulative_n")))


def merged(states: DataFrame) -> DataFrame:
    return (states.groupBy("esg_flag", "materiality_score")
            .agg(F.sum("n").alias("n"), F.sum("cumulative_sum").alias("cumulative_sum"), F.sum("cumulative_n").alias("cumulative_n")))


def read_state(spark: SparkSession, state: str) -> DataFrame:
    return merged(spark.read.schema(f"{STATE}, batch long").parquet(state))


def merge_state(spark: SparkSession, state: str, target: str) -> None:
    """The batches of ``state`` as one, in the new folder ``target``. A query
    that is started again on its checkpoint goes on there."""
    read_state(spark, state).write.parquet(f"{target.rstrip('/')}/batch=-1")


def start_dashboard(scored_stream: DataFrame, state: str, checkpoint: str, trigger: dict | None = None, digits: int | None = None) -> StreamingQuery:
    """Keep the state of a scored stream in the folder ``state``."""

    def write(batch: DataFrame, number: int) -> None:
        state_of(batch, digits).write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")

    return (scored_stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or DRAINED))
            .foreachBatch(write).start())


def state_summary(states: DataFrame) -> DataFrame:
    """``reports.summary_metrics`` from the state: one row."""
    flagged = F.sum(F.when(F.col("esg_flag"), F.col("n")))
    scored = F.col("materiality_score").isNotNull()
    return states.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_headlines"),
        F.coalesce(flagged, F.lit(0)).alias("esg_count"),
        (F.coalesce(flagged, F.lit(0)) / F.sum(F.when(F.col("esg_flag").isNotNull(), F.col("n"))) * 100).alias("esg_share_pct"),
        F.coalesce(F.sum(F.when(~F.col("esg_flag"), F.col("n"))), F.lit(0)).alias("non_esg_count"),
        (F.sum("cumulative_sum") / F.sum("cumulative_n")).alias("avg_cumulative_score"),
        (F.sum(F.col("materiality_score") * F.col("n")) / F.sum(F.when(scored, F.col("n")))).alias("avg_materiality_score"))


def state_histogram(states: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``reports.materiality_histogram`` from the state."""
    return materiality_histogram(states, bins=bins, count_col="n")


def _drained_state(spark: SparkSession, sf_dir: str, files_per_batch: int | None) -> DataFrame:
    state = fresh_path(spark, "dashboard-state")
    scored = score_stream(news_from_documents(document_stream(spark, sf_dir, files_per_batch)))
    query = start_dashboard(scored, state, fresh_path(spark, "dashboard-ckpt"))
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return read_state(spark, state)


def live_summary(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Live A1-A5: drain the document stream, then read the state."""
    return state_summary(_drained_state(spark, sf_dir, files_per_batch))


def live_histogram(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Live A10 and A11."""
    return state_histogram(_drained_state(spark, sf_dir, files_per_batch))
