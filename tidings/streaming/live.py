"""Live scoring with Structured Streaming.

The per-row chain is stateless (projections only), so the same
``analyze`` lineage runs on a streaming frame in append mode. Dashboard
counts are a streaming aggregation in complete mode; its state lives in the
checkpoint. The caller names the checkpoint and the output, so a query that
is stopped and started again on them goes on where it stopped: only new files
are scored, and counts continue. Without names a fresh folder under the
shared work folder is used (one-off runs). The trigger is the caller's too:
drained (``availableNow``, the default) or running (``processingTime``).

There is no event time in the data model (the optional ``Date`` column is
never parsed), so there is no watermark and no time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidings.config import TOP_PIVOT_COMPANIES
from tidings.operators.reports import company_sentiment, top_by_total
from tidings.operators.score import analyze
from tidings.session import fresh_path
from tidings.sources.news import news_from_documents
from tidings.sources.tables import table_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source")
DRAINED = {"availableNow": True}


def document_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the documents table, stored as one file or as a folder
    of part files; new files are picked up as they land. ``max_files_per_trigger``
    bounds a micro-batch only if the caller asks for it."""
    path = table_path(sf_dir, "documents")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # The bracket makes it a pattern (of this one name), which a file source takes
    # for a single file as well as for a folder.
    folder, _, name = path.rpartition("/")
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}").select(*DOCUMENT_COLUMNS)


def score_stream(stream: DataFrame, text_col: str = "Headline", **kwargs) -> DataFrame:
    """The batch chain applied to a stream (T1)."""
    return analyze(stream, text_col, **kwargs)


def count_stream(scored_stream: DataFrame) -> DataFrame:
    """Running (sentiment, esg_flag) counts for the live dashboard (T2)."""
    return scored_stream.groupBy("sentiment", "esg_flag").agg(F.count(F.lit(1)).alias("n"))


def start_to_files(query_df: DataFrame, output: str, checkpoint: str, mode: str = "append", trigger: dict | None = None,
                   finish=None) -> StreamingQuery:
    """Start a stream into ``output`` with its progress in ``checkpoint``.

    ``append`` writes a parquet file sink; ``complete`` overwrites the result
    table from ``foreachBatch`` on every micro-batch (``finish`` may turn the
    small aggregated batch into the report to write). A batch that runs twice
    after a failure writes the same table again.
    """
    writer = query_df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or DRAINED)).outputMode(mode)
    if mode == "append":
        return writer.format("parquet").option("path", output).start()

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        (finish(batch) if finish else batch).write.mode("overwrite").parquet(output)

    return writer.foreachBatch(write_batch).start()


def run_to_files(query_df: DataFrame, name: str, mode: str = "append", output: str | None = None, checkpoint: str | None = None,
                 finish=None) -> str:
    """Run a stream until its input is drained and return the output folder."""
    spark = query_df.sparkSession
    output = output or fresh_path(spark, f"{name}-out")
    query = start_to_files(query_df, output, checkpoint or fresh_path(spark, f"{name}-ckpt"), mode, DRAINED, finish)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return output


def live_scores(spark: SparkSession, sf_dir: str, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    scored = score_stream(news_from_documents(document_stream(spark, sf_dir)))
    return spark.read.schema(scored.schema).parquet(run_to_files(scored, "live-scores", "append", output, checkpoint))


def live_counts(spark: SparkSession, sf_dir: str, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    counts = count_stream(score_stream(news_from_documents(document_stream(spark, sf_dir))))
    return spark.read.schema(counts.schema).parquet(run_to_files(counts, "live-counts", "complete", output, checkpoint))


def live_top_companies(spark: SparkSession, sf_dir: str, k: int = TOP_PIVOT_COMPANIES, output: str | None = None,
                       checkpoint: str | None = None) -> DataFrame:
    """Live company x sentiment top-6 (T2).

    The pivot is a streaming aggregation in complete mode: its state is one
    row per company (bounded by the dictionary), updated by each micro-batch
    from partial aggregates, never by re-reading earlier rows. Each batch
    hands ``foreachBatch`` the whole (small) pivot, which takes the top k."""
    pivot = company_sentiment(score_stream(news_from_documents(document_stream(spark, sf_dir))))
    path = run_to_files(pivot, "live-top6", "complete", output, checkpoint, lambda batch: top_by_total(batch, k))
    return spark.read.schema(pivot.schema).parquet(path)
