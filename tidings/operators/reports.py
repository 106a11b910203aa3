"""Batch summaries over a scored frame.

Every aggregation is a ``groupBy``/``agg`` with map-side partial
aggregation, so a company holding a third of all rows costs one partial row
per task, not a hot reducer. Top-k uses ``orderBy().limit()``, planned as
``TakeOrderedAndProject`` (per-task top-k, then a merge of k rows each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.config import (
    DEFAULT,
    HISTOGRAM_BINS,
    PREVIEW_COLUMNS,
    RAW_PREVIEW_ROWS,
    RESULT_PREVIEW_ROWS,
    STACK_ORDER,
    TOP_COMPANIES,
    TOP_PIVOT_COMPANIES,
)
from tidings.functions.scores import no_nan


def summary_metrics(scored: DataFrame) -> DataFrame:
    """Total, ESG count and share, non-ESG count, mean scores: one row, one job."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_headlines"),
        F.count_if(F.col("esg_flag")).alias("esg_count"),
        (F.avg(F.col("esg_flag").cast("double")) * 100).alias("esg_share_pct"),
        F.count_if(~F.col("esg_flag")).alias("non_esg_count"),
        F.avg(no_nan("cumulative_score")).alias("avg_cumulative_score"),
        F.avg(no_nan("materiality_score")).alias("avg_materiality_score"),
    )


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    return (scored.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("sentiment")))


def top_companies(scored: DataFrame, k: int = TOP_COMPANIES) -> DataFrame:
    """Most frequent detected companies; null companies excluded; name breaks ties."""
    return (_detected(scored.select("company"))
            .groupBy("company").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("company")).limit(k))


def _detected(rows: DataFrame) -> DataFrame:
    """Rows with a company. The fence keeps the filter above the projection
    that tags, which would otherwise be evaluated twice (once in the filter)."""
    from tidings.plans.chain import fence

    return fence(rows, "tagged").filter(F.col("company").isNotNull())


def company_sentiment(scored: DataFrame) -> DataFrame:
    """company x sentiment counts with all three class columns and a Total.

    One grouped aggregate with a conditional count per class: the three
    columns exist even when a class never occurs, and the plan has a single
    shuffle (a ``pivot`` would add a second aggregation round).
    """
    counts = [F.count_if(F.col("sentiment") == F.lit(c)).alias(c) for c in STACK_ORDER]
    return (_detected(scored.select("company", "sentiment"))
            .groupBy("company").agg(*counts, F.count(F.lit(1)).alias("Total")))


def top_by_total(pivot: DataFrame, k: int = TOP_PIVOT_COMPANIES) -> DataFrame:
    return pivot.orderBy(F.desc("Total"), F.asc("company")).limit(k)


def company_sentiment_top(scored: DataFrame, k: int = TOP_PIVOT_COMPANIES) -> DataFrame:
    return top_by_total(company_sentiment(scored), k)


def stacked_offsets(pivot_top: DataFrame) -> DataFrame:
    """Long form of the top companies with the running base of each stacked bar.

    The window partitions by company over three rows each.
    """
    long = pivot_top.select("company", F.explode(F.array(*[
        F.struct(F.lit(i).alias("class_rank"), F.lit(c).alias("sentiment"), F.col(c).alias("n"))
        for i, c in enumerate(STACK_ORDER)])).alias("x")).select("company", "x.*")
    w = (Window.partitionBy("company").orderBy("class_rank")
         .rowsBetween(Window.unboundedPreceding, -1))
    return long.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def _bin_expr(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of v over [lo, hi]; the top edge falls in the last bin;
    a constant group (lo = hi) lands in the middle bin, as a +/-0.5 range would."""
    width = (hi - lo) / F.lit(bins)
    return (F.when(v.isNull(), F.lit(None).cast("int"))
            .when(lo == hi, F.lit(bins // 2))
            .when(v >= hi, F.lit(bins - 1))
            .otherwise(F.least(F.floor((v - lo) / width).cast("int"), F.lit(bins - 1))))


def materiality_histogram(scored: DataFrame, group_col: str = "esg_flag", value_col: str = "materiality_score",
                          bins: int = HISTOGRAM_BINS, broadcast_limit: int = DEFAULT.max_broadcast_bytes,
                          count_col: str | None = None) -> DataFrame:
    """Per-group equal-width histogram over each group's own min..max.

    The (group, value) pairs are checkpointed once; bounds come from one
    grouped aggregate (one row per group value), joined back by broadcast
    when the group column is boolean; the counts are a second partial
    aggregate; a spine exploded from the bounds keeps empty bins. ``count_col``:
    how many rows each row stands for (default 1).
    """
    from tidings.plans.chain import cut_lineage

    v = no_nan(value_col)
    # Two passes read (group, value): compute it once and keep only these two
    # columns, so the scoring chain above is not run twice. No filter here: a
    # filter on v would inline the whole value expression a second time.
    # Nulls drop out by themselves (min/max skip them, a null value gets a
    # null bin, and the spine join keeps bins 0..bins-1 only).
    data = cut_lineage(scored.select(F.col(group_col).alias("grp"), v.alias("v"), *([F.col(count_col).alias("times")] if count_col else [])))
    bounds = (data.groupBy("grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
              .filter(F.col("lo").isNotNull()))
    # One bounds row per group value. A boolean group gives at most three
    # rows. Any other group column: the bounds are checkpointed and their
    # bytes measured, and broadcast when within the limit, so a hot group never
    # lands in one shuffle partition; above it the planner and AQE decide.
    if dict(scored.dtypes).get(group_col) == "boolean":
        right = F.broadcast(bounds)
    else:
        bounds = cut_lineage(bounds)
        size = F.coalesce(F.octet_length(F.col("grp").cast("string")), F.lit(0)) + F.lit(64)
        measured = bounds.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        right = F.broadcast(bounds) if measured <= broadcast_limit else bounds
    # Null is a group like any other: both joins are null-safe.
    edges = right.select(F.col("grp").alias("edge"), "lo", "hi")
    binned = data.join(edges, F.col("grp").eqNullSafe(F.col("edge"))).select(
        "grp", _bin_expr(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), *(["times"] if count_col else []))
    counts = binned.groupBy("grp", "bin").agg((F.sum("times") if count_col else F.count(F.lit(1))).alias("n"))
    spine = bounds.select("grp", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo, hi = F.col("lo"), F.col("hi")
    width = F.when(lo == hi, F.lit(1.0 / bins)).otherwise((hi - lo) / F.lit(bins))
    start = F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo)
    found = counts.select(F.col("grp").alias("g_"), F.col("bin").alias("b_"), "n")
    return (spine.join(found, F.col("grp").eqNullSafe(F.col("g_")) & (F.col("bin") == F.col("b_")), "left")
            .select(F.col("grp").alias(group_col), "bin",
                    (start + F.col("bin") * width).alias("bin_lo"),
                    (start + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def preview_rows(df: DataFrame, order_col: str = "doc_id", n: int = RESULT_PREVIEW_ROWS) -> DataFrame:
    """The input rows a preview will show, taken before any per-row work.

    The scoring chain is row-independent, so scoring the first ``n`` rows by
    id equals taking the first ``n`` rows of the scored table; a preview of
    a 100 TB table then scores 100 rows (per-task top-n, merged), not all.
    """
    from tidings.plans.chain import fence

    # The fence keeps the chain's projections above the top-n, so the top-n is
    # planned as a per-task top-n plus a merge, not a full sort of every row.
    return fence(df.orderBy(order_col).limit(n), "preview")


def result_preview(scored: DataFrame, order_col: str = "doc_id", n: int | None = RESULT_PREVIEW_ROWS) -> DataFrame:
    """The preview table: the listed columns that exist, first ``n`` rows by id.

    Pass ``n=None`` when ``scored`` was built on ``preview_rows`` (already the
    first rows, in order): a second sort + limit above the chain would be
    merged with the first into one full sort of every row.
    """
    cols = [c for c in PREVIEW_COLUMNS if c in scored.columns]
    rows = scored if n is None else scored.orderBy(order_col).limit(n)
    return rows.select(order_col, *cols)


def raw_preview(df: DataFrame, order_col: str = "doc_id", n: int = RAW_PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(order_col).limit(n)
