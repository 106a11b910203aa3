"""Physical-plan checks: pruning, no repeated text work, top-k, broadcast, no shuffle."""

import re

from pyspark.sql import functions as F

from tidings.operators import reports as R
from tidings.operators.attribution import attribute
from tidings.operators.score import analyze
from tidings.operators.tag import funnel_rows, tag
from tidings.sources.news import news_items

SF = "/root/testdata/sf0.001"


def _plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def _shuffles(plan):
    # operator nodes only: the plan also prints literals such as "Ion Exchange India"
    return re.findall(r"\bExchange \(\d+\)", plan)


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(tag(news_items(spark, SF)).select("doc_id", "company"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_pushed_tag_filter_lowercases_once(spark):
    plan = _plan(funnel_rows(tag(news_items(spark, SF))), "extended")
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # One bound lower() per tag field the pushed filter reads (company,
    # noise) plus the projection's own: 3, where inlining gave about 30.
    assert optimized.count("lower(") <= 3


def test_top_k_is_take_ordered(spark):
    plan = _plan(R.top_companies(analyze(news_items(spark, SF))))
    assert "TakeOrderedAndProject" in plan


def test_histogram_broadcasts_bounded_side(spark):
    plan = _plan(R.materiality_histogram(analyze(news_items(spark, SF))))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_attribution_has_no_shuffle(spark):
    plan = _plan(attribute(news_items(spark, SF)))
    assert not _shuffles(plan)
    assert "ArrowEvalPython" in plan


def test_scoring_chain_has_no_python(spark):
    from tidings.operators.materiality import BowCosine
    from tidings.operators.score import score
    from tidings.operators.tag import tag as tag_

    plan = _plan(score(tag_(news_items(spark, SF)), materiality=BowCosine(vectorized=False)))
    assert "EvalPython" not in plan and not _shuffles(plan)


def test_default_chain_has_one_arrow_udf_and_no_shuffle(spark):
    plan = _plan(analyze(news_items(spark, SF)))
    assert len(re.findall(r"\bArrowEvalPython \(\d+\)", plan)) == 1
    assert "BatchEvalPython" not in plan and not _shuffles(plan)


def test_aggregates_are_partial(spark):
    plan = _plan(R.company_sentiment(analyze(news_items(spark, SF))))
    assert plan.count("HashAggregate") >= 2


def test_histogram_broadcasts_counted_bounds_for_other_groups(spark):
    from tidings.sources.tables import read_table

    vecs = read_table(spark, SF, "embeddings", ["vec_id", "label", "embedding"])
    scored = vecs.select("label", (F.col("vec_id") % 7).cast("double").alias("materiality_score"))
    assert "BroadcastHashJoin" in _plan(R.materiality_histogram(scored, group_col="label"))
    a = sorted(R.materiality_histogram(scored, group_col="label").collect())
    b = sorted(R.materiality_histogram(scored, group_col="label", broadcast_limit=0).collect())
    assert a == b and sum(r.n for r in a) == scored.count()


def _optimized(df):
    return _plan(df, "extended").split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_live_chain_has_no_forced_shuffle_and_tags_once(spark):
    from tidings.sources.news import news_from_documents
    from tidings.streaming.live import document_stream, score_stream

    optimized = _optimized(R.company_sentiment(score_stream(news_from_documents(document_stream(spark, SF)))))
    assert "Repartition" not in optimized
    assert optimized.index("Filter") < optimized.index("CollectMetrics")


def test_lexicon_is_scanned_twice_at_most(spark):
    from tidings.functions import scores as S

    scored = analyze(news_items(spark, SF))
    label = scored.select("doc_id", S.argmax_label("positive", "negative", "neutral").alias("label"))
    assert _optimized(label).count("regexp_extract_all") <= 2


def test_company_is_tagged_once_before_grouping(spark):
    for report in (R.top_companies, R.company_sentiment):
        plan = _optimized(report(analyze(news_items(spark, SF))))
        assert plan.count("THEN Tata Power") == 1


def test_dictionary_scan_moves_no_text(spark):
    from tidings.operators.tag import company_dimension, tag_from_table

    plan = _plan(tag_from_table(news_items(spark, SF), company_dimension(spark)))
    assert not _shuffles(plan) and "Join" not in plan and plan.count("ArrowEvalPython") > 0


def test_dictionary_join_uses_no_python(spark):
    from tidings.operators.tag import company_dimension, ranked_names, tag_by_join

    assert "EvalPython" not in _plan(tag_by_join(news_items(spark, SF), ranked_names(company_dimension(spark))))
