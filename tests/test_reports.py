"""Summaries: pivot shape, histogram edges, top-k ties, empty input."""

from pyspark.sql import functions as F

from tidings.operators import reports as R
from tidings.operators.score import analyze
from tidings.sources.news import news_items


def _scored(spark):
    return analyze(news_items(spark, "/root/testdata/sf0.001"))


def test_pivot_has_three_classes_and_totals(spark):
    scored = _scored(spark)
    piv = R.company_sentiment(scored)
    assert piv.columns == ["company", "Negative", "Neutral", "Positive", "Total"]
    rows = piv.collect()
    assert sum(r.Total for r in rows) == scored.filter(F.col("company").isNotNull()).count()
    assert all(r.Total == r.Negative + r.Neutral + r.Positive for r in rows)


def test_pivot_missing_class_is_zero(spark, headlines):
    df = analyze(headlines([(1, "Tata Power plan"), (2, "NHPC update")]))
    rows = R.company_sentiment(df).collect()
    assert all(r.Positive == 0 and r.Negative == 0 and r.Neutral == 1 for r in rows)


def test_top_companies_order_and_ties(spark):
    rows = R.top_companies(_scored(spark)).collect()
    assert len(rows) == 8
    keys = [(-r.n, r.company) for r in rows]
    assert keys == sorted(keys)


def test_top6_matches_full_pivot(spark):
    scored = _scored(spark)
    full = sorted(R.company_sentiment(scored).collect(), key=lambda r: (-r.Total, r.company))[:6]
    assert R.company_sentiment_top(scored).collect() == full


def test_offsets_running_base(spark):
    rows = R.stacked_offsets(R.company_sentiment_top(_scored(spark))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.company, []).append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r.class_rank)
        base = 0
        for r in parts:
            assert r.offset == base
            base += r.n


def test_histogram_totals_and_constant_group(spark):
    scored = _scored(spark)
    h = R.materiality_histogram(scored).collect()
    assert sum(r.n for r in h) == scored.count()
    assert {r.bin for r in h} == set(range(20))
    const = spark.createDataFrame([(True, 0.3), (True, 0.3), (False, 0.1), (False, 0.2)],
                                  "esg_flag boolean, materiality_score double")
    rows = R.materiality_histogram(const).collect()
    t = {r.bin: r.n for r in rows if r.esg_flag}
    assert t[10] == 2 and sum(t.values()) == 2
    f = {r.bin: r.n for r in rows if not r.esg_flag}
    assert f[0] == 1 and f[19] == 1


def test_summary_on_empty_input(spark):
    empty = analyze(spark.createDataFrame([], "doc_id long, Headline string"))
    s = R.summary_metrics(empty).collect()
    assert len(s) == 1 and s[0].total_headlines == 0
    assert R.top_companies(empty).count() == 0
    assert R.company_sentiment_top(empty).count() == 0


def test_histogram_counts_a_null_group(spark):
    df = spark.createDataFrame([(None, 0.0), (None, 1.0), ("a", 0.5)], "g string, v double")
    rows = R.materiality_histogram(df, group_col="g", value_col="v").collect()
    assert {r.bin: r.n for r in rows if r.g is None and r.n} == {0: 1, 19: 1}
    assert sum(r.n for r in rows) == 3 and len(rows) == 40
    flags = spark.createDataFrame([(None, 0.1), (True, 0.2)], "esg_flag boolean, materiality_score double")
    assert sum(r.n for r in R.materiality_histogram(flags).collect()) == 2
