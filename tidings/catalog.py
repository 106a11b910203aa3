"""Registered queries (Spark) and their DuckDB oracles.

Every query reads the driver's tables (``documents`` through the news
projection, or ``embeddings``) in full. Floating-point outputs are rounded
to 6 decimals in both engines so that summation order does not decide a
comparison; each oracle is written independently in SQL (joins,
``unnest`` and ``GROUP BY`` where the Spark side works inside the row).
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings import config as C
from tidings.functions import scores as S
from tidings.operators import reports as R
from tidings.operators.attribution import attribute, attribute_sampled, attribution_table, audit_scores
from tidings.operators.explain import attribute_models, attribute_with_scorer
from tidings.operators.games import FLIP_BIT, ORDER_INCREMENTS, ORDER_MODULUS, ORDER_MULTIPLIER, ORDER_SEED_STRIDE, ORDER_WARM_UP
from tidings.operators.materiality import (BowCosine, EncoderCosine, VectorCosine, anchor_counts,
                                           anchor_vocabulary_encoder_loader, join_vectors)
from tidings.operators.pipeline_scorer import PipelineScorer
from tidings.operators.scorers import (ModelScorer, label_list_to_columns, lexicon_from_weights, lexicon_model_loader,
                                       save_lexicon_weights)
from tidings.operators.score import analyze, normalize_single, score
from tidings.operators.scoretable import score_resumable
from tidings.operators.single import report_rows
from tidings.operators.tag import (
    company_dimension,
    filter_funnel,
    funnel_rows,
    keyword_counts,
    tag,
    ranked_names,
    tag_by_join,
    tag_from_table,
    with_category,
)
from tidings.plans.chain import spread
from tidings.session import fresh_path
from tidings.shipping import ship_weights, weights_loader
from tidings.sources.csv_io import read_headlines_csv, read_headlines_folder, write_results_csv, write_results_parquet
from tidings.sources.news import LEAD_COMPANIES, news_items
from tidings.sources.tables import read_table

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[S.half_up(F.col(c), digits).alias(c) if t == "double" else F.round(F.col(c), digits).alias(c) if t == "float" else F.col(c)
                       for c, t in df.dtypes])


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(news_items(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(_news(spark, sf_dir))


SCORED_COLUMNS = ("doc_id", "Headline", "lang", "source") + (
    "company", "esg_flag", "noise_flag", "positive", "negative", "neutral",
    "cumulative_score", "sentiment", "materiality_score", "esg_adjusted_score")


# ---------------------------------------------------------------------------
# Spark queries
# ---------------------------------------------------------------------------

def q_scored_headlines(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select(*SCORED_COLUMNS))


def q_company_tag(spark, sf_dir):
    return tag(_news(spark, sf_dir)).select("doc_id", "company")


def q_company_tag_table(spark, sf_dir):
    return tag_from_table(_news(spark, sf_dir), company_dimension(spark)).select(
        "doc_id", "company", "category")


def q_company_tag_join(spark, sf_dir):
    """The same tags by the join that takes a dictionary of any size."""
    return tag_by_join(_news(spark, sf_dir), ranked_names(company_dimension(spark))).select("doc_id", "company", "category")


def _large_dictionary(spark, sf_dir):
    """The companies, then every distinct word of six letters or more of ``benchmark``,
    in alphabetical order (equal priority: the name decides)."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("company")
    words = read_table(spark, sf_dir, "benchmark", ["text"]).select(word).distinct()
    return company_dimension(spark).unionByName(words.select(F.lit(100).alias("priority"), "company", F.lit("Word").alias("category")))


def q_company_tag_automaton(spark, sf_dir):
    """Hundreds to thousands of names (companies, words of ``benchmark``), one scan."""
    return tag_from_table(_news(spark, sf_dir), _large_dictionary(spark, sf_dir)).select("doc_id", "company", "category")


def q_esg_flag(spark, sf_dir):
    return tag(_news(spark, sf_dir)).select("doc_id", "esg_flag")


def q_noise_flag(spark, sf_dir):
    return tag(_news(spark, sf_dir)).select("doc_id", "noise_flag")


def q_keyword_hits(spark, sf_dir):
    return keyword_counts(_news(spark, sf_dir))


def q_filter_funnel(spark, sf_dir):
    return filter_funnel(tag(_news(spark, sf_dir)))


def q_funnel_rows(spark, sf_dir):
    return funnel_rows(tag(_news(spark, sf_dir))).select("doc_id", "company")


def q_company_category(spark, sf_dir):
    tagged = with_category(tag(_news(spark, sf_dir)), company_dimension(spark))
    return tagged.groupBy("category").agg(F.count(F.lit(1)).alias("n_headlines"))


def q_sentiment_scores(spark, sf_dir):
    s = score(_news(spark, sf_dir))
    return rounded(s.select("doc_id", "positive", "negative", "neutral", "cumulative_score", "sentiment"))


def q_label_list_to_columns(spark, sf_dir):
    """Model-shaped raw output built from the lexicon scores: all three labels
    (upper case) on even ids, only the top label on odd ids."""
    s = score(_news(spark, sf_dir))
    top = S.argmax_label("positive", "negative", "neutral")
    top_score = F.when(top == "positive", F.col("positive")).when(top == "negative", F.col("negative")).otherwise(
        F.col("neutral"))
    full = F.array(*[F.struct(F.lit(f.upper()).alias("label"), F.col(f).alias("score"))
                     for f in ("positive", "negative", "neutral")])
    top1 = F.array(F.struct(F.upper(top).alias("label"), top_score.alias("score")))
    raw = F.when(F.col("doc_id") % 2 == 0, full).otherwise(top1)
    cols = label_list_to_columns(raw)
    return rounded(s.select("doc_id", cols["positive"].alias("positive"), cols["negative"].alias("negative"),
                            cols["neutral"].alias("neutral")))


def q_materiality_bow(spark, sf_dir):
    news = _news(spark, sf_dir)
    return rounded(news.select("doc_id", BowCosine().expr(F.col("Headline")).alias("materiality_score")))


def _embedding_scores(spark, sf_dir):
    vecs = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    anchor = VectorCosine.from_table(vecs, "vec_id", 0, "embedding")
    return vecs.select("vec_id", "label", anchor.expr(F.col("embedding")).alias("materiality_score"))


def q_materiality_embedding(spark, sf_dir):
    return rounded(_embedding_scores(spark, sf_dir))


def q_embedding_histogram(spark, sf_dir):
    return rounded(R.materiality_histogram(_embedding_scores(spark, sf_dir), group_col="label"))


def q_adjusted_score(spark, sf_dir):
    s = score(_news(spark, sf_dir))
    return rounded(s.select("doc_id", S.direction("positive", "negative").alias("direction"),
                            "materiality_score", "esg_adjusted_score"))


def q_argmax_label(spark, sf_dir):
    s = score(_news(spark, sf_dir))
    return s.select("doc_id", S.argmax_label("positive", "negative", "neutral").alias("best_label"))


def q_clamped_score(spark, sf_dir):
    s = score(_news(spark, sf_dir))
    return rounded(s.select("doc_id", S.clamp("cumulative_score").alias("score_clamped")))


def q_summary_metrics(spark, sf_dir):
    return rounded(R.summary_metrics(_scored(spark, sf_dir)))


def q_sentiment_distribution(spark, sf_dir):
    return R.sentiment_distribution(_scored(spark, sf_dir))


def q_top_companies(spark, sf_dir):
    return R.top_companies(_scored(spark, sf_dir))


def q_company_sentiment(spark, sf_dir):
    return R.company_sentiment(_scored(spark, sf_dir))


def q_company_sentiment_top6(spark, sf_dir):
    return R.company_sentiment_top(_scored(spark, sf_dir))


def q_company_sentiment_offsets(spark, sf_dir):
    return R.stacked_offsets(R.company_sentiment_top(_scored(spark, sf_dir)))


def q_materiality_histogram(spark, sf_dir):
    return rounded(R.materiality_histogram(_scored(spark, sf_dir)))


def _attributed(spark, sf_dir):
    return attribute(_news(spark, sf_dir))


def q_sentiment_attribution(spark, sf_dir):
    return rounded(attribution_table(_attributed(spark, sf_dir), "sentiment"))


def q_env_attribution(spark, sf_dir):
    return rounded(attribution_table(_attributed(spark, sf_dir), "env_impact"))


def q_audit_score(spark, sf_dir):
    return rounded(audit_scores(_attributed(spark, sf_dir)))


SAMPLED_PLAYERS = 16
SAMPLED_ORDERS = 64


def q_sampled_attribution(spark, sf_dir):
    """Environmental attribution with 16 players and 64 sampled orders per row.
    The orders are an integer hash of (seed, id, order), so the SQL twin
    rebuilds them; tests also compare with exact enumeration."""
    return rounded(attribution_table(
        attribute_sampled(_news(spark, sf_dir), players=SAMPLED_PLAYERS, permutations=SAMPLED_ORDERS),
        "env_impact"))


def q_model_attribution(spark, sf_dir):
    """Sentiment attribution through a black-box model (the stub classifier): all
    coalitions of 4 runs of words, each distinct masked text scored once. Equals
    the additive path, so the SQL twin is the relational Shapley oracle with 4 players."""
    model = ModelScorer(lexicon_model_loader(fail_on=None), max_chars=None)
    out = attribute_with_scorer(_news(spark, sf_dir), model, players=4)
    return rounded(attribution_table(out, "sentiment"))


def q_interpretation_report(spark, sf_dir):
    """One summary row per headline. Scores and the environmental audit come
    from one pass over each row (no join back by id)."""
    scored = _scored(spark, sf_dir)
    keep = ("Headline", "company", "esg_flag", "sentiment", "cumulative_score", "materiality_score",
            "esg_adjusted_score")
    return report_rows(attribute(scored, keep=keep), "doc_id").drop("audit_score")


def q_score_formats(spark, sf_dir):
    """The display formats on values that sit on or next to rounding ties, one
    set per document."""
    i = F.pmod(F.col("doc_id"), F.lit(4001)) - 2000
    x = F.when(F.col("doc_id") % 3 == 0, i / 32.0).when(F.col("doc_id") % 3 == 1, (2 * i + 1) / 20000.0).otherwise((2 * i + 1) / 2000.0)
    return read_table(spark, sf_dir, "documents", ["doc_id"]).select(
        "doc_id", S.signed(x, 4).alias("signed4"), S.unsigned(x, 4).alias("unsigned4"), S.signed(x, 3).alias("signed3"))


TOKEN_ORDERS = 4


def q_token_attribution(spark, sf_dir):
    """Environmental attribution with every word a player, 4 sampled orders."""
    return rounded(attribution_table(attribute_sampled(_news(spark, sf_dir), permutations=TOKEN_ORDERS), "env_impact"))


TREE_SAMPLES = 2


def _tree_explained(spark, sf_dir):
    """Every word a player: Owen values over a balanced tree of the words, two
    orders and their reverses."""
    return attribute_sampled(_news(spark, sf_dir), permutations=TREE_SAMPLES, tree=True, paired=True)


def q_tree_attribution_sentiment(spark, sf_dir):
    return rounded(attribution_table(_tree_explained(spark, sf_dir), "sentiment"))


def q_tree_attribution_env(spark, sf_dir):
    return rounded(attribution_table(_tree_explained(spark, sf_dir), "env_impact"))


ERROR_PLAYERS, ERROR_SAMPLES, ERROR_LEAST, ERROR_TOLERANCE = 16, 16, 4, 0.02


def q_error_attribution(spark, sf_dir):
    """Environmental attribution of 16 runs of words with known errors: pairs of
    orders are added (4, 8, 16) until no player's standard error exceeds 0.02."""
    out = attribute_sampled(_news(spark, sf_dir), players=ERROR_PLAYERS, permutations=ERROR_SAMPLES, paired=True,
                            tolerance=ERROR_TOLERANCE, least=ERROR_LEAST)
    return rounded(attribution_table(out, "env_impact", carry=("n_samples",)))


MODEL_TREE_PLAYERS = 16


def q_model_tree_attribution(spark, sf_dir):
    """Sentiment attribution of a black-box classifier (the stub) by one tree order
    of 16 runs of words and its reverse, each distinct masked text scored once."""
    model = ModelScorer(lexicon_model_loader(fail_on=None), max_chars=None)
    out = attribute_models(_news(spark, sf_dir), model, players=MODEL_TREE_PLAYERS, permutations=1, tree=True, paired=True)
    return rounded(attribution_table(out, "sentiment"))


def q_resumable_scores(spark, sf_dir):
    """Distinct headlines scored through the stub classifier into a score table: a
    run that stops after 2 of 4 parts, then one that scores what is left."""
    table, model = fresh_path(spark, "score-table"), ModelScorer(lexicon_model_loader())
    news = _news(spark, sf_dir)
    score_resumable(news, model, table, parts=4, stop_after=2)
    return rounded(score_resumable(news, model, table, parts=4).select("doc_id", "scores.*"))


def _model_explained(spark, sf_dir):
    """Both outputs explained through a classifier and an encoder (the stubs),
    all coalitions of 4 runs of words."""
    return attribute_models(_news(spark, sf_dir), ModelScorer(lexicon_model_loader(fail_on=None), max_chars=None),
                            EncoderCosine(anchor_vocabulary_encoder_loader()), players=4, permutations=None)


def q_model_env_attribution(spark, sf_dir):
    return rounded(attribution_table(_model_explained(spark, sf_dir), "env_impact"))


def q_model_audit_score(spark, sf_dir):
    return rounded(audit_scores(_model_explained(spark, sf_dir)))


def q_headline_vectors(spark, sf_dir):
    """Precomputed vectors joined to the headlines by id (null where a headline
    has none), and the adjusted score from their materiality."""
    vecs = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    anchor = VectorCosine.from_table(vecs, "vec_id", 0, "embedding")
    given = join_vectors(_news(spark, sf_dir), vecs, "doc_id", "vec_id", "embedding").withColumn("given", anchor.expr("embedding"))
    s = score(given.select("doc_id", "Headline", "given"))
    return rounded(s.select("doc_id", F.col("given").alias("materiality_score"),
                            S.adjusted(S.direction("positive", "negative"), "given").alias("esg_adjusted_score")))


def q_result_preview(spark, sf_dir):
    return rounded(R.result_preview(analyze(R.preview_rows(news_items(spark, sf_dir))), n=None))


def q_raw_preview(spark, sf_dir):
    return R.raw_preview(news_items(spark, sf_dir))


def q_row_count(spark, sf_dir):
    return news_items(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))


def q_csv_round_trip(spark, sf_dir):
    """Write the full result as CSV to the work folder and read it back."""
    path = fresh_path(spark, "results-csv")
    write_results_csv(_scored(spark, sf_dir).select(*SCORED_COLUMNS), path)
    back = read_headlines_csv(spark, path, schema=_scored(spark, sf_dir).select(*SCORED_COLUMNS).schema)
    return rounded(back)


def _mixed_csv_folder(spark, sf_dir):
    """The news as a folder of CSV files: even ids with one order of columns, odd
    ones with another and without ``lang``; every 50th id once more, in a line with
    a cell too many."""
    path = fresh_path(spark, "mixed-csv")
    news = news_items(spark, sf_dir)
    write_results_csv(news.filter("doc_id % 2 = 0").select("doc_id", "Headline", "lang", "source"), path)
    write_results_csv(news.filter("doc_id % 2 <> 0").select("source", "Headline", "doc_id"), path, mode="append")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.lit('"x, y"'), F.col("source"), F.lit("too many"))
    # One raw column whose name is the header line.
    raw = news.filter("doc_id % 50 = 7").select(line.alias("doc_id,Headline,source"))
    raw.write.mode("append").options(header="true", sep="\u0001", quote="\u0000").csv(path)
    return path


def q_csv_by_header(spark, sf_dir):
    """A folder whose files order their columns differently, read by name."""
    schema = news_items(spark, sf_dir).schema
    return read_headlines_folder(spark, _mixed_csv_folder(spark, sf_dir), schema)[0]


def q_csv_rejected(spark, sf_dir):
    """The records of that folder with more cells than their header; a line number each."""
    rejected = read_headlines_folder(spark, _mixed_csv_folder(spark, sf_dir), news_items(spark, sf_dir).schema)[1]
    return rejected.select("record", (F.col("line") > 1).alias("located"))


def q_no_company_reports(spark, sf_dir):
    """The reports on headlines of which none names a company: empty tables, not errors."""
    rows = _scored(spark, sf_dir).filter(F.col("company").isNull())
    pivot = R.company_sentiment_top(rows)
    out = R.summary_metrics(rows).select(F.lit("headlines").alias("report"), F.col("total_headlines").alias("n"))
    for name, report in (("top", R.top_companies(rows)), ("pivot", pivot), ("stacked", R.stacked_offsets(pivot)),
                         ("distribution", R.sentiment_distribution(rows))):
        out = out.unionByName(report.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n"))
    return out


def q_parquet_round_trip(spark, sf_dir):
    """Write the full result as parquet to the work folder and read it back."""
    path = fresh_path(spark, "results-parquet")
    write_results_parquet(_scored(spark, sf_dir).select(*SCORED_COLUMNS), path)
    return rounded(spark.read.parquet(path))


def q_materiality_encoder_stub(spark, sf_dir):
    """The encoder adapter (predict_batch_udf, 32-row batches, anchor encoded
    once on the driver) around a stub encoder: counts of the anchor's words."""
    enc = EncoderCosine(anchor_vocabulary_encoder_loader())
    return rounded(_news(spark, sf_dir).select("doc_id", enc.expr(F.col("Headline")).alias("materiality_score")))


def q_single_headline(spark, sf_dir):
    """Single-headline rules (strip, reject blank) applied to every row."""
    single = normalize_single(_news(spark, sf_dir))
    out = analyze(single)
    return rounded(out.select("doc_id", "Headline", "company", "esg_flag", "noise_flag", "cumulative_score",
                              "sentiment", "materiality_score", "esg_adjusted_score"))


def q_model_scorer_stub(spark, sf_dir):
    """The model adapter (predict_batch_udf, 16-row batches, per-row fallback)
    around a stub classifier that fails on texts mentioning fly ash."""
    s = score(_news(spark, sf_dir), scorer=ModelScorer(lexicon_model_loader()))
    return rounded(s.select("doc_id", "positive", "negative", "neutral", "score_error", "sentiment",
                            "esg_adjusted_score"))


def q_shipped_model_scores(spark, sf_dir):
    """Headlines scored by a model that is built on the workers from shipped
    weights (saved, zipped, checked and unpacked there)."""
    with tempfile.TemporaryDirectory() as folder:  # of the driver; Spark serves the copy it makes
        save_lexicon_weights(folder)
        weights = ship_weights(spark, folder)
    s = score(_news(spark, sf_dir), scorer=ModelScorer(weights_loader(weights, lexicon_from_weights)))
    return rounded(s.select("doc_id", "positive", "negative", "neutral", "cumulative_score", "sentiment"))


def q_pipeline_scores(spark, sf_dir):
    """Every headline scored by a pipeline trained on ``labels.quality`` (1:
    positive) of the rows whose crc32(doc_id) mod 5 is not 0, saved and loaded."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).filter(~held)
    news = _news(spark, sf_dir)
    path = fresh_path(spark, "pipeline-model")
    PipelineScorer.train(news.join(labels, "doc_id"), "Headline", "quality", max_chars=None).save(path)
    out = score(news, scorer=PipelineScorer.load(spark, path))
    return rounded(out.select("doc_id", held.alias("held_out"), "positive", "negative", "neutral", "cumulative_score", "sentiment"))


def q_stream_scores(spark, sf_dir):
    from tidings.streaming.live import live_scores

    return rounded(live_scores(spark, sf_dir).select(*SCORED_COLUMNS))


def q_stream_counts(spark, sf_dir):
    from tidings.streaming.live import live_counts

    return live_counts(spark, sf_dir)


def q_stream_top6(spark, sf_dir):
    from tidings.streaming.live import live_top_companies

    return live_top_companies(spark, sf_dir)


def q_stream_summary(spark, sf_dir):
    """Live means (A1-A5) read from the dashboard state after the stream is drained."""
    from tidings.streaming.dashboard import live_summary

    return rounded(live_summary(spark, sf_dir))


def q_stream_histogram(spark, sf_dir):
    """Live materiality histograms (A10, A11) read from the dashboard state."""
    from tidings.streaming.dashboard import live_histogram

    return rounded(live_histogram(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scored_headlines": q_scored_headlines,
    "company_tag": q_company_tag,
    "company_tag_table": q_company_tag_table,
    "company_tag_automaton": q_company_tag_automaton,
    "company_tag_join": q_company_tag_join,
    "esg_flag": q_esg_flag,
    "noise_flag": q_noise_flag,
    "keyword_hits": q_keyword_hits,
    "filter_funnel": q_filter_funnel,
    "funnel_rows": q_funnel_rows,
    "company_category": q_company_category,
    "sentiment_scores": q_sentiment_scores,
    "label_list_to_columns": q_label_list_to_columns,
    "materiality_bow": q_materiality_bow,
    "materiality_embedding": q_materiality_embedding,
    "embedding_histogram": q_embedding_histogram,
    "adjusted_score": q_adjusted_score,
    "argmax_label": q_argmax_label,
    "clamped_score": q_clamped_score,
    "summary_metrics": q_summary_metrics,
    "sentiment_distribution": q_sentiment_distribution,
    "top_companies": q_top_companies,
    "company_sentiment": q_company_sentiment,
    "company_sentiment_top6": q_company_sentiment_top6,
    "company_sentiment_offsets": q_company_sentiment_offsets,
    "materiality_histogram": q_materiality_histogram,
    "sentiment_attribution": q_sentiment_attribution,
    "env_attribution": q_env_attribution,
    "audit_score": q_audit_score,
    "sampled_attribution": q_sampled_attribution,
    "model_attribution": q_model_attribution,
    "interpretation_report": q_interpretation_report,
    "score_formats": q_score_formats,
    "token_attribution": q_token_attribution,
    "tree_attribution_sentiment": q_tree_attribution_sentiment,
    "tree_attribution_env": q_tree_attribution_env,
    "error_attribution": q_error_attribution,
    "model_tree_attribution": q_model_tree_attribution,
    "resumable_scores": q_resumable_scores,
    "model_env_attribution": q_model_env_attribution,
    "model_audit_score": q_model_audit_score,
    "headline_vectors": q_headline_vectors,
    "result_preview": q_result_preview,
    "raw_preview": q_raw_preview,
    "row_count": q_row_count,
    "csv_round_trip": q_csv_round_trip,
    "parquet_round_trip": q_parquet_round_trip,
    "csv_by_header": q_csv_by_header,
    "csv_rejected": q_csv_rejected,
    "no_company_reports": q_no_company_reports,
    "materiality_encoder_stub": q_materiality_encoder_stub,
    "single_headline": q_single_headline,
    "model_scorer_stub": q_model_scorer_stub,
    "pipeline_scores": q_pipeline_scores,
    "shipped_model_scores": q_shipped_model_scores,
    "stream_scores": q_stream_scores,
    "stream_counts": q_stream_counts,
    "stream_top6": q_stream_top6,
    "stream_summary": q_stream_summary,
    "stream_histogram": q_stream_histogram,
}


# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _first_hit_sql(lowered: str, names, values=None) -> str:
    values = list(names) if values is None else list(values)
    arms = " ".join(f"WHEN contains({lowered}, {_q(n.lower())}) THEN {_q(v) if v is not None else 'NULL'}"
                    for n, v in zip(names, values))
    return f"CASE {arms} END"


def news_sql(strip: bool = False) -> str:
    """The news projection in SQL; ``strip`` applies the single-headline rules."""
    head = (f"{_list(LEAD_COMPANIES)}[doc_id % {len(LEAD_COMPANIES)} + 1] || ' ' || "
            f"{_list(C.LEAD_PHRASES)}[(doc_id // {len(LEAD_COMPANIES)}) % {len(C.LEAD_PHRASES)} + 1] "
            "|| chr(10) || text")
    head = (f"CASE doc_id % 97 WHEN 13 THEN NULL WHEN 14 THEN '' WHEN 15 THEN ' ' || chr(9) || chr(10) "
            f"WHEN 16 THEN chr(9) || ' ' || {head} || chr(160) || chr(12288) WHEN 17 THEN chr(383) || 'olar plant ' || text "
            f"WHEN 18 THEN text ELSE {head} END")
    if not strip:
        return f"news AS (SELECT doc_id, {head} AS Headline, lang, source FROM documents)"
    blank = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    stripped = f"regexp_replace({head}, '^{blank}|{blank}$', '', 'g')"
    return (f"news AS (SELECT doc_id, {stripped} AS Headline, lang, source FROM documents "
            f"WHERE length({stripped}) > 0)")


NEWS_SQL = news_sql()

_ANCHOR = anchor_counts()
_ANCHOR_NORM_SQL = f"sqrt({float(sum(v * v for v in _ANCHOR.values()))})"


def _lex_count(tokens: str, words) -> str:
    return f"len(list_filter({tokens}, lambda w: w IN {_in_list(words)}))"


def _anchor_dot(tokens: str) -> str:
    return " + ".join(f"{c} * len(list_filter({tokens}, lambda w: w = {_q(t)}))" for t, c in _ANCHOR.items())


TAGS_SQL = (
    "tagged AS (SELECT *, "
    f"{_first_hit_sql('lower(Headline)', C.COMPANIES)} AS company, "
    f"coalesce(regexp_matches(Headline, {_q('|'.join(C.ESG_KEYWORDS))}, 'i'), false) AS esg_flag, "
    f"coalesce({' OR '.join(f'contains(lower(Headline), {_q(p)})' for p in C.NOISE_PHRASES)}, false) AS noise_flag "
    "FROM news)"
)

BOW_SQL = (
    "bow_counts AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, "
    f"unnest(regexp_extract_all(lower(Headline), {_q(C.LEXICAL_TOKEN)})) AS w FROM news) GROUP BY doc_id, w), "
    "bow AS (SELECT doc_id, sum(c * c) AS ss, "
    f"sum(CASE {' '.join(f'WHEN w = {_q(t)} THEN {c} * c' for t, c in _ANCHOR.items())} ELSE 0 END) AS dot "
    "FROM bow_counts GROUP BY doc_id)"
)

_HEAD_TOKENS = f"regexp_extract_all(lower(substring(Headline, 1, {C.SENTIMENT_CHAR_LIMIT})), {_q(C.LEXICAL_TOKEN)})"

SCORED_SQL = (
    # A missing headline scores (0, 0, 1).
    "lex AS (SELECT t.*, "
    f"{_lex_count(_HEAD_TOKENS, C.POSITIVE_WORDS)} AS p, {_lex_count(_HEAD_TOKENS, C.NEGATIVE_WORDS)} AS q "
    "FROM tagged t), "
    "probs AS (SELECT l.*, coalesce(p::DOUBLE / (p + q + 1), 0.0) AS positive, coalesce(q::DOUBLE / (p + q + 1), 0.0) AS negative, "
    "coalesce(1.0::DOUBLE / (p + q + 1), 1.0) AS neutral, "
    f"CASE WHEN coalesce(b.ss, 0) = 0 THEN 0.0::DOUBLE ELSE b.dot::DOUBLE / (sqrt(b.ss::DOUBLE) * {_ANCHOR_NORM_SQL}) END "
    "AS materiality_score FROM lex l LEFT JOIN bow b USING (doc_id)), "
    "scored AS (SELECT *, positive - negative AS cumulative_score, "
    f"CASE WHEN positive - negative > {C.POSITIVE_THRESHOLD} THEN 'Positive' "
    f"WHEN positive - negative < {C.NEGATIVE_THRESHOLD} THEN 'Negative' ELSE 'Neutral' END AS sentiment, "
    "CASE WHEN positive > negative THEN 1 ELSE -1 END AS direction, "
    "(CASE WHEN positive > negative THEN 1.0 ELSE -1.0 END)::DOUBLE * materiality_score + 0.0 AS esg_adjusted_score "
    "FROM probs)"
)

BASE_CTES = f"WITH {NEWS_SQL}, {TAGS_SQL}, {BOW_SQL}, {SCORED_SQL} "


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, {DIGITS}) AS {alias}"


SCORED_SELECT = (
    "doc_id, Headline, lang, source, company, esg_flag, noise_flag, "
    f"{_r('positive', 'positive')}, {_r('negative', 'negative')}, {_r('neutral', 'neutral')}, "
    f"{_r('cumulative_score', 'cumulative_score')}, sentiment, {_r('materiality_score', 'materiality_score')}, "
    f"{_r('esg_adjusted_score', 'esg_adjusted_score')}"
)

DIM_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({p}, {_q(c)}, {_q(cat)})" for p, c, cat in C.company_category_rows()) + ") AS t(priority, company, category))"

EMB_SQL = (
    "anchor AS (SELECT embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id = 0), "
    "emb AS (SELECT vec_id, label, CASE WHEN sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(a, a)) = 0 "
    "THEN 0.0 ELSE list_dot_product(e, a) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(a, a))) END "
    "AS materiality_score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), anchor)"
)


def _hist_sql(source: str, group: str, value: str, bins: int = C.HISTOGRAM_BINS) -> str:
    return (
        f"hd AS (SELECT {group} AS grp, {value} AS v FROM {source} WHERE {value} IS NOT NULL AND NOT isnan({value})), "
        "hb AS (SELECT grp, min(v) AS lo, max(v) AS hi FROM hd GROUP BY grp), "
        f"hc AS (SELECT grp, CASE WHEN lo = hi THEN {bins // 2} WHEN v >= hi THEN {bins - 1} "
        f"ELSE least(floor((v - lo) / ((hi - lo) / {bins}))::INTEGER, {bins - 1}) END AS bin, count(*) AS n "
        "FROM hd JOIN hb USING (grp) GROUP BY ALL), "
        f"spine AS (SELECT grp, lo, hi, unnest(range({bins})) AS bin FROM hb) "
        f"SELECT s.grp AS {group}, s.bin::INTEGER AS bin, "
        f"round(CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END + s.bin * CASE WHEN lo = hi THEN {1.0 / bins} "
        f"ELSE (hi - lo) / {bins} END, {DIGITS}) AS bin_lo, "
        f"round(CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END + (s.bin + 1) * CASE WHEN lo = hi THEN {1.0 / bins} "
        f"ELSE (hi - lo) / {bins} END, {DIGITS}) AS bin_hi, "
        "coalesce(hc.n, 0)::BIGINT AS n FROM spine s LEFT JOIN hc ON s.grp = hc.grp AND s.bin = hc.bin"
    )


def _chunk_ctes(players: int, norm_words=None) -> str:
    """norm_words: the tokens that count for the norm (default: all). Players in SQL: one row per (doc, word), (doc, chunk, token); per-chunk
    lexicon and anchor counts (cs) and pairwise token co-counts (g) through a
    self-join."""
    head_scores = (
        f"lab AS (SELECT doc_id, {_lex_count(_HEAD_TOKENS, C.POSITIVE_WORDS)} AS p0, "
        f"{_lex_count(_HEAD_TOKENS, C.NEGATIVE_WORDS)} AS q0 FROM news), "
        "labels AS (SELECT doc_id, CASE WHEN p0 >= q0 AND p0 >= 1 THEN 'positive' "
        "WHEN q0 >= 1 THEN 'negative' ELSE 'neutral' END AS label FROM lab)"
    )
    words = _q(C.WORD_TOKEN)
    return (
        f"{head_scores}, "
        f"ws AS (SELECT doc_id, regexp_extract_all(Headline, {words}) AS ws FROM news WHERE Headline IS NOT NULL), "
        f"docs AS MATERIALIZED (SELECT doc_id, least(len(ws), {players}) AS m FROM ws), "
        "w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM ws), "
        f"wc AS (SELECT doc_id, pos, word, ((pos + 1) * least(n, {players}) - 1) // n AS chunk FROM w), "
        "chunks AS (SELECT doc_id, chunk, string_agg(word, ' ' ORDER BY pos) AS token FROM wc GROUP BY doc_id, chunk), "
        f"tk AS (SELECT doc_id, chunk, unnest(regexp_extract_all(lower(word), {_q(C.LEXICAL_TOKEN)})) AS t FROM wc), "
        "tc AS MATERIALIZED (SELECT doc_id, chunk, t, count(*) AS c FROM tk GROUP BY ALL), "
        "cs AS (SELECT c.doc_id, c.chunk, "
        f"coalesce(sum(CASE WHEN t IN {_in_list(C.POSITIVE_WORDS)} THEN c END), 0) AS p, "
        f"coalesce(sum(CASE WHEN t IN {_in_list(C.NEGATIVE_WORDS)} THEN c END), 0) AS q, "
        f"coalesce(sum(CASE {' '.join(f'WHEN t = {_q(a)} THEN {k} * c' for a, k in _ANCHOR.items())} END), 0) AS d "
        "FROM chunks c LEFT JOIN tc USING (doc_id, chunk) GROUP BY ALL), "
        "g AS (SELECT a.doc_id, a.chunk AS i, b.chunk AS j, sum(a.c * b.c * CASE WHEN a.chunk < b.chunk THEN 2 ELSE 1 END) AS g "
        "FROM tc a JOIN tc b ON a.doc_id = b.doc_id AND a.t = b.t AND a.chunk <= b.chunk"
        + (f" AND a.t IN {_in_list(norm_words)}" if norm_words else "") + " GROUP BY ALL)"
    )


def _env_value_sql(p: str, q: str, d: str, ss: str) -> str:
    return (f"(CASE WHEN {p} > {q} THEN 1.0 ELSE -1.0 END)::DOUBLE * (CASE WHEN {ss} = 0 THEN 0.0::DOUBLE "
            f"ELSE ({d})::DOUBLE / (sqrt(({ss})::DOUBLE) * {_ANCHOR_NORM_SQL}) END) + 0.0")


def _attribution_ctes(players: int = 8, norm_words=None) -> str:
    """Relational Shapley oracle: every coalition of every doc as a row."""
    return (
        f"{_chunk_ctes(players, norm_words)}, "
        "masks AS (SELECT doc_id, m, unnest(range(1 << m)) AS s FROM docs), "
        "ms AS (SELECT k.doc_id, k.m, k.s, coalesce(sum(cs.p), 0) AS ps, coalesce(sum(cs.q), 0) AS qs, "
        "coalesce(sum(cs.d), 0) AS ds FROM masks k LEFT JOIN cs ON cs.doc_id = k.doc_id AND (k.s >> cs.chunk) & 1 = 1 "
        "GROUP BY ALL), "
        "mg AS (SELECT k.doc_id, k.s, coalesce(sum(g.g), 0) AS ss FROM masks k LEFT JOIN g ON g.doc_id = k.doc_id "
        "AND (k.s >> g.i) & 1 = 1 AND (k.s >> g.j) & 1 = 1 GROUP BY ALL), "
        "vals AS MATERIALIZED (SELECT ms.doc_id, ms.m, ms.s, "
        "(CASE WHEN ps > qs THEN 1.0 ELSE -1.0 END)::DOUBLE * (CASE WHEN ss = 0 THEN 0.0::DOUBLE "
        f"ELSE ds::DOUBLE / (sqrt(ss::DOUBLE) * {_ANCHOR_NORM_SQL}) END) + 0.0 AS env, "
        "CASE l.label WHEN 'positive' THEN ps::DOUBLE / (ps + qs + 1) WHEN 'negative' THEN qs::DOUBLE / (ps + qs + 1) "
        "ELSE 1.0::DOUBLE / (ps + qs + 1) END AS sent, l.label "
        "FROM ms JOIN mg USING (doc_id, s) JOIN labels l USING (doc_id)), "
        "phi AS MATERIALIZED (SELECT v.doc_id, c.chunk AS player, c.token, v.label, "
        "sum(factorial(bit_count(v.s)::INTEGER)::DOUBLE * factorial((v.m - bit_count(v.s) - 1)::INTEGER)::DOUBLE "
        "/ factorial(v.m::INTEGER)::DOUBLE * (x.env - v.env)) AS env_phi, "
        "sum(factorial(bit_count(v.s)::INTEGER)::DOUBLE * factorial((v.m - bit_count(v.s) - 1)::INTEGER)::DOUBLE "
        "/ factorial(v.m::INTEGER)::DOUBLE * (x.sent - v.sent)) AS sent_phi "
        "FROM vals v JOIN chunks c ON c.doc_id = v.doc_id AND (v.s >> c.chunk) & 1 = 0 "
        "JOIN vals x ON x.doc_id = v.doc_id AND x.s = v.s | (1 << c.chunk) GROUP BY ALL)"
    )


def _phi_table(phi_col: str, output: str, error_col: str | None = None, carry: str = "") -> str:
    """The long table of one output, with a row for each headline without
    attributions. ``carry``: a further column of phi (0 without words)."""
    none = f"NULL::INTEGER AS player, NULL AS token, NULL::DOUBLE AS phi, NULL::DOUBLE AS weight, {'NULL::DOUBLE AS phi_stderr, ' if error_col else ''}"
    missing = "NULL" if output == "label" else output
    return (
        f"SELECT doc_id, {carry + ', ' if carry else ''}{output} AS output, player::INTEGER AS player, token, {_r(phi_col, 'phi')}, "
        f"round(CASE WHEN max(abs({phi_col})) OVER (PARTITION BY doc_id) = 0 THEN 0.0 "
        f"ELSE {phi_col} / max(abs({phi_col})) OVER (PARTITION BY doc_id) END, {DIGITS}) AS weight, "
        f"{_r(error_col, 'phi_stderr') + ', ' if error_col else ''}NULL AS attribution_error FROM phi "
        f"UNION ALL SELECT doc_id, {'NULL, ' if carry else ''}{missing}, {none}'no text' FROM news WHERE Headline IS NULL "
        f"UNION ALL SELECT doc_id, {'0, ' if carry else ''}{_q('neutral') if output == 'label' else output}, {none}'no words' FROM news "
        f"WHERE len(regexp_extract_all(Headline, {_q(C.WORD_TOKEN)})) = 0"
    )


def _walk_ctes(players: int, samples: int, tree: bool = False, paired: bool = False, seed: int = 0,
               tolerance: float | None = None, least: int = 0) -> str:
    """Relational twin of sampled values: one row per (doc, order, direction,
    player), positions by row_number over the player's integer key, coalition sums
    as running window sums; the squared norm grows by 2n - 1 with the n-th
    occurrence of a word. A tree key is the player's index with the bit of every level
    turned by a hash of the node above it."""
    mod = ORDER_MODULUS
    start = (f"((doc_id % {mod} + {mod}) % {mod} * {ORDER_MULTIPLIER} "
             f"+ ({seed * ORDER_SEED_STRIDE} + r) % {mod}) % {mod}")
    coefs, prev = [], "x"
    for k, a in enumerate(ORDER_INCREMENTS):
        # Materialised: merged into one projection, each squaring would double the work.
        coefs.append(f"o{k + 1} AS MATERIALIZED (SELECT *, ({prev} * {prev} + {a}) % {mod} AS c{k} FROM o{k})")
        prev = f"c{k}"
    used = [f"c{k}" for k in range(ORDER_WARM_UP, len(ORDER_INCREMENTS))]

    def horner(at: str) -> str:
        key = used[-1]
        for c in used[-2::-1]:
            key = f"(({key}) * {at} + {c}) % {mod}"
        return key

    depth = "(CASE WHEN d.m <= 1 THEN 0 ELSE length(bin(d.m - 1)) END)"
    turn = f"((({horner(f'((1::BIGINT << lv) + (k.chunk >> ({depth} - lv)))')}) >> {FLIP_BIT}) & 1)"
    key = (f"coalesce(list_sum(list_transform(range({depth}), lambda lv: xor((k.chunk >> ({depth} - 1 - lv)) & 1, {turn}) "
           f"<< ({depth} - 1 - lv))), 0)") if tree else horner("k.chunk")
    sent = "CASE l.label WHEN 'positive' THEN ({p})::DOUBLE WHEN 'negative' THEN ({q})::DOUBLE ELSE 1.0::DOUBLE END / ({p} + {q} + 1)"
    before, after = {"p": "cp - c.p", "q": "cq - c.q"}, {"p": "cp", "q": "cq"}
    env = (f"({_env_value_sql('cp', 'cq', 'cd', 'css')}) - "
           f"({_env_value_sql('cp - c.p', 'cq - c.q', 'cd - c.d', 'css - step')})")
    stop = ""
    if tolerance is not None:
        sizes, n = [], least
        while n < samples:
            sizes.append(n)
            n *= 2
        worst = "greatest(stddev_samp(env), stddev_samp(sent)) / sqrt(count(*))"
        stop = (
            f"trial AS (SELECT doc_id, s, max(e) AS e FROM (SELECT x.doc_id, t.s, x.chunk, {worst} AS e FROM x, (SELECT unnest({sizes}) AS s) t "
            f"WHERE x.r < t.s GROUP BY ALL) GROUP BY ALL), "
            f"upto AS (SELECT d.doc_id, coalesce((SELECT min(s) FROM trial t WHERE t.doc_id = d.doc_id AND t.e <= {tolerance}), {samples}) AS s FROM docs d), ")
    return (
        f"{_chunk_ctes(players)}, "
        f"o0 AS (SELECT doc_id, r, ({start})::BIGINT AS x FROM docs, range({samples}) t(r) WHERE m > 0), "
        + ", ".join(coefs) + ", "
        f"keys AS (SELECT o.doc_id, o.r, d.m, k.chunk, k.p, k.q, k.d, {key} AS key "
        f"FROM o{len(ORDER_INCREMENTS)} o JOIN cs k USING (doc_id) JOIN docs d USING (doc_id)), "
        "places AS (SELECT *, row_number() OVER (PARTITION BY doc_id, r ORDER BY key, chunk) AS forward FROM keys), "
        f"pos AS (SELECT p.*, w.back, CASE w.back WHEN 0 THEN forward ELSE m + 1 - forward END AS pos FROM places p, (SELECT unnest({[0, 1] if paired else [0]}) AS back) w), "
        "nth AS (SELECT p.doc_id, p.r, p.back, p.chunk, 2 * row_number() OVER (PARTITION BY p.doc_id, p.r, p.back, t.t ORDER BY p.pos) - 1 AS gain "
        "FROM pos p JOIN tk t USING (doc_id, chunk)), "
        "gains AS (SELECT doc_id, r, back, chunk, sum(gain) AS step FROM nth GROUP BY ALL), "
        "stp AS (SELECT a.*, coalesce(s.step, 0) AS step FROM pos a LEFT JOIN gains s USING (doc_id, r, back, chunk)), "
        "cum AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(d) OVER w AS cd, sum(step) OVER w AS css "
        "FROM stp WINDOW w AS (PARTITION BY doc_id, r, back ORDER BY pos ROWS UNBOUNDED PRECEDING)), "
        f"x AS (SELECT c.doc_id, c.r, c.chunk, avg({env}) AS env, avg(({sent.format(**after)}) - ({sent.format(**before)})) AS sent "
        "FROM cum c JOIN labels l USING (doc_id) GROUP BY ALL), " + stop +
        "phi AS (SELECT x.doc_id, x.chunk AS player, c.token, l.label, avg(env) AS env_phi, avg(sent) AS sent_phi, "
        "stddev_samp(env) / sqrt(count(*)) AS env_err, stddev_samp(sent) / sqrt(count(*)) AS sent_err, count(*)::INTEGER AS n_samples "
        "FROM x JOIN chunks c ON c.doc_id = x.doc_id AND c.chunk = x.chunk JOIN labels l ON l.doc_id = x.doc_id "
        + ("JOIN upto u ON u.doc_id = x.doc_id AND x.r < u.s " if stop else "") + "GROUP BY ALL)"
    )


AUDIT_SQL = (
    "ends AS (SELECT doc_id, m, max(CASE WHEN s = 0 THEN env END) AS base, max(CASE WHEN s = (1 << m) - 1 THEN env END) AS whole "
    "FROM vals GROUP BY doc_id, m), "
    "audit AS (SELECT e.doc_id, e.m AS n_players, e.base AS base_value, coalesce(ps.phi_sum, 0.0) AS phi_sum, "
    "e.base + coalesce(ps.phi_sum, 0.0) AS audit_score, e.whole AS full_value FROM ends e "
    "LEFT JOIN (SELECT doc_id, sum(env_phi) AS phi_sum FROM phi GROUP BY doc_id) ps ON ps.doc_id = e.doc_id)"
)

ORACLE_SQL: dict[str, str] = {
    "scored_headlines": BASE_CTES + f"SELECT {SCORED_SELECT} FROM scored",
    "company_tag": f"WITH {NEWS_SQL}, {TAGS_SQL} SELECT doc_id, company FROM tagged",
    "company_tag_table": (
        f"WITH {NEWS_SQL}, {DIM_SQL} SELECT n.doc_id, min_by(d.company, d.priority) AS company, "
        "min_by(d.category, d.priority) AS category FROM news n LEFT JOIN dim d "
        "ON contains(lower(n.Headline), lower(d.company)) GROUP BY n.doc_id"
    ),
    "esg_flag": f"WITH {NEWS_SQL}, {TAGS_SQL} SELECT doc_id, esg_flag FROM tagged",
    "noise_flag": f"WITH {NEWS_SQL}, {TAGS_SQL} SELECT doc_id, noise_flag FROM tagged",
    "keyword_hits": (
        f"WITH {NEWS_SQL}, kw AS (SELECT unnest({_list(C.ESG_KEYWORDS)}) AS keyword) "
        "SELECT k.keyword, count(*) AS n_docs FROM news n JOIN kw k ON regexp_matches(n.Headline, k.keyword, 'i') "
        "GROUP BY k.keyword"
    ),
    "filter_funnel": (
        f"WITH {NEWS_SQL}, {TAGS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE NOT noise_flag) AS after_noise, "
        "count(*) FILTER (WHERE NOT noise_flag AND company IS NOT NULL) AS after_company, "
        "count(*) FILTER (WHERE NOT noise_flag AND company IS NOT NULL AND esg_flag) AS after_keyword FROM tagged"
    ),
    "funnel_rows": (
        f"WITH {NEWS_SQL}, {TAGS_SQL} SELECT doc_id, company FROM tagged "
        "WHERE NOT noise_flag AND company IS NOT NULL AND esg_flag"
    ),
    "company_category": (
        f"WITH {NEWS_SQL}, {TAGS_SQL}, {DIM_SQL} SELECT d.category, count(*) AS n_headlines FROM tagged t "
        "LEFT JOIN dim d ON t.company = d.company GROUP BY d.category"
    ),
    "sentiment_scores": BASE_CTES + (
        f"SELECT doc_id, {_r('positive', 'positive')}, {_r('negative', 'negative')}, {_r('neutral', 'neutral')}, "
        f"{_r('cumulative_score', 'cumulative_score')}, sentiment FROM scored"
    ),
    "label_list_to_columns": BASE_CTES + (
        ", top AS (SELECT doc_id, positive, negative, neutral, "
        "CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' "
        "WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS lab FROM scored) "
        "SELECT doc_id, "
        f"{_r('CASE WHEN doc_id % 2 = 0 OR lab = ' + _q('positive') + ' THEN positive ELSE 0.0 END', 'positive')}, "
        f"{_r('CASE WHEN doc_id % 2 = 0 OR lab = ' + _q('negative') + ' THEN negative ELSE 0.0 END', 'negative')}, "
        f"{_r('CASE WHEN doc_id % 2 = 0 OR lab = ' + _q('neutral') + ' THEN neutral ELSE 0.0 END', 'neutral')} "
        "FROM top"
    ),
    "materiality_bow": BASE_CTES + f"SELECT doc_id, {_r('materiality_score', 'materiality_score')} FROM scored",
    "materiality_embedding": f"WITH {EMB_SQL} SELECT vec_id, label, {_r('materiality_score', 'materiality_score')} FROM emb",
    "embedding_histogram": f"WITH {EMB_SQL}, " + _hist_sql("emb", "label", "materiality_score"),
    "adjusted_score": BASE_CTES + (
        f"SELECT doc_id, direction, {_r('materiality_score', 'materiality_score')}, "
        f"{_r('esg_adjusted_score', 'esg_adjusted_score')} FROM scored"
    ),
    "argmax_label": BASE_CTES + (
        "SELECT doc_id, CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' "
        "WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS best_label FROM scored"
    ),
    "clamped_score": BASE_CTES + f"SELECT doc_id, {_r('greatest(-1.0, least(1.0, cumulative_score))', 'score_clamped')} FROM scored",
    "summary_metrics": BASE_CTES + (
        "SELECT count(*) AS total_headlines, count(*) FILTER (WHERE esg_flag) AS esg_count, "
        f"{_r('avg(esg_flag::INTEGER::DOUBLE) * 100', 'esg_share_pct')}, "
        "count(*) FILTER (WHERE NOT esg_flag) AS non_esg_count, "
        f"{_r('avg(cumulative_score)', 'avg_cumulative_score')}, {_r('avg(materiality_score)', 'avg_materiality_score')} "
        "FROM scored"
    ),
    "sentiment_distribution": BASE_CTES + "SELECT sentiment, count(*) AS n FROM scored GROUP BY sentiment",
    "top_companies": BASE_CTES + (
        "SELECT company, count(*) AS n FROM scored WHERE company IS NOT NULL GROUP BY company "
        f"ORDER BY n DESC, company LIMIT {C.TOP_COMPANIES}"
    ),
    "company_sentiment": BASE_CTES + (
        "SELECT company, count(*) FILTER (WHERE sentiment = 'Negative') AS Negative, "
        "count(*) FILTER (WHERE sentiment = 'Neutral') AS Neutral, "
        "count(*) FILTER (WHERE sentiment = 'Positive') AS Positive, count(*) AS Total "
        "FROM scored WHERE company IS NOT NULL GROUP BY company"
    ),
    "company_sentiment_top6": BASE_CTES + (
        "SELECT company, count(*) FILTER (WHERE sentiment = 'Negative') AS Negative, "
        "count(*) FILTER (WHERE sentiment = 'Neutral') AS Neutral, "
        "count(*) FILTER (WHERE sentiment = 'Positive') AS Positive, count(*) AS Total "
        f"FROM scored WHERE company IS NOT NULL GROUP BY company ORDER BY Total DESC, company LIMIT {C.TOP_PIVOT_COMPANIES}"
    ),
    "company_sentiment_offsets": BASE_CTES + (
        ", top AS (SELECT company, count(*) AS Total FROM scored WHERE company IS NOT NULL GROUP BY company "
        f"ORDER BY Total DESC, company LIMIT {C.TOP_PIVOT_COMPANIES}), "
        "cls AS (SELECT * FROM (VALUES (0, 'Negative'), (1, 'Neutral'), (2, 'Positive')) AS t(class_rank, sentiment)), "
        "cnt AS (SELECT t.company, c.class_rank, c.sentiment, "
        "(SELECT count(*) FROM scored s WHERE s.company = t.company AND s.sentiment = c.sentiment) AS n "
        "FROM top t, cls c) "
        "SELECT company, class_rank::INTEGER AS class_rank, sentiment, n, "
        "coalesce(sum(n) OVER (PARTITION BY company ORDER BY class_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset "
        "FROM cnt"
    ),
    "materiality_histogram": BASE_CTES + ", " + _hist_sql("scored", "esg_flag", "materiality_score"),
    "sentiment_attribution": f"WITH {NEWS_SQL}, {_attribution_ctes()} " + _phi_table("sent_phi", "label"),
    "env_attribution": f"WITH {NEWS_SQL}, {_attribution_ctes()} " + _phi_table("env_phi", "'env_impact'"),
    "audit_score": (
        f"WITH {NEWS_SQL}, {_attribution_ctes()}, {AUDIT_SQL} SELECT doc_id, n_players::INTEGER AS n_players, "
        f"{_r('base_value', 'base_value')}, {_r('phi_sum', 'phi_sum')}, {_r('audit_score', 'audit_score')}, "
        f"{_r('full_value', 'full_value')}, NULL AS attribution_error FROM audit "
        "UNION ALL SELECT doc_id, 0, NULL, NULL, NULL, NULL, 'no text' FROM news WHERE Headline IS NULL"
    ),
    "interpretation_report": BASE_CTES + f", {_attribution_ctes()}, {AUDIT_SQL} " + (
        "SELECT s.doc_id, CASE WHEN length(Headline) > 100 THEN substring(Headline, 1, 100) || '...' ELSE Headline END "
        f"AS headline_short, coalesce(company, {_q(C.NOT_DETECTED)}) AS company, "
        f"CASE WHEN esg_flag THEN {_q(C.ESG_LABEL)} ELSE {_q(C.NON_ESG_LABEL)} END AS esg_label, sentiment, "
        "printf('%+.4f', cumulative_score) AS cumulative_text, "
        "printf('%.4f', materiality_score) AS materiality_text, "
        "printf('%+.4f', esg_adjusted_score) AS adjusted_text, "
        "CASE WHEN a.audit_score IS NOT NULL THEN printf('%+.4f', round(a.audit_score, 12) + 0.0) END AS audit_text, "
        "CASE WHEN Headline IS NULL THEN 'no text' END AS attribution_error "
        "FROM scored s LEFT JOIN audit a ON a.doc_id = s.doc_id"
    ),
    "result_preview": BASE_CTES + (
        "SELECT doc_id, Headline, company, esg_flag, sentiment, "
        f"{_r('cumulative_score', 'cumulative_score')}, {_r('materiality_score', 'materiality_score')}, "
        f"{_r('esg_adjusted_score', 'esg_adjusted_score')}, {_r('positive', 'positive')}, "
        f"{_r('negative', 'negative')}, {_r('neutral', 'neutral')} FROM scored ORDER BY doc_id LIMIT {C.RESULT_PREVIEW_ROWS}"
    ),
    "raw_preview": f"WITH {NEWS_SQL} SELECT * FROM news ORDER BY doc_id LIMIT {C.RAW_PREVIEW_ROWS}",
    "row_count": f"WITH {NEWS_SQL} SELECT count(*) AS n_rows FROM news",
    "csv_round_trip": BASE_CTES + f"SELECT {SCORED_SELECT} FROM scored",
    "model_scorer_stub": BASE_CTES + (
        ", fail AS (SELECT *, contains(lower(substring(Headline, 1, 512)), 'fly ash') AS bad FROM scored) "
        "SELECT doc_id, "
        f"{_r('CASE WHEN bad THEN 0.0 ELSE positive END', 'positive')}, "
        f"{_r('CASE WHEN bad THEN 0.0 ELSE negative END', 'negative')}, "
        f"{_r('CASE WHEN bad THEN 1.0 ELSE neutral END', 'neutral')}, "
        "CASE WHEN bad THEN 'ValueError: cannot score text containing ''fly ash''' END AS score_error, "
        "CASE WHEN bad THEN 'Neutral' ELSE sentiment END AS sentiment, "
        f"{_r('CASE WHEN bad THEN -materiality_score + 0.0 ELSE esg_adjusted_score END', 'esg_adjusted_score')} "
        "FROM fail"
    ),
    "stream_scores": BASE_CTES + f"SELECT {SCORED_SELECT} FROM scored",
    "stream_counts": BASE_CTES + "SELECT sentiment, esg_flag, count(*) AS n FROM scored GROUP BY ALL",
}
ORACLE_SQL["company_tag_join"] = ORACLE_SQL["company_tag_table"]
ORACLE_SQL["company_tag_automaton"] = (
    f"WITH {NEWS_SQL}, {DIM_SQL}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS w FROM benchmark), "
    "names AS (SELECT priority, company, category FROM dim UNION ALL SELECT 100, w, 'Word' FROM words), "
    "hits AS (SELECT n.doc_id, d.company, d.category, row_number() OVER (PARTITION BY n.doc_id ORDER BY d.priority, d.company) AS k "
    "FROM news n JOIN names d ON contains(lower(n.Headline), lower(d.company))) "
    "SELECT n.doc_id, h.company, h.category FROM news n LEFT JOIN hits h ON h.doc_id = n.doc_id AND h.k = 1")

ORACLE_SQL["csv_by_header"] = f"WITH {NEWS_SQL} SELECT doc_id, Headline, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, source FROM news"
ORACLE_SQL["csv_rejected"] = "SELECT doc_id || ',\"x, y\",' || source || ',too many' AS record, true AS located FROM documents WHERE doc_id % 50 = 7"
ORACLE_SQL["no_company_reports"] = BASE_CTES + (
    "SELECT 'headlines' AS report, count(*) AS n FROM scored WHERE company IS NULL UNION ALL SELECT unnest(['top', 'pivot', 'stacked']), 0 "
    "UNION ALL SELECT 'distribution', count(DISTINCT sentiment) FROM scored WHERE company IS NULL")
ORACLE_SQL["shipped_model_scores"] = ORACLE_SQL["sentiment_scores"]
ORACLE_SQL["parquet_round_trip"] = ORACLE_SQL["scored_headlines"]
ORACLE_SQL["stream_top6"] = ORACLE_SQL["company_sentiment_top6"]
ORACLE_SQL["stream_summary"] = ORACLE_SQL["summary_metrics"]
ORACLE_SQL["stream_histogram"] = ORACLE_SQL["materiality_histogram"]
_ENC_TOKENS = f"regexp_extract_all(lower(Headline), {_q(C.LEXICAL_TOKEN)})"
_ENC_COUNTS = [f"len(list_filter({_ENC_TOKENS}, lambda w: w = {_q(t)}))" for t in _ANCHOR]
ORACLE_SQL["materiality_encoder_stub"] = (
    f"WITH {NEWS_SQL}, enc AS (SELECT doc_id, {' + '.join(_ENC_COUNTS)} AS dot, "
    f"{' + '.join(f'({c}) * ({c})' for c in _ENC_COUNTS)} AS ss FROM news) "
    f"SELECT doc_id, {_r(f'CASE WHEN coalesce(ss, 0) = 0 THEN 0.0 ELSE dot / (sqrt(ss::DOUBLE) * {_ANCHOR_NORM_SQL}) END', 'materiality_score')} "
    "FROM enc"
)

# Queries without a SQL twin, and why (checked in tests instead).
NO_ORACLE: dict[str, str] = {
    "pipeline_scores": "trained coefficients; recomputed in SQL from a saved model in tests/test_pipeline_scorer.py",
}
ORACLE_SQL["sampled_attribution"] = (
    f"WITH {NEWS_SQL}, {_walk_ctes(SAMPLED_PLAYERS, SAMPLED_ORDERS)} " + _phi_table("env_phi", "'env_impact'", "env_err"))
ORACLE_SQL["model_attribution"] = f"WITH {NEWS_SQL}, {_attribution_ctes(4)} " + _phi_table("sent_phi", "label")
ORACLE_SQL["single_headline"] = (
    f"WITH {news_sql(strip=True)}, {TAGS_SQL}, {BOW_SQL}, {SCORED_SQL} "
    "SELECT doc_id, Headline, company, esg_flag, noise_flag, "
    f"{_r('cumulative_score', 'cumulative_score')}, sentiment, {_r('materiality_score', 'materiality_score')}, "
    f"{_r('esg_adjusted_score', 'esg_adjusted_score')} FROM scored"
)
ORACLE_SQL["token_attribution"] = (
    f"WITH {NEWS_SQL}, {_walk_ctes(1 << 30, TOKEN_ORDERS)} " + _phi_table("env_phi", "'env_impact'", "env_err"))
_TREE_CTES = _walk_ctes(1 << 30, TREE_SAMPLES, tree=True, paired=True)
ORACLE_SQL["tree_attribution_sentiment"] = f"WITH {NEWS_SQL}, {_TREE_CTES} " + _phi_table("sent_phi", "label", "sent_err")
ORACLE_SQL["tree_attribution_env"] = f"WITH {NEWS_SQL}, {_TREE_CTES} " + _phi_table("env_phi", "'env_impact'", "env_err")
ORACLE_SQL["error_attribution"] = (
    f"WITH {NEWS_SQL}, {_walk_ctes(ERROR_PLAYERS, ERROR_SAMPLES, paired=True, tolerance=ERROR_TOLERANCE, least=ERROR_LEAST)} "
    + _phi_table("env_phi", "'env_impact'", "env_err", "n_samples"))
ORACLE_SQL["model_tree_attribution"] = (
    f"WITH {NEWS_SQL}, {_walk_ctes(MODEL_TREE_PLAYERS, 1, tree=True, paired=True)} " + _phi_table("sent_phi", "label"))
ORACLE_SQL["resumable_scores"] = ORACLE_SQL["model_scorer_stub"].rpartition("CASE WHEN bad THEN 'Neutral'")[0].rstrip().rstrip(",") + " FROM fail"
_MODEL_CTES = _attribution_ctes(4, tuple(_ANCHOR))
ORACLE_SQL["model_env_attribution"] = f"WITH {NEWS_SQL}, {_MODEL_CTES} " + _phi_table("env_phi", "'env_impact'")
ORACLE_SQL["model_audit_score"] = ORACLE_SQL["audit_score"].replace(_attribution_ctes(), _MODEL_CTES)
ORACLE_SQL["score_formats"] = (
    "WITH v AS (SELECT doc_id, doc_id % 4001 - 2000 AS i FROM documents), x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN i::DOUBLE / 32.0::DOUBLE "
    "WHEN 1 THEN (2 * i + 1)::DOUBLE / 20000.0::DOUBLE ELSE (2 * i + 1)::DOUBLE / 2000.0::DOUBLE END AS x FROM v) "
    "SELECT doc_id, printf('%+.4f', x) AS signed4, printf('%.4f', x) AS unsigned4, printf('%+.3f', x) AS signed3 FROM x")
ORACLE_SQL["headline_vectors"] = BASE_CTES + f", {EMB_SQL} " + (
    f"SELECT s.doc_id, {_r('e.materiality_score', 'materiality_score')}, "
    f"{_r('s.direction * e.materiality_score + 0.0', 'esg_adjusted_score')} FROM scored s LEFT JOIN emb e ON e.vec_id = s.doc_id")
