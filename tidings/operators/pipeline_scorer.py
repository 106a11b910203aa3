"""A trainable sentiment scorer: hashed terms, IDF, logistic regression (Spark ML).

Training is distributed (term statistics and every gradient are tree aggregates over
the labelled rows; the driver holds the coefficients only, ``features`` x classes)
and the fitted pipeline is saved to and loaded from shared storage. Scoring is
JVM-side, row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.config import FALLBACK_SCORES, LEXICAL_TOKEN, SENTIMENT_CHAR_LIMIT
from tidings.functions.text import col_, truncate
from tidings.operators.scorers import SCORE_FIELDS, fallback_struct

_TEXT, _LABEL, _WEIGHT = "__pipeline_text", "__pipeline_label", "__pipeline_weight"
#: Terms: lexical tokens, and runs of signs between them.
TERM = rf"{LEXICAL_TOKEN}|[^a-z0-9\s]+"
_STEPS = ("__pipeline_tokens", "__pipeline_counts", "__pipeline_weighted", "__pipeline_features")
_OUT = ("__pipeline_raw", "__pipeline_probability", "__pipeline_prediction")


class PipelineScorer:
    """The scorer contract around a fitted pipeline.

    ``classes`` names the label of every class index (a subset of positive,
    negative, neutral); a class the model doesn't know scores 0. A null text has
    the fallback scores. The pipeline is a chain of frame transformers, so the
    scorer adds its struct to a frame (``add``) and has no Column form.
    """

    reports_errors = False

    def __init__(self, model: PipelineModel, classes: tuple[str, ...], max_chars: int | None = SENTIMENT_CHAR_LIMIT):
        unknown = set(classes) - set(SCORE_FIELDS)
        if unknown:
            raise ValueError(f"classes must be among {SCORE_FIELDS}, not {sorted(unknown)}")
        self.model = model
        self.classes = tuple(classes)
        self.max_chars = max_chars

    @classmethod
    def train(cls, rows: DataFrame, text_col: str, label_col: str, classes: tuple[str, ...] = ("negative", "positive"),
              max_chars: int | None = SENTIMENT_CHAR_LIMIT, features: int = 1 << 16, least_documents: int = 2,
              regularisation: float = 0.002, iterations: int = 40) -> "PipelineScorer":
        """Fit on rows with a text and a label (the class index); others are left out.
        Classes weigh the same, however many rows each has."""
        text = truncate(F.col(text_col), max_chars) if max_chars is not None else F.col(text_col)
        known = (rows.select(text.alias(_TEXT), F.col(label_col).cast("double").alias(_LABEL))
                 .filter(F.col(_TEXT).isNotNull() & F.col(_LABEL).isNotNull()))
        rows_of = {r[_LABEL]: r["count"] for r in known.groupBy(_LABEL).count().collect()}  # one row per class
        weight = F.create_map(*[F.lit(x) for y, n in rows_of.items() for x in (y, sum(rows_of.values()) / (len(rows_of) * n))])
        known = known.withColumn(_WEIGHT, weight[F.col(_LABEL)])
        tokens, counts, weighted, vector = _STEPS
        pipeline = Pipeline(stages=[
            RegexTokenizer(inputCol=_TEXT, outputCol=tokens, pattern=TERM, gaps=False, toLowercase=True),
            HashingTF(inputCol=tokens, outputCol=counts, numFeatures=features),
            IDF(inputCol=counts, outputCol=weighted, minDocFreq=least_documents),
            Normalizer(inputCol=weighted, outputCol=vector, p=2.0),
            LogisticRegression(featuresCol=vector, labelCol=_LABEL, weightCol=_WEIGHT, rawPredictionCol=_OUT[0], probabilityCol=_OUT[1], predictionCol=_OUT[2],
                               regParam=regularisation, maxIter=iterations, family="multinomial" if len(classes) > 2 else "auto"),
        ])
        return cls(pipeline.fit(known), classes, max_chars)

    def save(self, path: str) -> None:
        """The fitted stages, and what the contract adds to them, under ``path``
        (new or overwritten; a folder all executors see)."""
        self.model.write().overwrite().save(f"{path.rstrip('/')}/model")
        spark = SparkSession.active()
        row = [(i, name, self.max_chars) for i, name in enumerate(self.classes)]
        spark.createDataFrame(row, "index int, class string, max_chars int").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PipelineScorer":
        rows = sorted(spark.read.parquet(f"{path.rstrip('/')}/classes").collect())
        return cls(PipelineModel.load(f"{path.rstrip('/')}/model"), tuple(r["class"] for r in rows), rows[0]["max_chars"])

    def add(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """``df`` with the struct<positive, negative, neutral, score_error>."""
        text = truncate(F.col(text_col), self.max_chars) if self.max_chars is not None else F.col(text_col)
        scored = self.model.transform(df.withColumn(_TEXT, F.coalesce(text, F.lit(""))))
        p = vector_to_array(F.col(_OUT[1]))

        def of(field: str) -> Column:
            return F.get(p, F.lit(self.classes.index(field))) if field in self.classes else F.lit(0.0)

        struct = F.struct(*[F.coalesce(of(f), F.lit(v)).alias(f) for f, v in zip(SCORE_FIELDS, FALLBACK_SCORES)],
                          F.lit(None).cast("string").alias("score_error"))
        return (scored.withColumn(out_col, F.when(col_(text_col).isNull(), fallback_struct(None)).otherwise(struct))
                .drop(_TEXT, *_STEPS, *_OUT))
