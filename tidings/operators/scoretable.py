"""A content-addressed table of model outputs: every distinct text is scored once.

A text's key is the MD5 of its UTF-8 bytes (128 bits, used as an address, not for
security), so equal texts share a row wherever they come from: copies of a
headline, masked texts of different headlines, a later run. Rows also carry the
model's version. Work that is already in the table is taken out by an anti-join
before a model sees it; the rest is scored and appended in parts, each its own
commit, so a run that is cut goes on behind the last whole part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.config import FALLBACK_SCORES
from tidings.functions.text import truncate
from tidings.operators.materiality import EncoderCosine
from tidings.operators.scorers import SCORE_FIELDS, ModelScorer, raw_to_scores
from tidings.plans.chain import spread
from tidings.session import fresh_path

TABLE_TYPE = "version string, key binary, positive double, negative double, neutral double, cosine double, score_error string"
_AT_ONCE = 512  # texts gathered before they go to the models,
_CHARS = 1 << 22  # or texts of this many characters
_ROWS = 16  # rows of a batch that are Python objects at a time
#: A key with this share of all uses is hot: there are at most 1,000 of them.
HOT_SHARE = 1000


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def model_rows(scorer: ModelScorer, encoder: EncoderCosine | None = None) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    """A loader of ``texts -> [(positive, negative, neutral, cosine, error)]``.

    Models run in batches of the scorer's size. A batch that fails is retried text
    by text; what still fails has the fallback scores and the reason.
    """
    load, load_encoder, size = scorer.loader, encoder.loader if encoder else None, scorer.batch_size
    anchor = np.asarray(encoder.anchor_vector if encoder else [], dtype=np.float64)

    def make():
        classify, encode = load(), load_encoder() if load_encoder else None

        def score(texts: list[str]) -> list[tuple]:
            found = [raw_to_scores(r) for r in classify(texts)]
            cosines: list = [None] * len(texts)
            if encode:
                x = np.asarray(encode(texts), dtype=np.float32).astype(np.float64)
                length = np.sqrt((x * x).sum(axis=1)) * np.sqrt(anchor @ anchor)
                cosines = np.divide(x @ anchor, length, out=np.zeros(len(x)), where=length != 0).tolist()
            return [(*(r[f] for f in SCORE_FIELDS), c, None) for r, c in zip(found, cosines)]

        def one(text: str) -> tuple:
            try:
                return score([text])[0]
            except Exception as exc:  # per-text fallback
                return (*FALLBACK_SCORES, None, f"{type(exc).__name__}: {exc}")

        def rows(texts: list[str]) -> list[tuple]:
            out = []
            for at in range(0, len(texts), size):
                batch = texts[at:at + size]
                try:
                    out += score(batch)
                except Exception:
                    out += [one(t) for t in batch]
            return out

        return rows

    return make


def known_scores(spark: SparkSession, path: str) -> DataFrame:
    """The table, or no rows where there is none yet."""
    try:
        return spark.read.schema(TABLE_TYPE).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], TABLE_TYPE)


def append_scores(todo: DataFrame, expand: Callable[[pa.RecordBatch], Iterator[tuple[bytes, str]]], models, path: str, version: str,
                  part: Column, parts: int = 1, stop_after: int | None = None) -> None:
    """Score the texts that ``expand`` makes of the rows of ``todo`` and append them.

    ``part`` is a whole number per row; rows with the same remainder by ``parts``
    are one commit. ``stop_after``: leave the later parts undone.
    """

    def work(batches):
        rows = models()

        def scored(queue):
            values = list(zip(*rows([t for _, t in queue])))
            return pa.RecordBatch.from_arrays(
                [pa.array([version] * len(queue)), pa.array([k for k, _ in queue], pa.binary()),
                 *(pa.array(v, pa.float64()) for v in values[:4]), pa.array(values[4], pa.string())],
                names=["version", "key", *SCORE_FIELDS, "cosine", "score_error"])

        queue, chars = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for item in expand(batch.slice(at, _ROWS)):
                    queue.append(item)
                    chars += len(item[1])
                    if len(queue) >= _AT_ONCE or chars >= _CHARS:
                        yield scored(queue)
                        queue, chars = [], 0
        if queue:
            yield scored(queue)

    for n in range(parts if stop_after is None else min(parts, stop_after)):
        rows = todo if parts == 1 else todo.filter(F.pmod(part, F.lit(parts)) == n)
        rows.mapInArrow(work, TABLE_TYPE).write.mode("append").parquet(path)


def with_values(uses: DataFrame, values: DataFrame) -> DataFrame:
    """``uses`` (key, ...) with the values of their keys.

    Keys that many rows use (the empty text, copies) would make one task of the
    join hot. ``values.uses`` says how often each is used: those with a
    thousandth of all uses or more, at most 1,000 rows, are joined by broadcast.
    """
    total = values.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    hot = values.filter(F.col("uses") * HOT_SHARE >= F.lit(total)).drop("uses")
    rest = values.filter(F.col("uses") * HOT_SHARE < F.lit(total)).drop("uses")
    near = uses.join(F.broadcast(hot), "key")
    far = uses.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key")
    return near.unionByName(far)


def score_resumable(df: DataFrame, scorer: ModelScorer, table: str | None = None, version: str = "1", text_col: str = "Headline",
                    parts: int = 8, stop_after: int | None = None) -> DataFrame | None:
    """``df`` with ``scores`` (as ``scorer.expr``), every distinct text scored once.

    Only texts that ``table`` doesn't hold for ``version`` are scored, and
    appended to it in ``parts`` commits. A run that ends early (killed, or
    ``stop_after`` parts, which returns nothing) is continued by calling it again.
    Null texts have the fallback scores and no error.
    """
    spark = df.sparkSession
    table = table or fresh_path(spark, "score-table")
    text = truncate(F.col(text_col), scorer.max_chars) if scorer.max_chars is not None else F.col(text_col)
    texts = (df.select(text.alias("text")).filter(F.col("text").isNotNull()).withColumn("key", text_key(F.col("text")))
             .groupBy("key").agg(F.min("text").alias("text")))
    done = known_scores(spark, table).filter(F.col("version") == version).select("key")
    todo = texts.join(done, "key", "left_anti")

    def expand(batch: pa.RecordBatch):
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    # The parts are cut from the anti-join before the first commit changes it.
    queue = fresh_path(spark, "score-queue")
    todo.select("key", "text").write.parquet(queue)
    waiting = spread(spark.read.schema("key binary, text string").parquet(queue))
    append_scores(waiting, expand, model_rows(scorer), table, version, F.xxhash64("key"), parts, stop_after)
    if stop_after is not None:
        return None
    values = known_scores(spark, table).filter(F.col("version") == version).select("key", *SCORE_FIELDS, "score_error")
    keyed = df.withColumn("key", F.when(F.col(text_col).isNotNull(), text_key(text)))
    uses = keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    found = with_values(keyed.filter(F.col("key").isNotNull()), values.join(uses, "key"))
    scores = F.struct(*[F.col(f) for f in SCORE_FIELDS], F.col("score_error")).alias("scores")
    none = F.struct(*[F.lit(v).alias(f) for f, v in zip(SCORE_FIELDS, FALLBACK_SCORES)], F.lit(None).cast("string").alias("score_error"))
    missing = keyed.filter(F.col("key").isNull()).select(*df.columns, none.alias("scores"))
    return found.select(*df.columns, scores).unionByName(missing)
