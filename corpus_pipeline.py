"""A corpus pipeline over ``documents``: five stages, each one operator of
``tidings.llm`` applied to all rows that the stage before it kept.

1. quality: documents that the quality classifier rejects go (op 9).
2. near_duplicates: one document of each SimHash component stays (op 1).
3. repeated_passages: bytes covered by a 100-byte string that also starts
   earlier are cut from the texts (op 7); every document stays, if with an
   empty text.
4. decontamination: documents that hold a benchmark window go (op 5).
5. mixing: sources are mixed to their target weights (op 8).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared work folder and read back as the next stage's docs, so
a lost executor never costs more than the stage that is running. All but the
last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.llm.common import stored, table
from tidings.llm.decontaminate import drop_contaminated
from tidings.llm.mixing import mix
from tidings.llm.quality import keep_good
from tidings.llm.simhash import keep_one
from tidings.llm.suffix import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: A trained classifier and the mixing draws have no SQL form; the stages are
#: tested one by one against plain versions (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
