"""Physical-plan helpers shared by the query catalog and the bench.

``spread`` fixes the one real gap between small test inputs and a cluster
scan: a table stored as one parquet row group is read by one task, so a
CPU-heavy projection over it would run on one core. When the scan has
fewer partitions than the session's parallelism the rows are spread
round-robin, which shuffles them once; a scan with as many splits as there
are cores is left as it is. When it does spread, an ``observe`` node (a row
count) sits on top of the exchange: Catalyst pushes filters through a
round-robin repartition, which would move a filter on a computed column
(``company IS NOT NULL``) and all the text work it inlines back into the
single scan task. Column pruning still reaches the scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, name: str = "rows") -> DataFrame:
    """An ``observe`` node (it counts rows) that the optimizer moves nothing
    through: filters stay above it, projections stay above it, and what is
    below it (a spread, a top-n) is planned on its own."""
    return df.observe(f"{name}_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        partitions = df.rdd.getNumPartitions()
    except Exception:  # a session without RDD access (e.g. a remote client): leave as is
        return df
    if partitions < target:
        return fence(df.repartition(target), "spread")
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (eager).

    For a small projection that several later jobs read: it is computed
    once, and a lost executor re-reads it from shared storage.
    """
    from tidings.session import work_dir

    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
