"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", app: str = "tidings", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UI off).

    On a cluster the same settings come from ``spark-submit``; this builder
    is for tests and ``bench.py``.
    """
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, CSV sinks and stream checkpoints.

    Read from ``spark.checkpoint.dir``. Only a local-mode session without
    that setting gets a fresh folder of its own (tests, local runs); a
    cluster session must name a shared folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a SparkContext (remote client): conf only
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        return folder.rstrip("/")
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):  # local-cluster is a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tidings-work-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
