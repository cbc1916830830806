"""Session settings that suit these jobs; a cluster's own settings win where it has them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app_name: str = "hitloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session for these jobs. ``shuffle_partitions`` is for small local runs only:
    on a cluster leave it to the submitter and let adaptive execution merge small partitions."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name for tables that cut lineage or feed a stream.

    It lies in the shared folder that the cluster names in ``spark.checkpoint.dir``. Where that setting is absent,
    a local folder is used if all tasks run in this process; on a cluster that is an error, as each executor
    would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = os.path.join(tempfile.gettempdir(), "hitloom-scratch")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
