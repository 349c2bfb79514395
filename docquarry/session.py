"""Spark sessions for local use; on a cluster pass the cluster's own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "docquarry", **options: str) -> SparkSession:
    if cores == "*":
        cores = os.cpu_count() or 1
    conf = {
        "spark.checkpoint.dir": f"file://{os.path.join(tempfile.gettempdir(), f'docquarry-{os.getpid()}')}",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    } | options
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
