"""Session defaults. The library never needs them; they suit tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session on ``cpus`` threads (all by default); on a cluster use the given session instead."""
    n = str(cpus) if cpus else "*"
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus or os.cpu_count() or 8), "spark.driver.memory": "12g"} | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName("quillgrid").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
