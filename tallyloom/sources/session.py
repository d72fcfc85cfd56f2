"""Session settings used by the entry points and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster use the session it provides."""
    n = cores or os.cpu_count() or 4
    builder = (SparkSession.builder.master(f"local[{n}]").appName("tallyloom")
               .config("spark.sql.shuffle.partitions", str(n))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "16g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
