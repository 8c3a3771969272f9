"""A Spark session for tests, benchmarks and small installations.

On a cluster pass the cluster's own session; nothing in the package depends on this builder.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "shipcause", **conf: str) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.openCostInBytes": str(1 << 20),  # split small files over all local cores
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call sites per expression
        "spark.driver.memory": "12g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
