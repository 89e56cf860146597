"""Session settings for local runs and tests.

On a cluster the session comes from the platform; these settings are the
ones the analyses rely on (AQE, UTC, ANSI) plus local-sized shuffles.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Remove checkpoint files once their result is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Many distinct analyses: keep their generated classes (static conf).
    "spark.sql.codegen.cache.maxEntries": "1000",
}


def local_session(cores: int = 8, app: str = "ledgerlens", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(cores), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
