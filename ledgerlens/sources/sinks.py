"""Materialising intermediate results (the reference's session table).

A materialised result is written once, as Parquet, under the shared folder
that the session names in ``spark.checkpoint.dir``. This cuts the lineage: a
lost executor no longer sends the work back to the raw tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where a session names none (tests, local runs) it is set to a folder in
    the session's warehouse, which all executors share as well.
    """
    root = spark.conf.get(_CONF, None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set(_CONF, root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once, store it as Parquet in the checkpoint folder, return a scan of it.

    Columnar, so later readers prune columns and rows; the folder is the
    session's to clean.
    """
    path = f"{checkpoint_root(df.sparkSession)}/ledgerlens/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
