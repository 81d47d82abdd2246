"""Tables between the steps of a query, for what several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, tempfile.TemporaryDirectory] = {}  # folders of local sessions without a setting, by application


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the folder of spark.checkpoint.dir, which driver and executors share, and read back: what made it isn't
    run again, and a lost executor costs its running tasks only. A local session without the setting gets a temporary folder; on
    a cluster that is an error. The tables stay until the folder's owner clears them."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.TemporaryDirectory(prefix="tessera-", ignore_cleanup_errors=True)
        folder = f"file://{_own[context.applicationId].name}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
