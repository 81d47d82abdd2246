"""Sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def insert_rows(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends to a Parquet table the rows whose keys it doesn't hold yet; of rows with equal keys one, so that a repeated insert adds
    nothing. The table is made if there is none. One writer at a time; committed.CommittedTable serves several."""
    rows = df.dropDuplicates(keys)
    try:
        table = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything but no table yet
            raise
        held = None
    else:
        held = table.select(*keys)
    (rows if held is None else rows.join(held, keys, "left_anti")).write.mode("append").parquet(path)
