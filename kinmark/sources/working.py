"""Working tables: written to the folder that all executors share, which cuts lineage and lets a table be read often but made once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as Parquet under ``spark.checkpoint.dir`` (a folder of our own only where that is unset, as in tests), read again."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="kinmark-")
        at = _OWN[app]
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
