"""Working tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where it is unset (local tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="kinmark-")
        at = _OWN[sc.applicationId]
    return at.rstrip("/")


class Scratch:
    """Parquet tables under the shared folder: each cuts lineage and outlives any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        """Write the rows, in a folder for each value of the columns ``by``, and read them."""
        self._n += 1
        path = f"{self.at}/{self._n}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kinmark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._kinmark_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_column: str, text_column: str) -> Column:
    """64-bit key of a row: equal for repeated rows, and defined for null ids and texts."""
    return F.xxhash64(F.col(id_column).cast("string"), F.col(text_column), F.col(id_column).isNull(), F.col(text_column).isNull())


def second_key(id_column: str, text_column: str) -> Column:
    """Another 64 bits of a row: with ``row_key`` a key on which rows can be told apart in any corpus."""
    return F.xxhash64(F.lit("second"), F.length(F.col(text_column).cast("string")), F.col(text_column).cast("string"), F.col(id_column).cast("string"), F.col(id_column).isNull())


def free_name(columns: list[str], base: str) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
