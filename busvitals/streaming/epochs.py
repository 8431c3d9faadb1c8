"""State of a stream as one small Parquet table per epoch.

A micro-batch reads the newest state before its epoch and writes its outputs and its state under its own epoch, replacing
what an interrupted attempt may have left. Replaying an epoch therefore gives the same tables. State lives in tables, not
in per-key Python objects, so the frames of one very busy vehicle are spread over tasks like any other data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def batch_session(batch: DataFrame) -> SparkSession:
    """The session of a micro-batch with adaptive execution on.

    Streams switch it off because of their own state operators; these batches have none and need its join choices,
    partition coalescing and skew handling.
    """
    batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return batch.sparkSession


class EpochTable:
    """``<path>/epoch=N`` folders with a fixed schema."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, is_state: bool = False) -> None:
        """State is only read by the next epoch; older ones than a replay of that can need are removed."""
        self.spark, self.path, self.schema, self.is_state = spark, path, schema, is_state

    def write(self, df: DataFrame, epoch: int) -> DataFrame:
        """Replace the epoch and return it as read back, so later steps do not compute it again."""
        df.select(*[f.name for f in self.schema.fields]).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        if self.is_state and epoch > 1:
            old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={epoch - 2}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch={epoch}")

    def before(self, epoch: int) -> DataFrame:
        """The newest epoch below ``epoch``, or no rows."""
        if epoch > 0:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch={epoch - 1}")
        return self.spark.createDataFrame([], self.schema)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch=*")

    def stream(self) -> DataFrame:
        """The table as a stream. An epoch's files may be split over micro-batches; readers must not rely on its order."""
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/epoch=*")
