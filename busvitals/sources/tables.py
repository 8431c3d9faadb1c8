"""Window tables and JSON tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.functions import fixed_values as fv

_FLAT = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}


def flat_schema(text: str) -> T.StructType:
    """``name type, name type`` as a schema; usable before a session exists."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _FLAT[kind]) for name, kind in pairs])


WINDOW_SCHEMA = T.StructType(
    [T.StructField("vehicle_id", T.StringType()), T.StructField("w", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in fv.FEATURES]
    + [
        T.StructField("attack_label", T.IntegerType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("n_frames", T.LongType()),
    ]
)


def stored_schema(*extra: T.StructField) -> T.StructType:
    """Schema of a stored window table, partition column last, so reading infers nothing."""
    return T.StructType([*WINDOW_SCHEMA.fields, *extra, T.StructField("capture", T.StringType())])


def write_windows(windows: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per capture, compressed Parquet."""
    windows.write.mode(mode).partitionBy("capture").parquet(path)


def load_windows(spark: SparkSession, path: str, captures: Sequence[str] = tuple(fv.CLASSES)) -> DataFrame:
    """The captures that exist under ``path``; missing ones are skipped, none at all is an error.

    One read with partition pruning on ``capture``.
    """
    found = spark.read.schema(stored_schema()).parquet(path).where(F.col("capture").isin(list(captures)))
    if found.isEmpty():
        raise FileNotFoundError(f"no window data in {path}; expected one of {', '.join(captures)}")
    return found


def write_stories(stories: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON document per line: the vehicle, the lower-case class and the nested story."""
    stories.select("vehicle_id", F.lower("attack_type").alias("scenario"), "story").write.mode(mode).json(path)


def read_stories(spark: SparkSession, path: str, story_schema: str) -> DataFrame:
    return spark.read.schema(f"vehicle_id STRING, scenario STRING, story STRUCT<{_as_struct(story_schema)}>").json(path)


def _as_struct(ddl: str) -> str:
    """Table-style DDL (name TYPE) as struct-style DDL (name: TYPE)."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def append_decisions(decisions: DataFrame, path: str, run_date: str) -> None:
    """Append decisions to the audit log."""
    decisions.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").json(path)


def read_decisions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType(schema.fields + [T.StructField("run_date", T.StringType())])).json(path)
