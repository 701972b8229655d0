"""Sinks: JSON outputs of a run. Each is a folder of JSON lines, overwritten as a whole.

The outputs of a run that belong together are published as a set: each attempt of a run writes folders
of its own, and last of all a marker that names the attempt. Readers follow the newest marker, so
they see all outputs of one attempt, and a failure between two writes leaves the last set as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKERS = "_runs"
MARKER = T.StructType([T.StructField("place", T.LongType()), T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType()), T.StructField("outputs", T.ArrayType(T.StringType()))])


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def history_file(grid: DataFrame) -> DataFrame:
    """A stock history in the form of its file: (card_id, stocks) with the values in the order of the dates."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("date_pos", "stock"))), lambda x: x["stock"])
    return grid.groupBy("card_id").agg(values.alias("stocks"))


def write_stock_run(folder: str, **outputs: DataFrame) -> None:
    """The outputs of a stock run (cards, catalog, history, summary, invalid, recheck, misses), each in a folder of its name."""
    for name, rows in outputs.items():
        write_json(rows, f"{folder}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def current_run(spark: SparkSession, folder: str) -> tuple[int, str, str] | None:
    """(place, run, attempt) of the newest whole set of outputs in a folder, if there is one."""
    if not _exists(spark, f"{folder}/{MARKERS}"):
        return None
    last = spark.read.schema(MARKER).json(f"{folder}/{MARKERS}").agg(F.max(F.struct("place", "run", "attempt")).alias("m")).first()["m"]
    return None if last is None else tuple(last)


def publish_run(folder: str, run: str, **outputs: DataFrame) -> str:
    """Writes the outputs of a run as one set and makes it the current one. The attempt's name is returned.
    A run that is done again becomes the current one again, as a new attempt."""
    spark, attempt = next(iter(outputs.values())).sparkSession, uuid.uuid4().hex
    for name, rows in outputs.items():
        write_json(rows, f"{folder}/{name}/run={run}/attempt={attempt}")
    before = current_run(spark, folder)
    marker = spark.createDataFrame([((before[0] if before else 0) + 1, run, attempt, sorted(outputs))], MARKER)
    marker.coalesce(1).write.mode("append").json(f"{folder}/{MARKERS}")  # the file is there as a whole or not at all
    return attempt


def read_run(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """One output of the current set; empty if there is no set yet or it has no such output."""
    at = current_run(spark, folder)
    path = at and f"{folder}/{name}/run={at[1]}/attempt={at[2]}"
    return spark.read.schema(schema).json(path) if path and _exists(spark, path) else spark.createDataFrame([], schema)
