"""Tables cut into ranges of an order. Each range is a folder, and a small table of ends names the first and
last key of each, so that readers open the folders that can hold what they look for and list no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.sources.shared import cut

#: Rows of a range.
ROWS = 250_000


def write_ranges(rows: DataFrame, folder: str, order: list[Column], ends: dict[str, Column], per_range: int = ROWS) -> None:
    """Writes rows in ranges of an order that has no ties, so that equal values can't fill one range, and
    the aggregates ``ends`` of each range. The rows are computed once."""
    rows = cut(rows)
    number = max(1, -(-rows.count() // per_range))
    placed = rows.repartitionByRange(number, *order).withColumn("range", F.spark_partition_id())
    placed.sortWithinPartitions("range", *order).write.mode("overwrite").partitionBy("range").parquet(f"{folder}/rows")
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/columns")
    read_rows(rows.sparkSession, folder).groupBy("range").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in ends.items()]).write.mode("overwrite").parquet(f"{folder}/ends")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their ``range``."""
    schema = spark.read.parquet(f"{folder}/columns").schema.add("range", "integer")
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def read_ends(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/ends")


def read_ranges(spark: SparkSession, folder: str, numbers: list[int]) -> DataFrame:
    """The rows of some ranges."""
    if not numbers:
        return spark.read.parquet(f"{folder}/columns")
    return spark.read.option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/range={n}" for n in numbers]).drop("range")
