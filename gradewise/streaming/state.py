"""What the streams of this package share: keyed state in RocksDB, and streams that end when all is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Arbitrary keyed state needs RocksDB; state that expires by time of arrival would ask for one more batch
#: without rows for ever, and a stream that ends must not.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
DAY_MS = 24 * 3600 * 1000
#: Rows that a task combines at once before they go to the state.
HELD_ROWS = 1 << 19


def combined(rows: DataFrame, some: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """A stream's rows, of which each task keeps what ``some`` keeps of up to HELD_ROWS of them: a partial
    aggregation before the shuffle to the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield from some(pa.Table.from_batches(held)).to_batches()
                held, n = [], 0
        if n:
            yield from some(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def distinct_rows(rows: pa.Table) -> pa.Table:
    return rows.group_by(rows.column_names, use_threads=False).aggregate([])


def first_rows(rows: pa.Table, key: str, order: tuple[str, ...]) -> pa.Table:
    """The first row of each key in an order, nulls first."""
    at = pa.compute.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    rows = rows.take(at)
    place = pa.table({"key": rows[key], "at": pa.array(range(rows.num_rows), pa.int64())})
    return rows.take(place.group_by("key", use_threads=False).aggregate([("at", "min")])["at_min"])


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings of a stream with keyed state, which a query takes when it starts."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_available(rows: DataFrame, to: str, state: str) -> StreamingQuery:
    """Appends all that is there now to the Parquet folder ``to``, each row once: after a failure the next
    start repeats the batch that was not committed, with the state that it had before it."""
    out = rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", state)
    with keyed_state(rows.sparkSession):
        return out.outputMode("append").trigger(availableNow=True).start()
