"""Pages of a search that start after a key, from tables in ranges of each order.

A page costs the ranges in which its rows stand, however far behind it is: the key of the last row shown says
where to go on. Ranges are read in order, twice as many each time, until the page is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gradewise.operators.profit import condition, order, sort_value, with_profit
from gradewise.plans.params import ProfitQuery
from gradewise.sources.ranges import ROWS, read_ends, read_ranges, write_ranges
from gradewise.sources.shared import cut


def _at(folder: str, sort: str, fee: float) -> str:
    return f"{folder}/{sort}/fee={fee:g}"


def _last(sort: str) -> Column:
    """The key of the last row in an order, as an aggregate: (order_value, pos)."""
    _, down = sort_value(sort)
    value, pos = F.col("order_value"), F.col("pos")
    place = F.struct(value.isNotNull(), value, -pos) if down else F.struct(value.isNull(), value, pos)
    return (F.min_by if down else F.max_by)(F.struct("order_value", "pos"), place)


def _beyond(sort: str, key: Row, value: Column, pos: Column) -> Column:
    """Whether a row comes after a key."""
    _, down = sort_value(sort)
    if key["order_value"] is None:
        return value.isNull() & (pos > key["pos"])
    v = F.lit(key["order_value"])
    return value.isNull() | ((value < v) if down else (value > v)) | ((value == v) & (pos > key["pos"]))


def write_order(cards: DataFrame, folder: str, sort: str, fee: float = 13000.0, per_range: int = ROWS) -> None:
    """Writes cards with their profit under a fee in ranges of one order."""
    every = with_profit(cards, fee).withColumn("order_value", sort_value(sort)[0])
    write_ranges(every, _at(folder, sort, fee), order(sort), {"last": _last(sort)}, per_range)


def page(spark: SparkSession, folder: str, q: ProfitQuery, after: Row | None = None) -> DataFrame:
    """The ``q.limit`` cards of a search that come after a key, or the first ones. The order and the fee must have been written."""
    at = _at(folder, q.sort, q.fee)
    ends = read_ends(spark, at)
    if after is not None:
        ends = ends.where(_beyond(q.sort, after, F.col("last.order_value"), F.col("last.pos")))
    width = 1
    while True:
        numbers = [r["range"] for r in ends.orderBy("range").limit(width + 1).select("range").collect()]
        more, numbers = len(numbers) > width, numbers[:width]
        rows = read_ranges(spark, at, numbers)
        if after is not None:
            rows = rows.where(_beyond(q.sort, after, F.col("order_value"), F.col("pos")))
        shown = cut(rows.where(condition(q)).orderBy(*order(q.sort)).limit(q.limit))
        if not more or shown.count() == q.limit:
            return shown
        width *= 2


def key_of(shown: DataFrame, sort: str) -> Row | None:
    """The key of a page's last row; none of an empty page."""
    return shown.agg(_last(sort).alias("key")).first()["key"]
