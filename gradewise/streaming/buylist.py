"""The daily append of new postings as a stream: a post id or an image that was seen before is dropped.

Two stores keep what was seen, one by post id and one by image, as keyed state of two stateful steps
that follow each other: an image counts as seen only if its post was new. A key's rows of one batch
come to the step together, and the first of them by time stays, so results don't depend on how
postings that arrive in the order of their time are split into batches. State is kept by time of
arrival, not of posting: old postings that are collected later aren't late. A store's entry expires
when its key was not seen for ``keep_days``, which bounds the state.

Postings without an image all pass the second step, each under a key of its own; postings without an id are one post each only if the
source says so, so they count as the post of the empty id, as in ``operators.buylist.new_posts``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from gradewise.streaming.state import DAY_MS, append_available, combined, first_rows

KEEP_DAYS = 400
#: Lists of keys in a store. A store that was written with another number must be built again.
BUCKETS = 1 << 12
#: What stands between the keys of an entry, and before a letter that stands for one of the two in a key.
BETWEEN, ESCAPE = "\x1f", "\x1e"


def entries_of(keys: Iterable[str | None]) -> list[tuple[str | None]]:
    """The entries of a list that hold these keys: one for all texts, one for null."""
    texts, none = [], []
    for k in keys:
        texts.append(k.replace(ESCAPE, ESCAPE + "e").replace(BETWEEN, ESCAPE + "b")) if k is not None else none.append((None,))
    return ([(BETWEEN.join(texts),)] if texts else []) + none[:1]


def keys_of(entries: Iterable[tuple[str | None]]) -> set[str | None]:
    out: set[str | None] = set()
    for (text,) in entries:
        keys = [None] if text is None else text.split(BETWEEN)
        out.update(keys if text is None or ESCAPE not in text else (k.replace(ESCAPE + "b", BETWEEN).replace(ESCAPE + "e", ESCAPE) for k in keys))
    return out


class FirstOfKey(StatefulProcessor):
    """Gives the first row of each key that isn't in the store, and notes the key. The keys of a bucket are one
    list, so that a batch asks the store once for each bucket, not for each key, and only adds to it. A batch
    adds all its keys of a bucket as one entry, as the store reads a list whole for each entry that is added."""

    def __init__(self, key: str, order: tuple[str, ...], keep_days: int):
        self.key, self.order, self.keep_ms = key, order, keep_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "key string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        place = lambda r: tuple((r[c] is not None, r[c]) for c in self.order)
        first: dict[str | None, Row] = {}
        for r in rows:
            k = r[self.key]
            if k not in first or place(r) < place(first[k]):
                first[k] = r
        seen = keys_of(self.seen.get()) if self.seen.exists() else set()
        yield from (r for k, r in first.items() if k not in seen)
        self.seen.appendList(entries_of(first))  # known ones, too, which prolongs their life

    def close(self) -> None:
        pass


def first_of_key(posts: DataFrame, key: str, order: tuple[str, ...], keep_days: int) -> DataFrame:
    some = combined(posts, lambda rows: first_rows(rows, key, order))
    bucketed = some.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return bucketed.groupBy("bucket").transformWithState(FirstOfKey(key, order, keep_days), bucketed.schema, "append", "processingTime").drop("bucket")


def unseen(posts: DataFrame, keep_days: int = KEEP_DAYS, ties: str | None = None) -> DataFrame:
    """A stream of postings (post_id, image_hash, posted_at and others) without those whose post id
    or image came before. Of one time, the least image, then the least id comes first, or the
    least ``ties``, if there is such a column."""
    once = first_of_key(posts, "post_id", ("posted_at", ties or "image_hash"), keep_days)
    # A posting without an image is a key of its own, which is new as its post is: no key holds them all.
    picture = F.coalesce(F.concat(F.lit("i"), "image_hash"), F.concat(F.lit("p"), F.coalesce("post_id", F.lit(""))))
    return first_of_key(once.withColumn("picture", picture), "picture", ("posted_at", ties or "post_id"), keep_days).drop("picture")


def new_postings(spark: SparkSession, folder: str, schema: StructType, keep_days: int = KEEP_DAYS, files: int | None = None) -> DataFrame:
    """The postings of a folder's Parquet files that are new; ``files`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    return unseen((reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder), keep_days)


def append_daily(spark: SparkSession, folder: str, schema: StructType, to: str, state: str, keep_days: int = KEEP_DAYS, files: int | None = None) -> StreamingQuery:
    """Appends what is new since the last run to the Parquet folder ``to``; ``state`` keeps what was seen.
    Both must be folders that driver and executors share."""
    return append_available(new_postings(spark, folder, schema, keep_days, files), to, state)
