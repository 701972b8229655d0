"""Helpers the operators of this subpackage share: reading, cutting lineage, and applying a
per-text function inside Spark's tasks in byte-bounded slices."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of text that a per-text function is given at once (a longer single text comes alone).
SLICE_BYTES = 4 << 20
#: Most bytes of a batch that Spark sends to a worker (or one row more): both sides hold batches whole, and a batch
#: of less than a slice is mostly one slice. Spark's own bound is 64 MB and 10,000 rows.
BATCH_BYTES = SLICE_BYTES // 4 * 3
#: Rows of a partition, and fewest partitions, where ``cut`` is told how many rows come.
PART_ROWS, FEWEST = 100_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` has, in any case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def others(columns: Iterable[str], new: Iterable[str]) -> list[str]:
    """The columns whose name no new column has, in any case."""
    held = {n.lower() for n in new}
    return [c for c in columns if c.lower() not in held]


def carried(docs: DataFrame, *own: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, beside columns of an operator's own, so that
    no name of a document's column can clash with one of the operator's."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), *own)


def unpacked(rows: DataFrame, columns: Iterable[str]) -> list[Column]:
    """The columns that ``carried`` took along."""
    return [rows["row"].getField(c).alias(c) for c in columns]


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materializes in the shared checkpoint folder and cuts the lineage; where at most so many rows are
    known to come, in no more partitions than these need, as rounds over little data cost a task and
    a file for each.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session on one machine
    gets a temporary one; on a cluster no folder of one machine will do, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return (df if rows is None else df.coalesce(max(FEWEST, rows // PART_ROWS))).checkpoint()


def text_bytes(name: str) -> Column:
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit("")).cast("binary")


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each, of one row at least."""
    lo = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(lengths):
        yield lo, len(lengths)


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's batches to ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released() -> None:
    """Gives back what a worker no longer uses at a task's end, as idle workers keep what they hold."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)  # only glibc has it


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[bytes]], list]],
    new: str,
    keep: Iterable[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Appends columns computed from each whole text, in one narrow pass without a shuffle.

    ``make()`` runs once a task and returns a function from a list of UTF-8 texts to the lists
    of the new columns (DDL ``new``); its attribute ``close``, if any, is called at the task's end.
    ``keep`` (all, if None) pass through; a kept column that has the name of a new one, in any
    case, gives way to it.
    """
    added = T.StructType.fromDDL(new)
    keep = others(docs.columns if keep is None else keep, added.names)
    # mapInArrow asks for its columns by name, which one with a dot can't answer.
    source = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], text_bytes(text).alias("raw"))
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, names = [f.type for f in to_arrow_schema(added)], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            raw, held = batch.columns[-1], batch.columns[:-1]
            for lo, hi in slices(pc.binary_length(raw).to_numpy(zero_copy_only=False)):
                out = apply(raw.slice(lo, hi - lo).to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in held] + made, names=names)
        getattr(apply, "close", lambda: None)()
        released()

    bounded_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow, where ``run`` takes and gives Arrow record batches."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(apply, schema)
