"""Exact top-k search by distributed histogram selection.

Queries are streamed to the driver in blocks of bounded size, and each block is broadcast and destroyed
after use. For a block, every candidate is scored in every round, in slices of candidates inside the
tasks, where its components become integers, too. A round counts the scores of each query that lie
in its current range in a histogram; the histograms of all tasks are summed by Spark; the bin that
holds the k-th highest score becomes the next, narrower range, until it is one integer wide. Then one
pass keeps the scores at or above it. Of ties at that value, each task needs to pass on only its k
smallest ids; a window ranks what is left. A histogram row leaves a task only for bins that can hold the
k-th score: from the top down to where the task alone has k scores. Bins are so many that a block's
histograms have ``CELLS`` cells, so a task holds some tens of MB whatever the number of queries.

Scores are exact integers of any size: where no product can reach 2**62 they are computed in 64 bits (in
floating point where that is exact), else as Python integers, which is slow.

Defined results: vectors that are null or hold a null or a value that isn't finite take no part, nor
do rows with a null id; vectors of another length than a query's are no candidates of it; rows that
share the query's id are its own; of query rows that share an id the one with the smallest vector
counts; repeated candidate rows are each a candidate; fewer than k candidates are all returned; a
score beyond 64 bits is shown as the nearest bigint, but ranked as it is; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewise.llm.common import cut, map_arrow, quoted, table

K = 10
SCALE = 1024
EVERY = 100
#: Most bytes of a block of queries (8 for each component), which is what a broadcast holds.
BLOCK_BYTES = 4 << 20
#: Most scores that a task holds at once, and cells of a block's histograms.
SCORES = 1 << 20
CELLS = 1 << 20
#: Below this bound scores are 64-bit integers.
NARROW = 2.0**62
LONG = (-(1 << 63), (1 << 63) - 1)


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as double."""
    v = quoted(vec_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return rows.where(quoted(id_col).isNotNull() & v.isNotNull() & finite).select(quoted(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))


def integers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x): as 64-bit integers, or as Python integers."""
    if not wide:
        return np.floor(x * float(scale)).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale)  # noqa: E731  (beyond 2**53 all are integers)
    return np.array([whole(v) for v in x.ravel().tolist()] or [0], object)[: x.size].reshape(x.shape)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (ids, vectors) of one length each."""
    held: dict[int, list] = {}
    for row in queries.toLocalIterator():
        part = held.setdefault(len(row["v"]), [])
        part.append((row["id"], row["v"]))
        if len(part) * max(1, len(row["v"])) * 8 >= BLOCK_BYTES:
            yield _block(held.pop(len(row["v"])))
    for part in held.values():
        yield _block(part)


def _block(part: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for i, _ in part], np.int64), np.array([v for _, v in part], np.float64).reshape(len(part), -1)


def scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray, scale: int, wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores by query and candidate, whether each is the query's own)."""
    n, dim = vectors.shape
    step = max(1, SCORES // n)
    own_ints = integers(vectors, scale, wide)
    largest = int(np.abs(own_ints).max(initial=0))
    as_float = own_ints.astype(float) if largest < 1 << 53 else None
    for batch in batches:
        lists = batch.column(1)
        whole = lists.value_lengths().to_numpy(zero_copy_only=False) == dim
        own = batch.column(0).to_numpy(zero_copy_only=False)[whole]
        flat = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
        for lo in range(0, len(own), step):
            part, i = integers(flat[lo : lo + step], scale, wide), own[lo : lo + step]
            # Sums below 2**53 are exact in floating point, where the product is fast.
            exact = as_float is not None and largest * int(np.abs(part).max(initial=0)) * max(1, dim) < 1 << 53
            s = (as_float @ part.T.astype(float)).astype(np.int64) if exact else own_ints @ part.T
            yield i, s.astype(object) if wide else s, ids[:, None] == i


def _histograms(candidates: DataFrame, shared, state, bins: int) -> DataFrame:
    """(q, bin, n, need): how many scores lie in each bin that can hold a query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, vectors, scale, wide), (low, width, need, span) = shared.value, state.value
        n = len(ids)
        counts = np.zeros(n * bins, np.int64)
        for _, s, own in scored(batches, ids, vectors, scale, wide):
            s -= low[:, None]
            q, c = np.nonzero((s >= 0) & (s < span[:, None]) & ~own)
            at = (s[q, c] // width[q]).astype(np.int64)
            counts += np.bincount(q * bins + at, minlength=n * bins)
        counts = counts.reshape(n, bins)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, at = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at), pa.array(counts[q, at]), pa.array(need[q])], names=["q", "bin", "n", "need"])

    return map_arrow(candidates, run, "q bigint, bin bigint, n bigint, need bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))


def _at_or_above(candidates: DataFrame, shared, low_shared, k: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, vectors, scale, wide), low = shared.value, low_shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if wide else np.int64)]
        for i, s, own in scored(batches, ids, vectors, scale, wide):
            q, c = np.nonzero((s >= low[:, None]) & ~own)
            held = [np.concatenate(x) for x in zip(held, (q, i[c], s[q, c]), strict=True)]
            falls = -held[2] if not wide else np.unique(-held[2], return_inverse=True)[1]
            order = np.lexsort((held[1], falls, held[0]))
            q = held[0][order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            held = [x[order][place < k] for x in held]
        shown, digits = held[2], pa.nulls(len(held[2]), pa.string())
        if wide:  # decimal digits of one width order what is beyond 64 bits
            shown = [min(max(int(x), LONG[0]), LONG[1]) for x in held[2]]
            digits = pa.array([f"{x + most:0{len(str(2 * most))}d}" for x in held[2].tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(shown, pa.int64()), digits], names=["query_id", "vec_id", "score", "digits"])

    best = Window.partitionBy("query_id").orderBy(F.desc("digits"), F.desc("score"), "vec_id")
    out = map_arrow(candidates, run, "query_id bigint, vec_id bigint, score bigint, digits string")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("digits")


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest integer inner products."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    candidates = valid(rows, id_col, vec_col)
    queries = valid(rows.where(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat, ends = np.abs(v.flatten().to_numpy(zero_copy_only=False)), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
            sums = np.diff(np.concatenate([[0.0], np.concatenate([[0.0], np.cumsum(flat)])[ends]])) if len(ends) else np.zeros(0)
            largest = float(flat.max(initial=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([float(sums.max(initial=0.0))]), pa.array([largest])], names=["sum", "largest"])

    # A score is at most the sum of a candidate's absolute components times a query's largest one.
    most = map_arrow(candidates, norms, "sum double, largest double").agg(F.max("sum"), F.max("largest")).first()
    reach = [int(x or 0) + 1 for x in most]
    parts = []
    for ids, vectors in query_blocks(queries):
        own = [int(x) + 1 for x in np.abs(vectors).max(axis=1, initial=0.0).tolist()]
        dim = max(1, vectors.shape[1])
        limits = [(scale * x + 1) * (scale * reach[0] + dim) for x in own]
        wide = max(limits) >= NARROW or scale * max(*own, reach[1]) >= 1 << 53
        kind = object if wide else np.int64
        bins = max(16, CELLS // len(ids))
        shared = sc.broadcast((ids, vectors, scale, wide))
        bound = np.array(limits, kind)
        low, span, need = -bound, 2 * bound + 1, np.full(len(ids), k, np.int64)
        width = (2 * bound) // bins + 1
        while True:
            state = sc.broadcast((low, width, need, span))
            down = Window.partitionBy("q").orderBy(F.desc("bin"))
            cumulated = _histograms(candidates, shared, state, bins).withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
            before = F.col("upto") - F.col("n")
            # One row for each query of the block.
            found = cumulated.where((F.col("upto") >= F.col("need")) & (before < F.col("need"))).select("q", "bin", before.alias("above")).collect()
            state.destroy()
            have, low, need = np.zeros(len(ids), bool), low.copy(), need.copy()
            for r in found:
                low[r["q"]] += r["bin"] * width[r["q"]]
                need[r["q"]] -= r["above"]
                have[r["q"]] = True
            low[~have] = -bound[~have]  # fewer than k candidates: all of them
            span, width = width, (width - 1) // bins + 1
            if (span[have] == 1).all():
                break
        last = sc.broadcast(low)
        parts.append(cut(_at_or_above(candidates, shared, last, k, max(limits))))
        last.destroy()
        shared.destroy()
    empty = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint, rank int")
    return reduce(DataFrame.unionByName, parts, empty).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

QUERIES = {"op2_exact_top_k": op2_exact_top_k}
ORACLES = {"op2_exact_top_k": ORACLE}
