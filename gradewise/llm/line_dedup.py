"""Removal of lines that many documents have, by a sharded minimal perfect hash.

A first pass takes a 128-bit hash of each document's distinct line keys; Spark counts them (with
partial sums before the shuffle). The hashes found in enough documents are dealt into shards by
hash, and each shard becomes a minimal perfect hash with two arrays in its order: the other 64
bits of each hash as fingerprint, and its count. Documents then probe the arrays; lines are never
joined with lines.

The shards together are broadcast only if they have at most ``BROADCAST_BYTES``. Beyond that, slices
of documents send the distinct hashes of their lines to the shards (a hot line once for each slice);
a task reads each of its shards once and streams the questions past it; and the hashes to drop go back
to the slice by its partition and number, where they are zipped with the documents. Only hashes are
shuffled, never texts.

Defined results: a null or empty text has one line, which is empty and stays; a key that is shorter
than ``min_chars`` never drops; repeated rows count as documents; null ids pass through; a text that
loses every line becomes empty; an empty table gives an empty result; other columns pass through, or
give way to a new column of the same name in any case.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.common import cut, map_arrow, map_texts, others, quoted, slices, table, text_bytes

MIN_CHARS, MIN_DOCS = 1, 10
BLANK = b" \t\n\x0b\x0c\r"
#: Hashes that a shard has on average.
SHARD_KEYS = 50_000
#: Most bytes of shards that are broadcast.
BROADCAST_BYTES = 32 << 20
LEVELS = 24
DIGESTS = np.dtype([("place", "<u8"), ("check", "<u8")])


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def digests(lines: list[bytes], min_chars: int) -> np.ndarray:
    """The 128-bit hash of each line's key; zero for a key that is too short to drop."""
    zero, hash128 = bytes(16), xxhash.xxh3_128_digest
    if min_chars <= 1:
        keys = [hash128(k) if (k := line.strip(BLANK)) and (k := k.lower()) else zero for line in lines]
    else:
        keys = [hash128(k) if len((k := line_key(line)).decode()) >= min_chars else zero for line in lines]
    return np.frombuffer(b"".join(keys), DIGESTS)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of the keys that differs by level."""
    x = keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys.

    Each level is a bit array; a key has its place in the first level where no other key that came
    so far meets it, and its number is the number of set bits before that place. Keys left after
    the last level stand in a sorted list.
    """

    def __init__(self, keys: np.ndarray):
        self.sizes, words, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            at = mixed(left, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at.astype(np.int64)]]
        self.words = np.concatenate(words) if words else np.zeros(0, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.rest = np.sort(left)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key of the set; any number or -1 for other keys."""
        out, wanted, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[wanted], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[wanted[hit]] = (self.before[at >> 6] + below)[hit]
            wanted, start = wanted[~hit], start + size
        if len(self.rest) and len(wanted):
            at = np.minimum(np.searchsorted(self.rest, keys[wanted]), len(self.rest) - 1)
            hit = self.rest[at] == keys[wanted]
            out[wanted[hit]] = self.before[-1] + at[hit]
        return out


class Index:
    """The arrays of one shard."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        # Two hashes may share their first half (rarely): such keys go to a list of their own.
        place, first, n = np.unique(keys["place"], return_index=True, return_counts=True)
        self.function = PerfectHash(place)
        self.check, self.count = np.zeros(len(place), "<u8"), np.zeros(len(place), "<i8")
        at = self.function(place)
        self.check[at], self.count[at] = keys["check"][first], counts[first]
        again = np.setdiff1d(np.arange(len(keys)), first)
        self.more = {keys[i].tobytes(): int(counts[i]) for i in again.tolist()}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The number of documents of each key that the shard has, else 0."""
        if not len(self.check):
            return np.zeros(len(keys), np.int64)
        at = self.function(keys["place"])
        found = np.where((at >= 0) & (self.check[at] == keys["check"]), self.count[at], 0)
        if self.more:
            for i in np.flatnonzero(found == 0).tolist():
                found[i] = self.more.get(keys[i].tobytes(), 0)
        return found


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys["check"], LEVELS) % np.uint64(shards)).astype(np.int64)


def line_counts(docs: DataFrame, min_chars: int, text: str) -> DataFrame:
    """(place, check, n_docs) of each distinct line key."""

    def make() -> Callable:
        def apply(texts: list[bytes]) -> list:
            return [[np.unique(digests(t.split(b"\n"), min_chars)).tobytes() for t in texts]]

        return apply

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), DIGESTS), return_counts=True)
            some = (keys["place"] != 0) | (keys["check"] != 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys["place"][some].view("<i8")), pa.array(keys["check"][some].view("<i8")), pa.array(n[some])], names=["place", "check", "n"])

    each = map_texts(docs, make, "line_hashes binary", [], text)
    return map_arrow(each, summed, "place bigint, check bigint, n bigint").groupBy("place", "check").agg(F.sum("n").alias("n_docs"))


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text") -> tuple[DataFrame, int]:
    """(shard, arrays) of the lines that at least ``min_docs`` documents have, and the number of shards."""
    frequent = cut(line_counts(docs, min_chars, text).where(F.col("n_docs") >= min_docs))
    shards = max(1, -(-frequent.count() // SHARD_KEYS))

    def with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.zeros(b.num_rows, DIGESTS)
            keys["place"], keys["check"] = (b.column(i).to_numpy(zero_copy_only=False).view("<u8") for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards)), *b.columns], names=["shard", "place", "check", "n_docs"])

    def built(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("check", "ascending")])
        keys = np.zeros(t.num_rows, DIGESTS)
        keys["place"], keys["check"] = (t[c].to_numpy().view("<u8") for c in ("place", "check"))
        return pa.table({"shard": t["shard"].slice(0, 1), "arrays": pa.array([pickle.dumps(Index(keys, t["n_docs"].to_numpy()))], pa.binary())})

    dealt = map_arrow(frequent, with_shard, "shard bigint, place bigint, check bigint, n_docs bigint")
    return cut(dealt.groupBy("shard").applyInArrow(built, "shard bigint, arrays binary")), shards


def kept_text(raw: bytes, drop: np.ndarray) -> bytes:
    return b"\n".join(line for line, gone in zip(raw.split(b"\n"), drop.tolist(), strict=True) if not gone)


def dedup_lines(
    docs: DataFrame, result: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept``: with result "text" the text that is left, with
    "sha256" its digest as lowercase hex."""
    index, shards = build_index(docs, min_chars, min_docs, text)
    size = index.agg(F.sum(F.length("arrays"))).first()[0] or 0
    new = "n_lines bigint, n_dropped bigint, kept string"

    def outcome(texts: list[bytes], drops: list[np.ndarray]) -> list:
        kept = [raw if not drop.any() else kept_text(raw, drop) for raw, drop in zip(texts, drops, strict=True)]
        shown = [hashlib.sha256(k).hexdigest() for k in kept] if result == "sha256" else [k.decode() for k in kept]
        return [list(map(len, drops)), [int(d.sum()) for d in drops], shown]

    if size <= broadcast_bytes:
        arrays = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["arrays"] for r in index.collect()})

        def make() -> Callable:
            tables = {s: pickle.loads(x) for s, x in arrays.value.items()}

            def apply(texts: list[bytes]) -> list:
                lines = [t.split(b"\n") for t in texts]
                keys = digests([x for t in lines for x in t], min_chars)
                drop, shard = np.zeros(len(keys), bool), shard_of(keys, shards)
                for s, t in tables.items():
                    own = np.flatnonzero(shard == s)
                    drop[own] = t.counts(keys[own]) >= min_docs
                drop &= (keys["place"] != 0) | (keys["check"] != 0)
                return outcome(texts, np.split(drop, np.cumsum(list(map(len, lines)))[:-1]))

            return apply

        return map_texts(docs, make, new, keep, text)

    kept = others(docs.columns if keep is None else keep, ("n_lines", "n_dropped", "kept"))
    source = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], text_bytes(text).alias("raw"))
    return _asked_by_slice(source, index, shards, min_chars, min_docs, outcome, T.StructType([docs.schema[c] for c in kept] + T.StructType.fromDDL(new).fields))


def _asked_by_slice(source: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int, outcome: Callable, schema: T.StructType) -> DataFrame:
    """``outcome`` of the rows of ``source``, whose last column is the text, with an index of any size."""
    spark = source.sparkSession

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False)):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)]).combine_chunks().to_batches()[0]
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["slice"])

    def rows_of(blob: bytes) -> pa.RecordBatch:
        return next(iter(pa.ipc.open_stream(blob)))

    # One RDD gives the questions and is zipped with the answers: partitions and slices are the same.
    blobs = map_arrow(source, packed, "slice binary").rdd.map(lambda r: bytes(r[0]))

    def ask(part: int, parts: Iterator[bytes]) -> Iterator[tuple]:
        for number, blob in enumerate(parts):
            texts = rows_of(blob).columns[-1].to_pylist()
            keys = np.unique(digests([x for t in texts for x in t.split(b"\n")], min_chars))
            shard = shard_of(keys, shards)
            yield part, number, -1, b""  # so that each slice has an answer
            for s in np.unique(shard).tolist():
                yield part, number, s, keys[shard == s].tobytes()

    asked = spark.createDataFrame(blobs.mapPartitionsWithIndex(ask), "part bigint, number bigint, shard bigint, data binary", verifySchema=False)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for part, number, shard, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    held = pickle.loads(data)
                elif shard < 0:
                    out.append((part, number, b""))
                elif held is not None:
                    keys = np.frombuffer(data, DIGESTS)
                    hit = (held.counts(keys) >= min_docs) & ((keys["place"] != 0) | (keys["check"] != 0))
                    out.append((part, number, keys[hit].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "number", "drops"])

    # A shard's arrays come first in its partition, as their part is -1.
    arrays = index.select(F.lit(-1).cast("bigint").alias("part"), F.lit(-1).cast("bigint").alias("number"), "shard", F.col("arrays").alias("data"))
    dealt = arrays.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "part", "number")
    answers = map_arrow(dealt.select("part", "number", "shard", "data"), probed, "part bigint, number bigint, drops binary").rdd
    back = answers.map(lambda r: ((r[0], r[1]), bytes(r[2]))).repartitionAndSortWithinPartitions(max(1, blobs.getNumPartitions()), lambda k: k[0])
    each = back.mapPartitions(lambda rows: ((k, b"".join(x for _, x in group)) for k, group in groupby(rows, lambda r: r[0])))

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, drops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, wanted = rows_of(blob), np.frombuffer(drops, DIGESTS)
                texts = rows.columns[-1].to_pylist()
                made = outcome(texts, [np.isin(digests(t.split(b"\n"), min_chars), wanted) for t in texts])
                kinds = [pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *[pa.array(x, k) for x, k in zip(made, kinds, strict=True)]], names=schema.names)

    both = spark.createDataFrame(blobs.zip(each).map(lambda x: (x[0], x[1][1])), "slice binary, drops binary", verifySchema=False)
    return both.mapInArrow(rewritten, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "sha256", keep=["doc_id"])
    return out.withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS key FROM (
    SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key
GROUP BY doc_id
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": ORACLE}
