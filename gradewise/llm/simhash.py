"""SimHash near-duplicates with pigeonring filtering.

Distinct fingerprints are compared, never documents. A fingerprint's 64 bits form a ring of three
consecutive segments (22, 21 and 21 bits), and at most two bits may differ. By the strong form of
the pigeonhole principle on a ring, a linked pair has a segment from which every chain of l
segments differs in at most l * 2 / 3 bits: none in the first, one in the first two, two in all
three. The first two conditions make the key: each fingerprint stands under its first two segments
of each of the three chains as they are, and asks under those with one set bit of the second
segment cleared (of two that differ in one bit, one has it set). So only pairs that keep to the
budgets meet under a key. What is left is the full Hamming check on the members of a key, who can
differ in the third segment only: few are compared pair by pair, many by their one-bit neighbours
in that segment, which is exact too and takes time in proportion to their number. Links come out
as chains to one member of each linked set, not as all pairs.

Components are found on the links between distinct fingerprints by alternating large and small
stars, with a checkpoint each round. Only fingerprints and ids are shuffled, no texts. Documents
of one fingerprint, however many, are one node, made with partial aggregation.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other;
repeated rows each give a row; a null id gives a row and stands after all others as a component's
name; an empty table gives an empty result; other columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.llm.common import FEWEST, PART_ROWS, carried, cut, map_arrow, map_texts, quoted, table, unpacked

WORDS = 3
SEED = 42
DISTANCE = 2
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Up to so many members of a key are compared pair by pair.
PAIRWISE = 48
#: Most ids of dropped documents that are broadcast.
BROADCAST_IDS = 1_000_000
#: Edges that a task makes stars of at once.
EDGES = 1_000_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text's word shingles, as an unsigned integer."""
    w = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)) & 0xFFFFFFFFFFFFFFFF


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, words: int = WORDS, name: str = "fp", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint as a (signed) bigint."""

    def make() -> Callable:
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return map_texts(docs, make, f"`{name}` bigint", keep, text)


def _segments() -> list[tuple[int, int]]:
    at = np.concatenate([[0], np.cumsum(SEGMENTS)])
    return [(int(a), int(n)) for a, n in zip(at, SEGMENTS, strict=False)]


def chain_keys(fps: DataFrame) -> DataFrame:
    """(chain, key, fp, asks): each fingerprint under the keys of its three chains. ``asks`` is
    true where a bit of the second segment was cleared, which uses one of the two differences."""
    parts = _segments()
    rows = []
    for i in range(3):
        (a, n), (b, m) = parts[i], parts[(i + 1) % 3]
        own = F.shiftrightunsigned("fp", a).bitwiseAND((1 << n) - 1)
        after = F.shiftrightunsigned("fp", b).bitwiseAND((1 << m) - 1)
        key = F.shiftleft(own, m).bitwiseOR(after)
        cleared = [F.when(key.bitwiseAND(1 << j) != 0, key - F.lit(1 << j)) for j in range(m)]
        rows.append(F.struct(F.lit(i).alias("chain"), F.array(key).alias("as_is"), F.array_compact(F.array(*cleared)).alias("cleared")))
    each = fps.select("fp", F.explode(F.array(*rows)).alias("r"))
    keys = F.concat(F.transform("r.as_is", lambda k: F.struct(k.alias("key"), F.lit(False).alias("asks"))), F.transform("r.cleared", lambda k: F.struct(k.alias("key"), F.lit(True).alias("asks"))))
    return each.select("fp", F.col("r.chain").alias("chain"), F.explode(keys).alias("k")).select("chain", "k.key", "fp", "k.asks")


def _linked(chain: int, fp: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links among the members of one key: enough to join all that are linked under it."""
    start, width = _segments()[(chain + 2) % 3]
    third = (fp.view(np.uint64) >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
    own, other = np.flatnonzero(~asks), np.flatnonzero(asks)
    if not len(own):
        return
    if len(fp) <= PAIRWISE:
        for i in own.tolist():
            differ = np.bitwise_count(fp[i] ^ fp)
            for j in np.flatnonzero(differ <= DISTANCE).tolist():
                if j != i and (asks[j] or j > i):
                    yield int(fp[i]), int(fp[j])
        return
    # Members that differ in one bit, or that share a one-bit neighbour, are at most two bits apart.
    flips = np.concatenate([[0], 1 << np.arange(width)])
    near = (third[own][:, None] ^ flips).ravel()
    whose = np.repeat(fp[own], len(flips))
    order = np.argsort(near, kind="stable")
    near, whose = near[order], whose[order]
    same = np.flatnonzero(near[1:] == near[:-1])
    yield from zip(whose[same].tolist(), whose[same + 1].tolist(), strict=True)
    # One that asks has one difference left: it equals a member's third segment or a neighbour of it.
    if len(other):
        at = np.minimum(np.searchsorted(near, third[other]), len(near) - 1)
        hit = near[at] == third[other]
        yield from zip(fp[other][hit].tolist(), whose[at[hit]].tolist(), strict=True)


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints at most two bits apart: not all such pairs, but enough
    to connect what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            chain, key, fp, asks = columns
            ends = np.flatnonzero((chain[1:] != chain[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], ends]), np.concatenate([ends, [len(key)]])
            several = (ends - starts > 1) & (np.add.reduceat(asks.astype(np.int64), starts) < ends - starts)
            pairs = [p for lo, hi in zip(starts[several].tolist(), ends[several].tolist(), strict=True) for p in _linked(int(chain[lo]), fp[lo:hi], asks[lo:hi])]
            pairs = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            chain, key = held[:2]
            last = int(np.flatnonzero((chain != chain[-1]) | (key != key[-1]))[-1]) + 1 if (chain[0] != chain[-1] or key[0] != key[-1]) else 0
            if last:  # the last key may go on in the next batch
                yield found([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held:
            yield found(held)

    dealt = chain_keys(fps).repartition("chain", "key").sortWithinPartitions("chain", "key")
    return map_arrow(dealt, run, "a bigint, b bigint").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, in bounded parts, as stars: each node of a part's component with the smallest one."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        ends = np.concatenate([np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in held], axis=1)
        nodes, at = np.unique(ends, return_inverse=True)
        (u, v), label, before = at.reshape(2, -1), np.arange(len(nodes)), None
        while before is None or (label != before).any():
            before = label.copy()
            least = np.minimum(label[u], label[v])
            np.minimum.at(label, u, least)
            np.minimum.at(label, v, least)
            label = label[label]
        some = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= EDGES:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component.

    Each round first makes stars of the edges of each task. Then come large stars and small stars: each
    node links its larger (then its smaller) neighbours to the smallest one. Rounds go on until nothing
    changes, which a number in the order of the square of the logarithm of the nodes brings about. Edges
    never grow in number. A node with very many neighbours is one key of the join on ``u``, whose
    other side has one row for it, so that adaptive execution splits it.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n, before = now.count(), None
    seen = n
    while seen and seen != before:
        now = cut(map_arrow(now.coalesce(max(FEWEST, n // PART_ROWS)), _forest, "u bigint, v bigint").distinct(), n)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, 2 * n)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        now, before = cut(star, 2 * n), seen
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(rows: DataFrame, id_col: str = "doc_id", name: str = "fp", edges: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``rows``: root names its component,
    component_id is the smallest id of a row whose fingerprint can be reached over links (``edges``,
    if given)."""
    least = cut(rows.groupBy(quoted(name).alias("fp")).agg(F.min(quoted(id_col)).alias("least")))
    found = components(links(least.select("fp")) if edges is None else edges)
    roots = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # A root is a fingerprint: its component's id is the smallest of its members' ids.
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(roots.join(named, "root").select("fp", "root", "component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id (null ids
    come after all others; of rows that share id and fingerprint, any one)."""
    rows = cut(with_fingerprint(docs.select(quoted(id_col).alias("id"), quoted(text).alias("text")), words, keep=["id"]))
    return one_of_each(docs, rows, lambda d: with_fingerprint(d, words, text="body", keep=["row", "id"]), None, id_col, text)


def one_of_each(docs: DataFrame, rows: DataFrame, mark: Callable[[DataFrame], DataFrame], edges: DataFrame | None, id_col: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, by the id and fp of ``rows`` and the links between fps. Only
    the ids that go are sent to the documents, broadcast where they are few; where ids are repeated,
    ``mark`` adds fp to (row, id, body) to tell rows apart."""
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id")).alias("r"))
    chosen = least.join(near_duplicates(rows, "id", edges=edges), "fp").groupBy("root").agg(F.min(F.struct("r", "fp")).alias("c"))
    chosen = cut(chosen.select(F.col("c.fp").alias("fp"), F.col("c.r.id").alias("id")))
    carry = carried(docs, quoted(id_col).alias("id"), quoted(text).alias("body"))
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept, gone = chosen.select(F.col("id").alias("other")), rows.select("id")
        gone = cut(gone.join(kept, F.col("id").eqNullSafe(F.col("other")), "left_anti").select(F.col("id").alias("other")))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        left = carry.select("row", "id").join(gone, F.col("id").eqNullSafe(F.col("other")), "left_anti")
        return left.select(*unpacked(left, docs.columns))
    # Rows that share an id are told apart by fingerprint, and of those that share both one stays.
    marked = mark(carry)
    same = F.col("id").eqNullSafe(F.col("other")) & (F.col("fp") == F.col("of"))
    kept = marked.join(chosen.select(F.col("id").alias("other"), F.col("fp").alias("of")), same, "left_semi")
    repeated = F.broadcast(cut(rows.groupBy("id", "fp").agg(F.count("*").alias("n")).where("n > 1").join(chosen, ["fp"], "left_semi").select(F.col("id").alias("other"), F.col("fp").alias("of"))))
    once = kept.join(repeated, same, "left_anti")
    out = once.unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["id", "fp"]))
    return out.select(*unpacked(out, docs.columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut(with_fingerprint(docs, keep=["doc_id"]))
    found = near_duplicates(rows)
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
