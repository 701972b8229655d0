"""Lexical retrieval packing: documents into sequences of a fixed window.

A first pass takes each text's ids once: pieces that fill a window are digested at once and only
the rest of the ids, with the counts of the ids before it, goes on (written to the checkpoint
folder, as range partitioning looks at its input twice). Document frequencies and the mean length
are taken over all documents. Rests are ordered by two minimum hashes over their document's ids
(without the end id, which all have), so that documents that share most of their ids tend to stand
together, ranges of that order are dealt out evenly, with the id as last key, so that a group of
copies of any size is split, and each range is cut into shards of a fixed number of documents. A
shard has a BM25 inverted index of its documents, so retrieval is local: a neighbour in another
shard is not found (the README says how many are). Each seed (the first unused rest) asks it for unused neighbours, best first: those
that fit fill the window, and the best that doesn't is cut where the window ends. Only the last
window of a shard can stay short.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are documents
of their own; an empty table gives no pieces; other columns are ignored; ties in score go to the
rest that comes first in the order.
"""

from __future__ import annotations

import zlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradewise.llm.bpe import Vocabulary, merge
from gradewise.llm.common import cut, map_arrow, map_texts, quoted, table

WINDOW = 1024
#: Documents in a shard, which is the reach of retrieval and bounds a task's memory.
SHARD = 512
K1, B = 1.2, 0.75
END = 0
#: Longer runs of white space overflow the stack of tiktoken's pattern matcher.
LONG_RUN = re.compile(r"\s{1000}")
#: Odd multipliers of the two minimum hashes.
MIX = (0x9E3779B1, 0x85EBCA6B)
#: Minimum hash of a document without ids (the end id has none).
NO_HASH = np.uint32(0xFFFFFFFF)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def id_type(v: Vocabulary) -> str:
    """The narrowest type of a vocabulary's ids."""
    return "<u2" if v.base <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Callable[[str], np.ndarray], str]:
    """The worker process's function from a text to the ids that tokenizers gives for a
    byte-level BPE file, and the narrowest type of these.

    Where ids stand in the order of the merges and each token's bytes merge to that token, no two
    symbols that can stand side by side make a token by another pair than the file's: then tiktoken
    gives the same ids in a fraction of the time. tokenizers itself does what is left. Neither
    keeps many words, so a worker's memory doesn't grow with the texts.
    """
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def slow(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    v = Vocabulary(path)
    kind = id_type(v)
    tokens = {b: i for i, b in enumerate(v.bytes) if b and i not in v.special.values()}
    if not (np.diff(v.made) > 0).all() or any(m != np.uint32(i).tobytes() for i, m in zip(tokens.values(), merge(v, list(tokens)), strict=True)):
        return slow, kind
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens=v.special)

    def encode(text: str) -> np.ndarray:
        return slow(text) if LONG_RUN.search(text) else fast.encode_to_numpy(text, allowed_special="all")

    return encode, kind


def _tokenized(docs: DataFrame, path: str, window: int, text: str, keep: list[str]) -> DataFrame:
    def make() -> Callable:
        encode, kind = encoder(path)
        end = np.uint32(END).tobytes()

        def apply(texts: list[bytes]) -> list:
            raws = [encode(x.decode()).astype("<u4").tobytes() + end for x in texts]
            ids = np.frombuffer(b"".join(raws), "<u4")
            sizes = [len(x) // 4 for x in raws]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mixed = ids >> np.uint32(7)
            low = [np.minimum.reduceat(np.where(ids == END, NO_HASH, (ids * np.uint32(m)) ^ mixed), starts).tolist() for m in MIX]
            short = ids.astype(kind)
            crcs, rests, heads, counts = [], [], [], []
            for raw, start, n in zip(raws, starts.tolist(), sizes, strict=True):
                whole = n // window * window
                crcs.append([zlib.crc32(raw[4 * i : 4 * (i + window)]) for i in range(0, whole, window)])
                rests.append(short[start + whole : start + n].tobytes())
                if whole:
                    head, k = np.unique(short[start : start + whole], return_counts=True)
                    heads.append(head.tobytes())
                    counts.append(k.astype("<u4").tobytes())
                else:
                    heads.append(b"")
                    counts.append(b"")
            return [sizes, crcs, rests, heads, counts, *low]

        return apply

    return map_texts(docs, make, "doc_tokens bigint, head_crcs array<bigint>, rest binary, head binary, head_counts binary, low1 bigint, low2 bigint", keep, text)


def id_counts(rest: np.ndarray, head: bytes, head_counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document and how often each stands in it."""
    t, tf = np.unique(rest, return_counts=True)
    if head:
        t, c = np.unique(np.concatenate([t, np.frombuffer(head, rest.dtype)]), return_inverse=True)
        tf = np.bincount(c, np.concatenate([tf, np.frombuffer(head_counts, "<u4")]))
    return t, tf


#: Documents, their mean length, their distinct ids in order, and in how many documents each stands.
Statistics = tuple[int, float, np.ndarray, np.ndarray]


def statistics(tokens: DataFrame, kind: str) -> Statistics:
    """Of all documents; one row for each id is collected, so no more than the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for rest, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.unique(np.concatenate([np.frombuffer(rest, kind), np.frombuffer(head, kind)]))
                if len(t) and t[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(t[-1]) + 1 - len(df), np.int64)])
                df[t] += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(df[found])], names=["term", "df"])

    rows = map_arrow(tokens.select("rest", "head"), run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    n, mean = tokens.agg(F.count("*"), F.avg("doc_tokens")).first()
    found = np.array(sorted((r["term"], r["df"]) for r in rows), np.int64).reshape(-1, 2)
    return n, mean or 1.0, found[:, 0], found[:, 1]


class Shard:
    """A BM25 inverted index over the ids of some documents, weighted by the statistics of all."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], of_all: Statistics):
        n = len(terms)
        sizes = np.fromiter(map(len, terms), np.int64, n)
        doc, term, tf = np.repeat(np.arange(n), sizes), np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64)
        length = np.bincount(doc, tf, n)
        order = np.argsort(term, kind="stable")
        doc = doc[order]
        vocabulary, first, df = np.unique(term[order], return_index=True, return_counts=True)
        n_all, mean, known, df_all = of_all
        spread = df_all[np.searchsorted(known, vocabulary)]
        idf = np.log1p((n_all - spread + 0.5) / (spread + 0.5))
        tf = tf[order]
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / max(mean, 1))[doc]))
        # A term of one document leads to no neighbour. Terms of many documents are columns of a
        # dense matrix, whose sums are one product; the others have postings.
        often, shared = df > n // 8, (df > 1) & (df <= n // 8)
        column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((n, int(often.sum())))
        where, at = np.repeat(column, df), np.repeat(often, df)
        self.dense[doc[at], where[at]] = weight[at]
        ends = list(zip(first[shared].tolist(), (first + df)[shared].tolist(), strict=True))
        self.docs, self.weights = [doc[a:b] for a, b in ends], [weight[a:b] for a, b in ends]
        self.n = n
        number = np.where(shared, np.cumsum(shared) - 1, -1)
        found = [np.searchsorted(vocabulary, t) for t in terms]
        self.columns = [c[c >= 0] for c in (column[x] for x in found)]
        self.terms = [x[x >= 0].tolist() for x in (number[x] for x in found)]

    def scores(self, seed: int) -> np.ndarray:
        """Each document's score for the terms of ``seed``."""
        asked = np.zeros(self.dense.shape[1])
        asked[self.columns[seed]] = 1
        out, terms = self.dense @ asked, self.terms[seed]
        if terms:
            out += np.bincount(np.concatenate([self.docs[t] for t in terms]), np.concatenate([self.weights[t] for t in terms]), self.n)
        return out


def fill_windows(rests: list[int], index: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start in its rest, length); every id of every rest lies in one."""
    begin, left = np.zeros(len(rests), np.int64), np.array(rests, np.int64)
    out = []
    for seed in range(len(rests)):
        while left[seed] > 0:
            pieces, room = [], window

            def take(d: int, n: int) -> None:
                nonlocal room
                pieces.append((d, int(begin[d]), n))
                begin[d] += n
                left[d] -= n
                room -= n

            take(seed, int(min(left[seed], room)))
            if room:
                unused = np.flatnonzero(left > 0)
                ranked = unused[np.argsort(-index.scores(seed)[unused], kind="stable")] if len(unused) else unused
                for d in ranked.tolist():
                    if left[d] <= room:
                        take(d, int(left[d]))
                        if not room:
                            break
                if room:
                    for d in ranked.tolist():
                        if left[d] > 0:
                            take(d, int(min(left[d], room)))
                            if not room:
                                break
            out.append(pieces)
    return out


OUT = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = cut(_tokenized(docs, path, window, text, [id_col]))
    kind = id_type(Vocabulary(path))
    of_all = statistics(tokens, kind)
    dealt = tokens.repartitionByRange("low1", "low2", quoted(id_col)).sortWithinPartitions("low1", "low2", quoted(id_col))
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(OUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            ids, total, heads, rests, head, head_counts = (rows.column(i).to_pylist() if i else rows.column(0).combine_chunks() for i in range(6))
            out: list[tuple] = []
            for d, crcs in enumerate(heads):
                for i, x in enumerate(crcs):
                    out.append((d, i * window, window, x, total[d], number, 0))
                    number += 1
            own = [np.frombuffer(x, kind) for x in rests]
            members = [d for d, x in enumerate(own) if len(x)]
            if members:
                terms, counts = [], []
                for d in members:
                    t, tf = id_counts(own[d], head[d], head_counts[d])
                    terms.append(t), counts.append(tf)
                for pieces in fill_windows([len(own[d]) for d in members], Shard(terms, counts, of_all), window):
                    at = 0
                    for m, start, n in pieces:
                        d = members[m]
                        out.append((d, len(heads[d]) * window + start, n, crc(own[d][start : start + n]), total[d], number, at))
                        at += n
                    number += 1
            columns = list(zip(*out, strict=True))
            made = [pa.array(x, pa.int64()) for x in columns[1:]]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *made], names=schema.names)

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            whole = rows.num_rows // shard * shard
            for lo in range(0, whole, shard):
                yield packed(rows.slice(lo, shard))
            held = rows.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))

    return map_arrow(dealt.select(quoted(id_col), "doc_tokens", "head_crcs", "rest", "head", "head_counts"), run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_packing": op9_packing}
