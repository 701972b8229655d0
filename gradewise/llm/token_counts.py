"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch of texts are held as one flat array of symbols with row starts (a ragged
array). In each round every row that still has a mergeable pair applies its lowest-rank pair, all
rows at once; what survives is counted, without making tokens. A rank whose product is in no piece
of a better rank is applied at all its places in a row at once, which gives what one place at a
time would; else only at the leftmost place.

A pre-token is a run of spaces with what follows it, cut further between any two characters that
stand together in no piece: no merge reaches over such a place, so the counts are those of the
whole text. The job is one narrow pass, without a shuffle; a task's memory is bounded by its slice
of text and by the cache limit.

Defined results: a null or empty text has no bytes and no tokens; repeated rows each give a row;
null ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from gradewise.llm.common import map_texts, table

#: Most entries that a worker's cache of pre-tokens holds before half of it is emptied.
CACHE = 200_000
#: Entries that it holds between tasks, as idle workers keep their memory.
IDLE = 50_000
#: The mark that stands for a space in pieces.
MARK = "▁"
LIMIT = 4096
POINTS = 0x110000


class Pieces:
    """The merge table of a sentencepiece model of the BPE kind with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)):
                score[model.id_to_piece(i)] = model.get_score(i)
        if any(a != MARK and b == MARK for p in score for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece spans a space: texts can't be cut at spaces")
        symbols = list(score) + sorted({c for p in score for c in p} - score.keys())
        of = {s: i for i, s in enumerate(symbols)}
        self.base = len(symbols)
        levels = sorted(set(score.values()), reverse=True)
        level = {s: i for i, s in enumerate(levels)}
        rank = {p: level[x] for p, x in score.items()}
        left, right, ranks, made = [], [], [], []
        best: dict[str, int] = {}  # for each symbol, the best rank of a piece that has it as a part
        for p in score:
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if a in of and b in of:
                    left.append(of[a]), right.append(of[b]), ranks.append(rank[p]), made.append(of[p])
                    for x in (a, b):
                        best[x] = min(best.get(x, rank[p]), rank[p])
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], np.array(ranks, np.int64)[order], np.array(made, np.int64)[order]
        several = np.bincount([rank[p] for p in score], minlength=len(levels)) > 1
        #: By rank: whether all places of a row may be merged at once.
        self.at_once = ~several
        for p in score:
            if best.get(p, len(levels)) <= rank[p]:
                self.at_once[rank[p]] = False
        self.symbol = np.full(POINTS, -1, np.int64)
        for s in symbols:
            if len(s) == 1:
                self.symbol[ord(s)] = of[s]
        #: Tokens that a surviving symbol counts for: its bytes, if it is a character without a piece.
        self.tokens = np.array([1 if s in score else len(s.encode()) for s in symbols], np.int64)
        together = {ord(a) * POINTS + ord(b) for p in score for a, b in zip(p, p[1:], strict=False)}
        self.together = np.array(sorted(together), np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the table has each pair, else -1."""
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), at, -1)


def count_pieces(pieces: Pieces, words: list[str]) -> list[int]:
    """The number of tokens of each non-empty pre-token."""
    if not words:
        return []
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    sym = pieces.symbol[points]
    # Characters in no piece are done: each counts for its bytes.
    n_bytes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    counts = np.bincount(word, np.where(sym < 0, n_bytes, 0), len(words)).astype(np.int64)
    key = points[:-1] * POINTS + points[1:]
    at = np.minimum(np.searchsorted(pieces.together, key), len(pieces.together) - 1)
    joined = (pieces.together[at] == key) & (word[1:] == word[:-1])
    row = np.concatenate([[0], np.cumsum(~joined)])
    known = sym >= 0
    sym, row, word = sym[known], row[known], word[known]
    while sym.size:
        found = np.full(sym.size, -1, np.int64)
        found[:-1] = np.where(row[1:] == row[:-1], pieces.pair(sym[:-1], sym[1:]), -1)
        rank = np.where(found >= 0, pieces.ranks[found], np.iinfo(np.int64).max)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(starts, sym.size))
        least = np.minimum.reduceat(rank, starts)
        live = least < np.iinfo(np.int64).max
        done = np.repeat(~live, size)
        if done.any():  # what survives in rows without a pair is counted, and the rows go
            counts += np.bincount(word[done], pieces.tokens[sym[done]], len(words)).astype(np.int64)
            keep = ~done
            sym, row, word, found, rank = sym[keep], row[keep], word[keep], found[keep], rank[keep]
            least, size = least[live], size[live]
            if not sym.size:
                break
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        hit = rank == np.repeat(least, size)
        place = np.arange(sym.size)
        at_once = np.repeat(pieces.at_once[least], size)
        # The leftmost place of each row, and every second one of adjoining places.
        leftmost = np.minimum.reduceat(np.where(hit, place, sym.size), starts)
        run = np.maximum.accumulate(np.where(hit, -1, place))
        hit &= np.where(at_once, (place - run) % 2 == 1, place == np.repeat(leftmost, size))
        sym = np.where(hit, pieces.made[found], sym)
        keep = np.concatenate([[True], ~hit[:-1]])
        sym, row, word = sym[keep], row[keep], word[keep]
    return counts.tolist()


class Counter:
    """Counts tokens of whole texts, with a bounded cache of pre-tokens."""

    def __init__(self, path: str, cache: int = CACHE):
        self.pieces, self.cache = Pieces(path), cache
        self.find = re.compile(" *[^ ]+| +").findall
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    def _learn(self, bare: set[str], spaced: set[str]) -> None:
        bare -= self.bare.keys()
        spaced -= self.spaced.keys()
        found = count_pieces(self.pieces, [w.replace(" ", MARK) for w in bare] + [MARK + w for w in spaced])
        self.bare.update(zip(bare, found, strict=False))
        self.spaced.update(zip(spaced, found[len(bare) :], strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        work, bare, spaced = [], set(), set()
        for raw in texts:
            text = raw.decode().replace(MARK, " ")
            if not text:
                chunks = [], []
            elif "  " in text or text[0] == " ":
                chunks = self.find(" " + text), []
            else:
                chunks = [], text.split(" ")
            bare.update(chunks[0])
            spaced.update(chunks[1])
            work.append(chunks)
        self._learn(bare, spaced)
        out = [sum(map(self.bare.__getitem__, a)) + sum(map(self.spaced.__getitem__, b)) for a, b in work]
        if len(self.bare) + len(self.spaced) > self.cache:
            self.trim(self.cache // 4)
        return out

    def trim(self, most: int) -> None:
        """Leaves the entries that came first in each cache, which tend to be frequent."""
        self.bare, self.spaced = dict(islice(self.bare.items(), most)), dict(islice(self.spaced.items(), most))


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` of each whole text under the model."""

    def make() -> Callable:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]

        def apply(texts: list[bytes]) -> list:
            n = counter.count(texts)
            return [list(map(len, texts)), n, [x > limit for x in n]]

        apply.close = lambda: counter.trim(IDLE // 2)
        return apply

    return map_texts(docs, make, "n_bytes bigint, n_tokens bigint, over_limit boolean", keep, text)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


QUERIES = {"op3_token_counts": op3_token_counts}
