"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token has a segment tree whose leaf i holds (rank of the pair that starts at symbol i,
i). The root is therefore the leftmost lowest-rank merge. A merge changes three leaves (its own,
its left neighbour's, and that of the symbol it swallowed), each updated in a logarithmic number
of steps, until the root says that no mergeable pair is left. The trees of many pre-tokens of like
size are rows of one array, so that a step of all of them is a few array operations. In a pre-token of
more than ``LONG`` symbols all places of the root's rank are merged at once, from the left, where no
pair with its product has a lower rank (else the leftmost alone), which gives what one place at a
time would: a text of one long word takes as many steps as ranks occur in it.

Texts are independent: the job is one narrow pass over the documents, without a shuffle, and a
task's memory is bounded by its slice of text and by the cache limit.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows each
give a row; null ids pass through; special strings in a text become their special id, which is the
library's default; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from itertools import islice

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from gradewise.llm.common import map_texts, table

#: Most entries that a worker's cache of words holds before half of it is emptied.
CACHE = 150_000
#: Entries that it holds between tasks, as idle workers keep their memory.
IDLE = 50_000
#: Most leaves that are in work at once.
LEAVES = 1 << 19
#: Symbols above which a pre-token is merged by ranks.
LONG = 1024
NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it
    prints, else the next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Pairs with rank and result, each id's bytes, and the special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for token, i in ids.items():
            if len(token) == 1:
                self.of_byte[letters[token]] = i
        self.base = len(self.bytes)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.base + ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # By rank: whether no pair that holds the product comes before it.
        best = np.full(self.base, len(pairs), np.int64)
        for part in (keys // self.base, keys % self.base):
            np.minimum.at(best, part, np.arange(len(pairs)))
        self.at_once = best[self.made] > np.arange(len(pairs))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where it has none."""
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def merge(vocabulary: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """The ids of each non-empty pre-token as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        by_size.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
    for size, members in by_size.items():
        if size > LONG:
            for i in members:
                out[i] = _merge_long(vocabulary, pieces[i], size)
            continue
        step = max(1, LEAVES // size)
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            ids, counts = _merge_rows(vocabulary, [pieces[i] for i in part], size)
            flat, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
            start = 0
            for i, end in zip(part, ends.tolist(), strict=True):
                out[i] = flat[start:end]
                start = end
    return out


def _merge_rows(v: Vocabulary, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    rows = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, rows)
    inside = np.arange(size) < lengths[:, None]
    # One more column on the right stands for "no neighbour" and always holds no symbol.
    sym = np.full((rows, size + 1), -1, np.int64)
    sym[:, :size][inside] = v.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    at = np.arange(size + 1)
    after = np.tile(np.minimum(at + 1, size), (rows, 1))
    after[np.arange(rows), lengths - 1] = size
    before = np.tile(np.where(at > 0, at - 1, size), (rows, 1))
    tree = np.full((rows, 2 * size), NONE, np.int64)
    first = v.rank(sym[:, : size - 1], sym[:, 1:size])
    tree[:, size : 2 * size - 1] = np.where(first >= 0, first * size + at[: size - 1], NONE)
    half = size >> 1
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half >>= 1

    live = np.flatnonzero(tree[:, 1] < NONE)
    while live.size:
        root = tree[live, 1]
        pos = root % size
        gone = after[live, pos]
        right = after[live, gone]
        left = before[live, pos]
        made = v.made[root // size]
        sym[live, pos] = made
        sym[live, gone] = -1
        after[live, pos] = right
        before[live, right] = pos
        onward = v.rank(made, sym[live, right])
        back = v.rank(sym[live, left], made)
        tree[live, size + gone] = NONE
        tree[live, size + pos] = np.where(onward >= 0, onward * size + pos, NONE)
        some = left < size
        tree[live[some], size + left[some]] = np.where(back >= 0, back * size + left, NONE)[some]
        node = np.stack([pos, gone, np.where(some, left, pos)]) + size >> 1
        while node[0, 0]:
            tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            node >>= 1
        live = live[tree[live, 1] < NONE]
    kept = sym[:, :size] >= 0
    return sym[:, :size][kept], kept.sum(1)


def _merge_long(v: Vocabulary, piece: bytes, size: int) -> bytes:
    """The ids of one long pre-token."""
    n = len(piece)
    sym = np.full(size + 1, -1, np.int64)
    sym[:n] = v.of_byte[np.frombuffer(piece, np.uint8)]
    at = np.arange(size + 1)
    after, before = np.where(at + 1 < n, at + 1, size), np.where(at > 0, at - 1, size)
    tree = np.full(2 * size, NONE, np.int64)

    def leaves(places: np.ndarray) -> None:
        rank = v.rank(sym[places], sym[after[places]])
        tree[size + places] = np.where(rank >= 0, rank * size + places, NONE)

    def update(nodes: np.ndarray) -> None:
        while nodes[0] > 1:
            nodes = np.unique(nodes >> 1)
            tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])

    leaves(at[:n])
    update(size + at[:size])
    while tree[1] < NONE:
        rank = tree[1] // size
        pos = tree[1:2] % size
        if v.at_once[rank]:
            nodes = np.ones(1, np.int64)
            while nodes[0] < size:  # down to all leaves of the root's rank
                nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
                nodes = nodes[tree[nodes] // size == rank]
            pos = nodes - size
            # Of places that follow each other every second one, from the first.
            place = np.arange(len(pos))
            starts = np.concatenate([[True], after[pos[:-1]] != pos[1:]])
            pos = pos[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
        gone = after[pos]
        right = after[gone]
        sym[pos], sym[gone] = v.made[rank], -1
        after[pos], before[right] = right, pos
        left = before[pos]
        changed = np.unique(np.concatenate([pos, left[left < size]]))
        tree[size + gone] = NONE
        leaves(changed)
        update(np.unique(np.concatenate([changed, gone])) + size)
    return sym[:n][sym[:n] >= 0].astype("<u4").tobytes()


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids, and back.

    Words between single spaces are encoded once and kept in a bounded cache: no pre-token reaches
    over a single space that stands between other characters than white space.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        #: White space, a space, then white space or the end: there pre-tokens may reach over.
        self.joined = regex.compile(r"\s (?:\s|\Z)")
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.cache, self.spaced, self.bare = cache, {}, {}

    def _parts(self, text: str) -> list[str]:
        """Ordinary and special parts by turns."""
        if self.cuts and any(s in text for s in self.vocabulary.special):
            return self.cuts.split(text)
        return [text]

    def _chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks as they stand, then chunks that a space precedes."""
        if self.joined.search(text):
            return self.pattern.findall(text), []
        words = text.split(" ")
        return words[:1] if words[0] else [], words[1:]

    def _split(self, words: set[str], before: str) -> dict[str, list[str]]:
        """The pre-tokens of each chunk that isn't letters alone, which is one pre-token."""
        find, out = self.pattern.findall, {}
        for w in words:
            if w[-1:] in ",." and w[:-1].isalpha():
                out[w] = [before + w[:-1], w[-1]]
            else:
                out[w] = find(before + w)
        return out

    def _learn(self, bare: set[str], spaced: set[str]) -> None:
        bare -= self.bare.keys()
        spaced -= self.spaced.keys()
        letters = [w for w in spaced if w.isalpha()]
        spaced.difference_update(letters)
        split_bare, split_spaced = self._split(bare, ""), self._split(spaced, " ")
        pieces = set()
        for found in (split_bare, split_spaced):
            for x in found.values():
                pieces.update(x)
        # A space and letters stands among the spaced chunks, under its letters.
        letters += {p[1:] for p in pieces if p[0] == " " and p[1:].isalpha()}.difference(self.spaced, letters)
        pieces = [p for p in pieces.difference(self.bare) if not (p[0] == " " and p[1:].isalpha())]
        made = merge(self.vocabulary, [p.encode() for p in pieces] + [b" " + w.encode() for w in letters])
        self.bare.update(zip(pieces, made, strict=False))
        self.spaced.update(zip(letters, made[len(pieces) :], strict=True))
        get = lambda p: self.spaced[p[1:]] if p[0] == " " and p[1:].isalpha() else self.bare[p]
        self.spaced.update([(w, b"".join(map(get, x))) for w, x in split_spaced.items()])
        self.bare.update([(w, b"".join(map(get, x))) for w, x in split_bare.items()])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        work, bare, spaced = [], set(), set()
        for raw in texts:
            parts = self._parts(raw.decode())
            chunks = [self._chunks(p) if not i % 2 else p for i, p in enumerate(parts)]
            for a, b in chunks[::2]:
                bare.update(a)
                spaced.update(b)
            work.append(chunks)
        self._learn(bare, spaced)
        out, ids = [], self.vocabulary.special
        as_is, after_space = self.bare.__getitem__, self.spaced.__getitem__
        for chunks in work:
            parts = []
            for i, c in enumerate(chunks):
                parts.append(ids[c].to_bytes(4, "little") if i % 2 else b"".join([*map(as_is, c[0]), *map(after_space, c[1])]))
            out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        if len(self.bare) + len(self.spaced) > self.cache:
            self.trim(self.cache // 4)
        return out

    def trim(self, most: int) -> None:
        """Leaves the entries that came first in each cache, which tend to be frequent."""
        self.bare, self.spaced = dict(islice(self.bare.items(), most)), dict(islice(self.spaced.items(), most))

    def decode(self, ids: bytes) -> str:
        token = self.vocabulary.bytes.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker process's codec for a tokenizer file: tasks that follow each other share it."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``token_ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (the text that
    they decode to)."""

    def make() -> Callable:
        c = codec(path)

        def apply(texts: list[bytes]) -> list:
            ids = c.encode(texts)
            return [ids, [c.decode(x) for x in ids]]

        apply.close = lambda: c.trim(IDLE // 2)
        return apply

    return map_texts(docs, make, "token_ids binary, decoded string", keep, text)


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text's ids and of what they
    decode to, without keeping either."""

    def make() -> Callable:
        c = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def apply(texts: list[bytes]) -> list:
            ids = c.encode(texts)
            return [[len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(c.decode(x).encode()) for x in ids]]

        apply.close = lambda: c.trim(IDLE // 2)
        return apply

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep, text)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


QUERIES = {"op10_bpe_codec": op10_bpe_codec}
