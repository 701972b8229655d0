"""Encoding and decoding with a sentencepiece model of the BPE kind, by a table of prefixes.

The encoding of each prefix of a word ends in one token, the only match of the vocabulary's
automaton at that place which is compatible with the last token before it: two tokens are
compatible where merging them side by side never joins across their border. A forward walk over
the matches stores that token for each prefix; the ids are then recovered backwards from the
word's end. The walk is linear in the word, as the matches at a place are no more than the
lengths of pieces.

A token's own merges are derived once and held as the steps at which its first or last symbol
changes; a pair is tested by playing the two lists of steps against each other in order of rank,
the left one first on ties. Tokens that merging doesn't make are never used.

Words are runs of spaces with what follows, as no piece holds a space after another character;
their ids are kept in a bounded cache. A character that is in no piece falls back to its bytes
and is a border of its own. The job is one narrow pass without a shuffle; a task's memory is
bounded by its slice of texts and by the caches' limits.

Defined results: a null or empty text has the begin and end ids alone and decodes to the empty
text; the model's space mark in a text is a space, as the library has it; repeated rows each give
a row; null ids pass through; an empty table gives an empty result; columns of other names pass
through or are left out, as ``keep`` says.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from gradewise.llm.common import map_texts, table

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Most entries of a worker's caches of words and of pairs before they are trimmed.
WORDS, PAIRS = 150_000, 500_000
#: Words that it holds between tasks, as idle workers keep their memory.
IDLE = 50_000
NEVER = 1 << 60


class PieceModel:
    """Pieces with rank and id, and what each token is made of."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[str, float] = {}
        self.of_byte = [-1] * 256
        #: What each id decodes to; begin, end and other control ids decode to nothing.
        self.bytes = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.of_byte[value], self.bytes[i] = i, bytes([value])
            elif model.is_unused(i):
                raise ValueError("a model with unused pieces isn't supported")
            elif not (model.is_control(i) or model.is_unknown(i)):
                score[piece] = model.get_score(i)
                self.bytes[i] = piece.replace(MARK, " ").encode()
        if min(self.of_byte) < 0:
            raise ValueError("the model has no fallback to bytes")
        if any(a != MARK and b == MARK for p in score for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece spans a space: texts can't be cut at spaces")
        self.begin, self.end = model.bos_id(), model.eos_id()
        level = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: level[s] for p, s in score.items() if len(p) > 1}
        #: Every symbol that merging can meet: pieces, and the single characters of pieces.
        self.symbols = list(score) + sorted({c for p in score for c in p} - score.keys())
        self.sizes = list(map(len, self.symbols))
        #: The ids of each symbol, last one first.
        self.backward = [(model.piece_to_id(s),) if s in score else tuple(self.fallback(s)[::-1]) for s in self.symbols]
        self.steps = list(map(self._derive, self.symbols))
        self.automaton = ahocorasick.Automaton()
        for i, s in enumerate(self.symbols):
            if self.steps[i]:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def fallback(self, text: str) -> list[int]:
        return [self.of_byte[b] for b in text.encode()]

    def _derive(self, symbol: str) -> tuple | None:
        """The ranks of the merges that make a symbol, in order, with the last and the first part
        before the first merge and after each; None if merging doesn't make it."""
        parts, get = list(symbol), self.rank.get
        ranks, lasts, firsts = [], [parts[-1]], [parts[0]]
        while len(parts) > 1:
            joint = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(joint)
            if best == NEVER:
                return None
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ranks.append(best), lasts.append(parts[-1]), firsts.append(parts[0])
        return [*ranks, NEVER], lasts, firsts

    def compatible(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are side by side."""
        ranks_l, lasts, _ = self.steps[left]
        ranks_r, _, firsts = self.steps[right]
        i = j = 0
        while True:
            joint, a, b = self.rank.get(lasts[i] + firsts[j], NEVER), ranks_l[i], ranks_r[j]
            if joint < a and joint <= b and joint < NEVER:
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1


class PieceCodec:
    """Encodes texts to little-endian unsigned 32-bit ids with begin and end, and back."""

    def __init__(self, path: str, words: int = WORDS, pairs: int = PAIRS):
        self.model, self.most_words, self.most_pairs = PieceModel(path), words, pairs
        self.find = re.compile(" *[^ ]+| +").findall
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.head, self.tail = (x.to_bytes(4, "little") for x in (self.model.begin, self.model.end))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word. The words stand in one text with blanks between, which no piece
        has: a place without a last token is a border, and so is a character in no piece."""
        model, pairs = self.model, self.pairs
        sizes, base, fits_of = model.sizes, len(model.sizes), pairs.get
        text = " ".join(words)
        last = [-1] * (len(text) + 1)  # the last token of each prefix
        for at, token in model.automaton.iter(text):
            at += 1
            if last[at] < 0:
                before = last[at - sizes[token]]
                if before >= 0:
                    fits = fits_of(before * base + token)
                    if fits is None:
                        fits = pairs[before * base + token] = model.compatible(before, token)
                    if not fits:
                        continue
                last[at] = token
        out, end = [], 0
        for w in words:
            start, end = end, end + len(w)
            ids, at = [], end
            while at > start:  # the ids from the word's end
                token = last[at]
                if token >= 0:
                    ids += model.backward[token]
                    at -= sizes[token]
                else:
                    ids += model.fallback(text[at - 1])[::-1]
                    at -= 1
            out.append(array("I", ids[::-1]).tobytes())
            end += 1  # the blank
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        work, known = [], self.words
        for raw in texts:
            text = raw.decode().replace(MARK, " ")
            words = self.find(" " + text) if "  " in text or text[:1] == " " else [" " + w for w in text.split(" ")] if text else []
            new = list(set(words).difference(known))
            known.update(zip(new, self.encode_words([w.replace(" ", MARK) for w in new]), strict=True))
            work.append(b"".join([self.head, *map(known.__getitem__, words), self.tail]))
            if len(known) > self.most_words:
                self.trim(self.most_words // 2)
                known = self.words
        return work

    def trim(self, most: int) -> None:
        """Leaves the words that came first, which tend to be frequent, and bounds the pairs."""
        self.words = dict(islice(self.words.items(), most))
        if len(self.pairs) > self.most_pairs:
            self.pairs = dict(islice(self.pairs.items(), self.most_pairs // 2))

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding puts before a text goes."""
        token = self.model.bytes.__getitem__
        out = b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
        return out[out[:1] == b" " :].decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def piece_codec(path: str) -> PieceCodec:
    """The worker process's codec for a model: tasks that follow each other share it."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _mapped(docs: DataFrame, path: str, new: str, give: Callable[[PieceCodec, list[bytes]], list], text: str, keep: list[str] | None) -> DataFrame:
    def make() -> Callable:
        c = piece_codec(path)

        def apply(texts: list[bytes]) -> list:
            return give(c, texts)

        apply.close = lambda: c.trim(IDLE)
        return apply

    return map_texts(docs, make, new, keep, text)


def encode_pieces(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``token_ids`` (binary, little-endian unsigned 32-bit, with begin and end) and
    ``decoded`` (the text that they decode to)."""

    def give(c: PieceCodec, texts: list[bytes]) -> list:
        ids = c.encode(texts)
        return [ids, list(map(c.decode, ids))]

    return _mapped(docs, path, "token_ids binary, decoded string", give, text, keep)


def piece_digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text's ids and of what they
    decode to, without keeping either."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def give(c: PieceCodec, texts: list[bytes]) -> list:
        ids = c.encode(texts)
        return [[len(x) // 4 for x in ids], list(map(sha, ids)), [sha(c.decode(x).encode()) for x in ids]]

    return _mapped(docs, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", give, text, keep)


def op12_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


QUERIES = {"op12_sentencepiece_codec": op12_sentencepiece_codec}
