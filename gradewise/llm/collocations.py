"""Phrase collocation mining by pivot partitioning, as in MG-FSM.

Words are ordered within a language, frequent ones first. The pivot of an n-gram is its rarest word
(at the leftmost of its places), so each place of an n-gram belongs to one word occurrence. Every
occurrence is rewritten to a fragment: itself with at most ``LONGEST`` - 1 neighbours a side, cut
where a rarer word, a word below the threshold or a piece's edge stands. Fragments are summed inside
tasks, packed by groups of pivots, of which a language has ``GROUPS``, and routed to the group's
partition, where the n-grams over each pivot are mined locally, by prefix growth from the pivot outwards; no
n-gram of another pivot is made. So a slice makes a bounded number of rows, however many of its words are frequent.

The order is a dictionary of the most frequent words of at most ``DICTIONARY`` entries, in which each
word is one character, so a text is a string of a character a word and fragments are slices of it. A
word outside it counts as rarer than all in it, in the order of a checksum, and its fragments are
texts; where the dictionary holds all words of the threshold, others can be in no result and cut
fragments. So the broadcast is bounded, and results are the same for any bound.

A pivot of more than ``HOT`` occurrences is dealt over several partitions: by its left neighbour for
the n-grams that have one, by its right neighbour for the others, so an n-gram is still counted in
one place. Should the fragments of a group exceed a chunk all the same, the n-grams of
each chunk are partial counts, summed by phrase in a shuffle that final counts pass as they are.
Counts of words are joined to cuts of phrases by key, with large keys split by adaptive execution.
The top of each language is ranked in buckets of phrases first, so no task sees all phrases of a
language.

Defined results: null texts are empty; null languages are ``und``; rows repeat freely (ids play no
part); an empty table gives an empty result; of extra columns none is read. Words are compared as
UTF-8 bytes. Counts are longs; scores are exact, products being decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewise.llm.common import cut, map_arrow, quoted, slices, table, text_bytes

#: Least occurrences, longest phrase in words, and phrases of a language.
LEAST, LONGEST, MOST = 100, 5, 2000
#: Most words of the broadcast order (some 100 bytes each in a worker).
DICTIONARY = 400_000
#: Occurrences of a pivot above which it is dealt over partitions.
HOT = 1 << 16
#: Groups of a language's pivots that aren't hot; pivots of close frequency are in different ones.
GROUPS = 4096
#: Different fragments of a group of pivots that are mined at once.
CHUNK = 400_000
#: Buckets in which each language's phrases are ranked first.
BUCKETS = 64
UNKNOWN = "und"
#: Rare words stand above all characters of the dictionary, and what cuts a fragment above all words.
RARE, CUT = 1 << 40, 1 << 60
#: The character of what cuts a fragment; it also parts packed fragments.
EDGE = "\0"
SURROGATES = 0xD800, 0x800
#: Which n-grams of a hot pivot a row is for.
ALL, WITH_LEFT, WITHOUT_LEFT = range(3)
#: Of the dictionary: a hot pivot, or an empty one with the number of a group as share.
FRAGMENTS = "lang string, pivot string, rare boolean, side int, share int, packed string, weights array<bigint>"

#: A-Z in lower case, tabs as spaces, and each separator as a full stop, which no word has.
_NORMAL = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(raw: list[bytes]) -> list[bytes]:
    """The words of texts, with a full stop at each edge of a piece."""
    return b".".join(raw).translate(_NORMAL).replace(b".", b" . ").split()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The words of each bounded slice of texts, by language."""
    for batch in batches:
        langs, raw = batch.columns[0].to_pylist(), batch.columns[1].to_pylist()
        sizes = pa.compute.binary_length(batch.columns[1]).to_numpy(zero_copy_only=False)
        for lo, hi in slices(sizes):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[lo:hi], raw[lo:hi], strict=True):
                texts.setdefault(lang, []).append(text)
            yield [(lang, words_of(x)) for lang, x in texts.items()]


def _spoken(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(quoted(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_bytes(text).alias("raw"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, f): all occurrences of each word, summed inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spoken in _by_language(batches):
            for name, words in spoken:
                counts = Counter(words)
                counts.pop(b".", None)
                held = pa.array(counts.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(counts)).cast(pa.string()), held, pa.array(counts.values(), pa.int64())], names=["lang", "word", "f"])

    counted = map_arrow(_spoken(docs, text, lang), run, "lang string, word string, f bigint")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def character(rank: int) -> str:
    return chr(rank + 1 if rank + 1 < SURROGATES[0] else rank + 1 + SURROGATES[1])


class Order:
    """The broadcast order of words: a bounded dictionary of the most frequent ones."""

    def __init__(self, rows: list, complete: bool):
        self.complete = complete
        #: By language, words by falling frequency, and the shares of those that are hot.
        self.words: dict[str, list[str]] = {}
        self.shares: dict[str, list[int]] = {}
        for r in rows:
            self.words.setdefault(r["lang"], []).append(r["word"])
            if r["f"] > HOT:
                self.shares.setdefault(r["lang"], []).append(-(-r["f"] // HOT))
        #: Of a word outside the dictionary, at most.
        self.rare_shares = 1 if complete or not rows else -(-rows[-1]["f"] // HOT)
        self._characters: dict[str, dict[bytes, str]] = {}

    def characters(self, lang: str) -> dict[bytes, str]:
        if lang not in self._characters:
            self._characters[lang] = {w.encode(): character(i) for i, w in enumerate(self.words.get(lang, []))}
        return self._characters[lang]

    def share(self, lang: str) -> dict[str, int]:
        return {character(i): n for i, n in enumerate(self.shares.get(lang, []))}

    def spelled(self, lang: str, text: str) -> list[str]:
        """The words of a string of a character a word."""
        words = self.words[lang]
        return [words[c - 1 if c < SURROGATES[0] else c - 1 - SURROGATES[1]] for c in map(ord, text)]


def order_of(words: DataFrame, least: int = LEAST, most: int = DICTIONARY) -> Order:
    """``words`` has (lang, word, f). Frequencies that would exceed the bound are left out whole, by
    a histogram of powers of 2, so the driver gets at most ``most`` words."""
    frequent = words.where(F.col("f") >= least)
    levels = {r["level"]: r["n"] for r in frequent.groupBy(F.floor(F.log2("f")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()}
    held, floor = 0, None
    for level in sorted(levels, reverse=True):
        if held + levels[level] > most:
            break
        held, floor = held + levels[level], level
    rows = [] if floor is None else frequent.where(F.floor(F.log2("f")) >= floor).collect()
    rows.sort(key=lambda r: (-r["f"], r["lang"], r["word"]))
    return Order(rows, held == sum(levels.values()))


def _near(text: str, longest: int, hot: int = 0, groups: int = GROUPS) -> Iterator[tuple[int, Counter]]:
    """The fragments over each group of pivots of a string of a character a word; each of the ``hot`` first
    characters is a group of its own, the negative of its code."""
    around, n = longest - 1, len(text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.full(n + 2 * around, CUT)
    at[around : around + n] = np.where(codes == 0, CUT, codes)
    reach = []
    for before in (True, False):
        on, count = codes > 0, np.zeros(n, np.int64)
        for d in range(1, around + 1):
            on = on & (at[around - d : around - d + n] < codes if before else at[around + d : around + d + n] <= codes)
            count += on
        reach.append(count)
    pos = np.flatnonzero(reach[0] + reach[1])
    last = ord(character(hot - 1)) if hot else 0
    group = np.where(codes[pos] <= last, -codes[pos], codes[pos] % groups)
    order = np.argsort(group, kind="stable")
    pos, group = pos[order], group[order]
    starts = [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(pos)]
    lo, hi = (pos - reach[0][pos]).tolist(), (pos + reach[1][pos] + 1).tolist()
    for s, e in zip([0, *starts] if len(pos) else [], starts, strict=False):
        yield int(group[s]), Counter([text[a:b] for a, b in zip(lo[s:e], hi[s:e], strict=True)])


def _near_rare(words: list[bytes], known: dict[bytes, str], longest: int) -> dict[str, Counter]:
    """Fragments over words outside the dictionary: (words before, words after), as tuples."""
    around, place = longest - 1, {b".": CUT}
    for w in set(words) - {b"."}:
        place[w] = ord(known[w]) if w in known else RARE + zlib.crc32(w)
    at = [CUT] * around + list(map(place.__getitem__, words)) + [CUT] * around
    words = [b"."] * around + words
    out: dict[str, Counter] = {}
    for i in range(around, len(words)):
        own = at[i]
        if not RARE <= own < CUT:
            continue
        lo, hi = i, i + 1
        while i - lo < around and at[lo - 1] < own:
            lo -= 1
        while hi - i <= around and at[hi] <= own:
            hi += 1
        if hi - lo > 1:
            spelled = [w.decode() for w in words[lo:hi]]
            out.setdefault(spelled[i - lo], Counter())[tuple(spelled[: i - lo]), tuple(spelled[i - lo + 1 :])] += 1
    return out


def _dealt(pivot: str, found: Counter, shares: int) -> Iterator[tuple[int, int, dict]]:
    """(side, share, fragments) of a pivot's fragments, given as (before, after)."""
    if shares == 1:
        yield ALL, 0, found
        return
    parts: dict[tuple[int, int], Counter] = {}
    of = lambda x: zlib.crc32(x.encode()) % shares
    for (a, b), c in found.items():
        if a:
            parts.setdefault((WITH_LEFT, of(a[-1])), Counter())[a, b] += c
        if b:
            parts.setdefault((WITHOUT_LEFT, of(b[0])), Counter())[b[:0], b] += c
    for (side, share), part in parts.items():
        yield side, share, part


def fragments(docs: DataFrame, order, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``FRAGMENTS``: the rewritten fragments of a slice of texts, by group of pivots. Those that occur more
    than once come first, as the weights are theirs."""

    def row(name: str, pivot: str, rare: bool, side: int, share: int, found: dict[str, int]) -> tuple:
        many = {x: c for x, c in found.items() if c > 1}
        return name, pivot, rare, side, share, EDGE.join([*many, *(x for x, c in found.items() if c == 1)]), list(many.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Order = order.value
        kinds = pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())
        names = ["lang", "pivot", "rare", "side", "share", "packed", "weights"]
        for spoken in _by_language(batches):
            for name, words in spoken:
                characters, shares, rows = known.characters(name), known.share(name), []
                for group, found in _near("".join(map(characters.get, words, repeat(EDGE))), longest, len(shares)):
                    if group >= 0:
                        rows.append(row(name, "", False, ALL, group, found))
                        continue
                    pivot = chr(-group)
                    cut_at = {(a, b): c for x, c in found.items() for a, _, b in [x.partition(pivot)]}
                    for side, share, part in _dealt(pivot, cut_at, shares[pivot]):
                        rows.append(row(name, pivot, False, side, share, {a + pivot + b: c for (a, b), c in part.items()}))
                if not known.complete:
                    for pivot, found in _near_rare(words, characters, longest).items():
                        for side, share, part in _dealt(pivot, found, known.rare_shares):
                            rows.append(row(name, pivot, True, side, share, {" ".join([*a, ".", *b]): c for (a, b), c in part.items()}))
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_arrow(_spoken(docs, text, lang), run, FRAGMENTS)


def _mined(rows: list[tuple], side: int, least: int, longest: int) -> Iterator[tuple]:
    """(before, after, count) of the n-grams over a pivot with at least ``least`` occurrences. ``rows``
    are (before, after, weight), as strings or tuples. A shape has so many words before and after
    the pivot; a row goes on to a shape if it was frequent without its outermost word of either side."""
    if sum(r[2] for r in rows) < least:
        return
    frequent: dict[tuple[int, int], tuple[set, list]] = {}
    for size in range(1, longest):
        for left in range(side == WITH_LEFT, 1 if side == WITHOUT_LEFT else size + 1):
            right = size - left
            needs_inner = right and size > 1
            needs_outer = left and size > 1 and not (side == WITH_LEFT and left == 1)
            inner, outer = frequent.get((left, right - 1)), frequent.get((left - 1, right))
            if (needs_inner and not inner) or (needs_outer and not outer):
                continue
            counts, kept = Counter(), []
            for row in inner[1] if needs_inner else outer[1] if needs_outer else rows:
                a, b, weight = row
                if len(a) < left or len(b) < right:
                    continue
                gram = a[len(a) - left :] + b[:right]
                if (needs_inner and gram[:-1] not in inner[0]) or (needs_outer and gram[1:] not in outer[0]):
                    continue
                counts[gram] += weight
                kept.append(row)
            some = {g for g, c in counts.items() if c >= least}
            if some:
                frequent[left, right] = some, kept
                for g in some:
                    yield g[:left], g[left:], counts[g]


def _every(rows: list[tuple], side: int, longest: int) -> Iterator[tuple]:
    """All n-grams over the pivot, with their occurrences in these fragments."""
    counts: Counter = Counter()
    for a, b, weight in rows:
        for left in range(side == WITH_LEFT, len(a) + 1):
            for right in range(min(len(b), longest - 1 - left) + 1):
                if left or right:
                    counts[a[len(a) - left :], b[:right]] += weight
    for (a, b), c in counts.items():
        yield a, b, c


def phrase_counts(packed: DataFrame, order, least: int = LEAST, longest: int = LONGEST, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, a): phrases of 2 words and more with at least ``least`` occurrences, of the
    rows of ``fragments``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, fragments, whether these are all of the key)"""
        key, found, whole = None, Counter(), True
        for batch in batches:
            *keys, texts, weights = (c.to_pylist() for c in batch.columns)
            for at, text, some in zip(zip(*keys, strict=True), texts, weights, strict=True):
                if key != at:
                    if found:
                        yield key, found, whole
                    key, found, whole = at, Counter(), True
                parts = text.split(EDGE)
                for x, weight in zip(parts, some, strict=False):
                    found[x] += weight
                found.update(parts[len(some) :])
                if len(found) >= chunk:
                    whole = False  # more may follow
                    yield key, found, whole
                    found = Counter()
        if found:
            yield key, found, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Order = order.value
        held: list[tuple] = []
        for (lang, pivot, rare, side, _), found, whole in chunks(batches):
            if rare:
                split = ((x.split(" "), c) for x, c in found.items())
                rows = {pivot: [(tuple(w[: w.index(".")]), tuple(w[w.index(".") + 1 :]), c) for w, c in split]}
                phrase = lambda p, a, b: " ".join([*a, p, *b])
            else:
                rows = {}
                for x, c in found.items():
                    p = max(x)  # a fragment's pivot is its rarest word
                    a, _, b = x.partition(p)
                    rows.setdefault(p, []).append((a, b, c))
                phrase = lambda p, a, b: " ".join(known.spelled(lang, a + p + b))  # noqa: B023, E731
            for p, own in rows.items():
                for a, b, c in _mined(own, side, least, longest) if whole else _every(own, side, longest):
                    held.append((lang, phrase(p, a, b), c))
                    if len(held) == 10_000:
                        yield batch_of(held)
                        held = []
        yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "phrase", "a"])

    key = ["lang", "pivot", "rare", "side", "share"]
    mined = map_arrow(packed.repartition(*key).sortWithinPartitions(*key), run, "lang string, phrase string, a bigint")
    return mined.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, percent: int = 100) -> DataFrame:
    """Each phrase with its lowest-scoring cut: (lang, phrase, a, l, r, n, score), without phrases that
    a longer one with at least ``percent`` % of their occurrences holds.

    A longer phrase's occurrences are at most those of what it holds, so one word more is enough.
    """
    size = F.size(F.split("phrase", " "))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(words.select("lang", F.col("word").alias("part"), "f"))
    own = phrases.withColumn("w", F.split("phrase", " "))
    cuts = own.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    left = counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    with_parts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    judged = with_parts.withColumn("score", F.call_function("div", product.cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")))
    best = judged.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    longer = own.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w")), " "))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left_over = best.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(percent) * F.col("b.a")))
    return left_over.where(size > 1).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def ranked(phrases: DataFrame, most: int = MOST) -> DataFrame:
    """The first phrases of each language; each bucket's first ones go on to the language's rank."""
    best = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    spread = phrases.withColumn("bucket", F.pmod(F.hash("phrase"), F.lit(BUCKETS)))
    first = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= most)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= most)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    most: int = MOST,
    percent: int = 100,
    text: str = "text",
    lang: str = "lang",
    dictionary: int = DICTIONARY,
    chunk: int = CHUNK,
) -> DataFrame:
    """Each language's first ``most`` phrases by score: (lang, rank, phrase, a, l, r, n, score)."""
    words = cut(word_counts(docs, text, lang))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = docs.sparkSession.sparkContext.broadcast(order_of(words, least, dictionary))
    phrases = cut(phrase_counts(fragments(docs, order, longest, text, lang), order, least, longest, chunk))
    order.destroy()
    return ranked(scored(phrases, words.where(F.col("f") >= least), totals, percent), most)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k AS size FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, (VALUES (1), (2), (3), (4), (5)) AS x(k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM s GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n.n, (1000 * a::HUGEINT * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 : c.size], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= {MOST}
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": ORACLE}
