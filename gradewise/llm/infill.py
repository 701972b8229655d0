"""Fill-in-the-middle rearrangement of whole texts with big-integer bit-parallelism.

A text's UTF-8 bytes become three masks of a bit each, as Python integers: ``bytes.translate`` turns
bytes into the digits 0 and 1, first byte highest, and ``int(..., 2)`` reads them in linear time.
Tokens (``[A-Za-z]+|[^A-Za-z]``) start at each code point, but for a letter after a letter: a shift
and two boolean operations for all bytes at once. ``bit_count`` of that mask is the number of tokens.
The byte at which the k-th token starts is found by halving: the count of the upper half says
which half holds the bit, so all halvings together touch twice the mask.

The cuts are a function of the document's id alone, so a lost task is recomputed to the same rows.
The job is one narrow pass without a shuffle; a task holds one batch of texts and the masks of one.

Defined results: a null or empty text has no tokens and the plain form; a null id hashes as the
empty string after ``1:``; texts that hold a mark stay plain, as they could not be told apart;
repeated rows each give a row; an empty table gives an empty result; an output column takes the
place of a kept one with its name, in any case, and other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.common import others, quoted, table, text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of documents that stay plain, and of the others, percent with the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bits at which a mask is walked bit by bit rather than halved.
NARROW = 64

#: Per byte: whether it is a letter, and whether it begins a code point.
LETTERS = bytes(49 if chr(b).isalpha() and b < 128 else 48 for b in range(256))
POINTS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def masks(raw: bytes) -> tuple[int, int]:
    """Bits of the bytes at which a code point starts and at which a token starts; the first byte's
    bit is the highest of ``len(raw)`` bits."""
    if not raw:
        return 0, 0
    letters, points = int(raw.translate(LETTERS), 2), int(raw.translate(POINTS), 2)
    return points, points & ~(letters & letters >> 1)


def select(mask: int, width: int, rank: int) -> int:
    """The place from the left of the set bit number ``rank`` (from 0) of ``width`` bits; ``width``
    if there are not so many."""
    if rank >= mask.bit_count():
        return width
    base = 0
    while width > NARROW:
        low = width >> 1
        upper = mask >> low
        n = upper.bit_count()
        if rank < n:
            mask, width = upper, width - low
        else:
            mask, rank, base, width = mask & (1 << low) - 1, rank - n, base + width - low, low
    for _ in range(rank):  # the highest bit goes
        mask ^= 1 << mask.bit_length() - 1
    return base + width - mask.bit_length()


def rearranged(raw: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """The number of tokens, the form, the code points of prefix and middle, and the output."""
    points, starts = masks(raw)
    n, width = starts.bit_count(), len(raw)
    if not raw or draws[2] % 100 >= 100 - PLAIN_PERCENT or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    one, two = (select(starts, width, k) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    upto_one, upto_two = ((points >> width - at).bit_count() for at in (one, two))
    prefix, middle, suffix = raw[:one], raw[one:two], raw[two:]
    if draws[3] % 100 < SUFFIX_FIRST_PERCENT:
        form, out = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, out = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, upto_one, upto_two - upto_one, out


def restored(form: str, output: bytes) -> bytes:
    """The text that was rearranged. A mark is found at its first place: no text that holds one is
    rearranged, and none can arise across a mark's own edge, as ``<`` stands only at its start."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output[len(first) :].split(MIDDLE, 1)
    a, b = head.split(second, 1)
    return b + middle + a if form == "spm" else a + middle + b


def _draws(digest: str) -> tuple[int, int, int, int]:
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def _with_forms(docs: DataFrame, new: str, give, keep: list[str] | None, text: str, doc_id: str, seed: Column | None) -> DataFrame:
    added = T.StructType.fromDDL(new)
    keep = others(docs.columns if keep is None else keep, added.names)
    chosen = F.concat(F.lit("1:"), F.coalesce(quoted(doc_id).cast("string"), F.lit(""))) if seed is None else seed
    source = docs.select(
        *[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], F.sha2(chosen, 256).alias("digest"), text_bytes(text).alias("raw")
    )
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, names = [f.type for f in to_arrow_schema(added)], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, raw, held = batch.columns[-2], batch.columns[-1], batch.columns[:-2]
            rows = [give(x.as_py(), _draws(d.as_py())) for d, x in zip(digests, raw, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            made = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(held + made, names=names)

    return source.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", seed: Column | None = None) -> DataFrame:
    """Adds ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the rearranged text.

    ``seed`` (a string column, ``1:`` and the id by default) decides on cuts and form.
    """

    def give(raw: bytes, draws: tuple) -> tuple:
        *head, out = rearranged(raw, draws)
        return *head, out.decode()

    return _with_forms(docs, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", give, keep, text, doc_id, seed)


def fill_in_middle_digests(docs: DataFrame, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", seed: Column | None = None) -> DataFrame:
    """As ``fill_in_middle``, with ``output_sha256`` and ``restored_sha256`` (of the text rebuilt
    from form and output) in place of the output."""

    def give(raw: bytes, draws: tuple) -> tuple:
        n, form, p, m, out = rearranged(raw, draws)
        return n, form, p, m, hashlib.sha256(out).hexdigest(), hashlib.sha256(restored(form, out)).hexdigest()

    new = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return _with_forms(docs, new, give, keep, text, doc_id, seed)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"), keep=["doc_id"])


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(w) AS n, [('0x' || h[i : i + 7])::BIGINT for i in [1, 9, 17, 25]] AS hs FROM t),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1 : a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": ORACLE}
