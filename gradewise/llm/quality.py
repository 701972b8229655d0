"""Document and host quality rules.

Each whole text is measured in one narrow pass, and each rule of ``RULES`` is judged on the
measures. Failures are summed by host and rule (with partial sums before the shuffle, so a host with
any share of the rows is no burden). For each rule a beta prior is fitted to the hosts' rates by
their moments, where the variance that sampling alone gives is taken off, so that small hosts don't
make the prior look wide; each host's rate is shrunk with it. A host is rejected for a rule if its
shrunk rate lies more than ``DEVIATIONS`` standard deviations of the prior above its mean, but not
below ``HOST_RATES[0]``, and above ``HOST_RATES[1]`` in any case where the mean is lower (a rule that
most hosts fail says nothing about one of them). The verdicts go back to the
documents: only the rejected hosts are sent, broadcast if they are at most ``BROADCAST_HOSTS`` and
joined otherwise.

Defined results: a null text has no words; a null host is a host of its own; repeated rows count as
documents; null ids pass through; an empty table gives an empty result; one host alone, or hosts
that differ no more than by chance, give a prior of the largest strength; a column that has the name
of a new one, in any case, gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.llm.common import cut, fresh, map_texts, others, quoted, table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules on the measures of a text, as SQL; the first two are the base rules.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "fragment": "n_words < 5",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)",
}
BASE_RULES = ("few_words", "repeats")
#: Standard deviations of the prior above its mean at which a host is rejected.
DEVIATIONS = 3.0
#: Rates up to which no host is rejected, and above which a host is where the mean is lower.
HOST_RATES = (0.3, 0.8)
#: Bounds of the prior's strength (in documents).
STRENGTH = (1.0, 10_000.0)
BROADCAST_HOSTS = 100_000
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered


def measures(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a UTF-8
    text."""
    words = raw.split()  # bytes: ASCII white space only
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the measures of each whole text, ``failed_rules`` and ``base_failed``."""

    def make() -> Callable:
        return lambda texts: [pa.array(x, pa.int64()) for x in zip(*map(measures, texts), strict=True)]

    new = ["failed_rules", "base_failed"]
    out = map_texts(docs, make, MEASURES, others(docs.columns if keep is None else keep, new), text)
    failed = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]))
    out = out.select("*", failed.alias("failed_rules"))
    return out.withColumn("base_failed", fails(BASE_RULES))


def fails(rules: tuple[str, ...]) -> Column:
    """Whether a measured document fails one of some rules."""
    return F.arrays_overlap("failed_rules", F.array(*map(F.lit, rules)))


def host_rates(measured: DataFrame, host: str = "source", deviations: float = DEVIATIONS, bounds: tuple[float, float] = HOST_RATES) -> DataFrame:
    """(host, rule, n_docs, n_failed, rate, shrunk_rate, most): failure rates, their posterior means,
    and the rate above which a host is rejected."""
    counted = [F.struct(F.lit(r).alias("rule"), F.count_if(F.array_contains("failed_rules", r)).alias("n_failed")) for r in RULES]
    by_host = measured.groupBy(quoted(host).alias("host")).agg(F.count("*").alias("n_docs"), F.array(*counted).alias("each"))
    rates = by_host.select("host", "n_docs", F.inline("each")).withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    m, v, s = F.col("m"), F.col("v"), F.col("s")
    moments = rates.groupBy("rule").agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.coalesce(F.var_samp("rate"), F.lit(0.0)).alias("seen"), F.avg(1 / F.col("n_docs")).alias("shorter")
    )
    between = moments.select("rule", "m", (F.col("seen") - m * (1 - m) * F.col("shorter")).alias("v"))
    strength = F.when(v > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), m * (1 - m) / v - 1))).otherwise(F.lit(STRENGTH[1]))
    above = m + deviations * F.sqrt(m * (1 - m) / (s + 1))
    # One row for each rule.
    prior = between.select("rule", "m", strength.alias("s")).withColumn("most", F.greatest(F.lit(bounds[0]), F.when(m < bounds[1], F.least(F.lit(bounds[1]), above)).otherwise(above)))
    shrunk = (F.col("n_failed") + m * s) / (F.col("n_docs") + s)
    return rates.join(F.broadcast(prior), "rule").select("host", "rule", "n_docs", "n_failed", "rate", shrunk.alias("shrunk_rate"), "most")


def rejected_hosts(measured: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The hosts that are rejected for a rule, marked for broadcast where their number is small."""
    bad = cut(host_rates(measured, host, **limits).where("shrunk_rate > most").select("host").distinct())
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def with_verdict(measured: DataFrame, rejected: DataFrame, host: str = "source", rules: tuple[str, ...] = BASE_RULES) -> DataFrame:
    """Adds ``kept``: the document fails none of ``rules``, and its host is not rejected."""
    own = others(measured.columns, ["kept"])
    name, mark = fresh("rejected", measured.columns), fresh("is_rejected", measured.columns)
    bad = rejected.select(F.col("host").alias(name), F.lit(True).alias(mark))
    judged = measured.join(bad, quoted(host).eqNullSafe(F.col(name)), "left")
    return judged.select(*map(quoted, own), (~fails(rules) & F.col(mark).isNull()).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = cut(measure(docs, keep=["doc_id", "source"]))
    judged = with_verdict(measured, rejected_hosts(measured))
    return judged.drop("source").withColumn("failed_rules", F.array_join("failed_rules", ","))


ORACLE = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, w[i : i + 2] AS tri FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS x(k) GROUP BY r),
m AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM t LEFT JOIN repeats USING (r)),
f AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())}], lambda x: x IS NOT NULL) AS failed FROM m),
rates AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE list_contains(failed, rule)) AS k FROM f, (VALUES {", ".join(f"('{name}')" for name in RULES)}) AS x(rule) GROUP BY source, rule),
moments AS (SELECT rule, sum(k) / sum(n) AS m, coalesce(var_samp(k / n), 0) - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * avg(1 / n) AS v FROM rates GROUP BY rule),
prior AS (SELECT rule, m, CASE WHEN v > 0 THEN greatest({STRENGTH[0]}, least({STRENGTH[1]}, m * (1 - m) / v - 1)) ELSE {STRENGTH[1]} END AS s FROM moments),
bad AS (SELECT DISTINCT source FROM rates JOIN prior USING (rule) WHERE (k + m * s) / (n + s) > greatest({HOST_RATES[0]}, CASE WHEN m < {HOST_RATES[1]} THEN least({HOST_RATES[1]}, m + {DEVIATIONS} * sqrt(m * (1 - m) / (s + 1))) ELSE m + {DEVIATIONS} * sqrt(m * (1 - m) / (s + 1)) END))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_lines AS BIGINT) AS n_lines,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, array_to_string(failed, ',') AS failed_rules,
  len(list_intersect(failed, ['few_words', 'repeats'])) > 0 AS base_failed, len(list_intersect(failed, ['few_words', 'repeats'])) = 0 AND b.hit IS NULL AS kept
FROM f LEFT JOIN (SELECT source, true AS hit FROM bad) b ON f.source IS NOT DISTINCT FROM b.source
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": ORACLE}
