"""Text search by an index of pieces of three letters.

A card stands under each piece of its searched text in the compact form. The normalized form needs no pieces: the
compact form is the normalized one without some characters, so a text whose normalized form holds a needle's holds the
needle's compact form, too. The ends of texts are padded, so that each letter begins a piece, and
searches of one or two letters are pieces that begin with them. The cards of a piece are lists: one for each part, which
is 4,096 places that follow each other, so no list is longer, and lists are the rows of ranges of (piece, part). A search
intersects the lists of its rarest pieces part by part, and then tests the texts of the cards in them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.functions import text
from gradewise.operators.profit import condition, searched, with_profit
from gradewise.plans.params import ProfitQuery
from gradewise.sources.ranges import read_ends, read_ranges, read_rows, write_ranges

WIDTH = 3
PAD = "\0"
#: A part has 2 ** PART_BITS places.
PART_BITS = 12
#: Lists of a range.
LISTS = 4_000
#: Pieces that a search intersects before it tests the texts, and how many times as many cards as the rarest
#: of them another one may have; commoner pieces leave out too few cards.
DEPTH, WIDER = 3, 16


def _pieces(c: Column) -> Column:
    padded = F.concat(c, F.lit(PAD * (WIDTH - 1)))
    every = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(padded, i, F.lit(WIDTH)))
    return F.when(F.length(c) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def postings(cards: DataFrame) -> DataFrame:
    """(piece, part, places, n) of cards with profit. Cards meet by their part, as texts; the pieces of a part need no shuffle."""
    texts = cards.select(F.shiftright("pos", PART_BITS).alias("part"), "pos", text.compact(searched()).alias("t")).repartition("part")
    pieces = texts.select("part", "pos", F.explode(_pieces(F.col("t"))).alias("piece"))
    lists = pieces.groupBy("part", "piece").agg(F.collect_list("pos").alias("places"))
    return lists.select("piece", "part", "places", F.size("places").alias("n"))


def write_index(cards: DataFrame, folder: str, fee: float = 13000.0, per_range: int = LISTS) -> None:
    """Writes the index of cards under a fee, on which their decision's label depends."""
    at = f"{folder}/fee={fee:g}"
    write_ranges(postings(with_profit(cards, fee)), at, [F.col("piece"), F.col("part")], {"first": F.min("piece"), "last": F.max("piece")}, per_range)
    counts = read_rows(cards.sparkSession, at).groupBy("piece").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("piece").sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{at}/counts")


def _rows(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A few fixed rows, without Python workers."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def _compact(spark: SparkSession, needles: list[str]) -> list[str]:
    return spark.range(1).select(F.array(*[text.compact(F.lit(n)) for n in needles])).first()[0]


def _asked(spark: SparkSession, at: str, needles: list[str], depth: int) -> list[tuple[str, str, bool, int]]:
    """(needle, piece, whole, pieces) of compact needles: the rarest pieces of each and their number, or, if it is
    shorter than a piece, itself, with which pieces begin. A needle with a piece that no card has gives none."""
    pieces = {t: sorted({t[i : i + WIDTH] for i in range(len(t) - WIDTH + 1)}) for t in needles}
    every = sorted({p for of in pieces.values() for p in of})
    known = {r["piece"]: r["n"] for r in spark.read.parquet(f"{at}/counts").where(F.col("piece").isin(every)).collect()} if every else {}  # no more than the needles have letters
    out = []
    for t, of in pieces.items():
        if not of:
            out.append((t, t, False, 1))
        elif all(p in known for p in of):
            rarest = sorted(of, key=lambda p: (known[p], p))
            used = [p for p in rarest[:depth] if known[p] <= WIDER * known[rarest[0]]]
            out += [(t, p, True, len(used)) for p in used]
    return out


def _found(spark: SparkSession, at: str, needles: list[str], depth: int) -> DataFrame:
    """(needle, pos) of all cards that may hold a compact needle, each once."""
    asked = _asked(spark, at, needles, depth)
    if not asked:
        return spark.createDataFrame([], "needle string, pos bigint")
    wanted = F.broadcast(_rows(spark, asked, "needle", "wanted", "whole", "pieces"))
    begins = ~F.col("whole") & F.startswith("first", "wanted")
    ends = read_ends(spark, at).join(wanted, (begins | (F.col("first") <= F.col("wanted"))) & (F.col("last") >= F.col("wanted")))
    rows = read_ranges(spark, at, sorted(r["range"] for r in ends.select("range").distinct().collect()))
    same = F.when(F.col("whole"), F.col("piece") == F.col("wanted")).otherwise(F.startswith("piece", "wanted"))
    lists = rows.join(wanted, same).groupBy("needle", "part", "whole", "pieces").agg(F.collect_list("places").alias("lists"))
    common = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
    places = F.when(~F.col("whole"), F.array_distinct(F.flatten("lists"))).when(F.size("lists") == F.col("pieces"), common)
    return lists.select("needle", F.explode(places).alias("pos"))


def candidates(spark: SparkSession, folder: str, needle: str, fee: float = 13000.0, depth: int = DEPTH) -> DataFrame | None:
    """(pos) of all cards that may hold a needle, each once; None if every card does, as the needle's compact form is empty."""
    [small] = _compact(spark, [needle])
    return _found(spark, f"{folder}/fee={fee:g}", [small], depth).select("pos") if small else None


def indexed_each(cards: DataFrame, folder: str, q: ProfitQuery, needles: list[str]) -> DataFrame:
    """What ``matches`` gives for cards under a search with each text, with the text as ``needle``, by the index.
    The cards are read once for all texts, and once more if there are texts that every card holds."""
    spark, small = cards.sparkSession, dict.fromkeys(needles)
    small = dict(zip(small, _compact(spark, list(small))))
    every = with_profit(cards, q.fee).where(condition(replace(q, q="")))
    out = every.select(F.explode(F.array(*[F.lit(n) for n, t in small.items() if not t]).cast("array<string>")).alias("needle"), "*")
    if any(small.values()):
        found = _found(spark, f"{folder}/fee={q.fee:g}", sorted({t for t in small.values() if t}), DEPTH).withColumnRenamed("needle", "small")
        held = every.withColumn("held", text.compact(searched())).join(found, "pos").where(F.contains("held", "small"))
        names = _rows(spark, [(n, t) for n, t in small.items() if t], "needle", "small")
        out = out.unionByName(held.join(F.broadcast(names), "small").drop("small", "held"))
    return out


def indexed(cards: DataFrame, folder: str, q: ProfitQuery) -> DataFrame:
    """What ``matches`` gives for cards under a search, by the index."""
    return indexed_each(cards, folder, q, [q.q]).drop("needle")
