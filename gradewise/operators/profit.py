"""Profit, return and decision of each card, the filters and orders of a search, and its header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.functions import text
from gradewise.functions.numbers import size_bin
from gradewise.plans.params import ProfitQuery

#: Decisions by least return, with their labels.
GOOD, WATCH = 40.0, 10.0
LABELS = {"missing": "未取得", "valuable": "出す価値あり", "watch": "様子見", "avoid": "出さない"}
#: Each order's column, and whether a missing value counts as zero, as an empty text, or comes last.
ORDERS = {
    "roi": ("roi", "last"), "profit": ("profit", "last"), "tx": ("saleTx30d", "zero"), "tx7": ("saleTx7d", "zero"), "psaTx": ("psaTx30d", "zero"), "psaTx7": ("psaTx7d", "zero"),
    "chg30": ("chg30", "last"), "chg7": ("chg7", "last"), "psa": ("psa10", "zero"), "psaMin": ("snkPsa10Min", "last"), "price": ("price", "zero"),
    "listings": ("snkListings", "last"), "days": ("days", "last"), "updated": ("tLastAt", "empty"), "tvel": ("tvel", "last"),
}


def with_profit(cards: DataFrame, fee: float = 13000.0) -> DataFrame:
    """Adds profit, roi, psa10, the trade counts, decision, its label, roi_class and bar_width."""
    price, psa10 = F.col("price"), F.col("snkPsa10Price")
    out = cards.withColumn("psa10", psa10).withColumn("profit", F.when((price > 0) & (psa10 > 0), psa10 - price - fee))
    base = price + F.lit(fee)
    out = out.withColumn("roi", F.when(base > 0, F.col("profit") / base * 100))
    for name, column in (("saleTx30d", "tv30"), ("saleTx7d", "tv7"), ("psaTx30d", "p10tv30"), ("psaTx7d", "p10tv7")):
        out = out.withColumn(name, F.coalesce(column, F.lit(0)))
    roi = F.col("roi")
    decision = F.when(roi.isNull(), "missing").when(roi >= GOOD, "valuable").when(roi >= WATCH, "watch").otherwise("avoid")
    label = reduce(lambda rest, kv: F.when(F.col("decision") == kv[0], kv[1]).otherwise(rest), LABELS.items(), F.lit(None))
    out = out.withColumn("decision", decision).withColumn("decision_label", label)
    return out.withColumn("roi_class", F.when(roi >= 120, "good").when(roi >= 80, "sky").otherwise("warn")).withColumn("bar_width", F.when(roi.isNotNull(), F.greatest(F.lit(8.0), F.least(F.lit(100.0), roi))))


def matches(cards: DataFrame, q: ProfitQuery) -> DataFrame:
    return cards.where(condition(q))


def condition(q: ProfitQuery) -> Column:
    """Filters of a search; stored columns first, so that they reach the scan."""
    keep: list[Column] = []

    def between(column: str, least: float | None, most: float | None) -> None:
        if least is not None:
            keep.append(F.col(column) >= least)
        if most is not None:
            keep.append(F.col(column) <= most)

    between("saleTx30d", q.tx, q.txMax)
    between("saleTx7d", q.tx7, q.tx7Max)
    between("psaTx30d", q.psaTx, q.psaTxMax)
    between("psaTx7d", q.psaTx7, q.psaTx7Max)
    between("psa10", q.psaMin, q.psaMax)
    between("price", q.priceMin, q.priceMax)
    keep.append(F.col("roi").isNotNull() & (F.col("roi") >= q.roi))
    if q.hide:
        keep.append(~F.col("decision").isin(*q.hide))
    if q.q:
        keep.append(F.contains(text.normalize(searched()), text.normalize(F.lit(q.q))) | F.contains(text.compact(searched()), text.compact(F.lit(q.q))))
    return reduce(Column.__and__, keep)


def searched() -> Column:
    """The text of a card in which a search looks."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "model", "id", "decision_label")])


def sort_value(sort: str) -> tuple[Column, bool]:
    """What an order compares before the place, and whether the largest comes first; nulls come last."""
    measure, direction = sort.rsplit("-", 1)
    name, missing = ORDERS[measure]
    c = F.coalesce(name, F.lit(0)) if missing == "zero" else F.coalesce(name, F.lit("")) if missing == "empty" else F.col(name)
    return c, direction == "desc"


def order(sort: str) -> list[Column]:
    c, down = sort_value(sort)
    return [c.desc_nulls_last() if down else c.asc_nulls_last(), F.col("pos").asc()]


def search(cards: DataFrame, q: ProfitQuery) -> DataFrame:
    """The first page (or pages) of a search."""
    return matches(with_profit(cards, q.fee), q).orderBy(*order(q.sort)).limit(q.limit)


def header(cards: DataFrame, q: ProfitQuery) -> DataFrame:
    """One row: counts, the first row's return and profit in the current order, and the true maxima,
    in one aggregation over the cards."""
    every = with_profit(cards, q.fee)
    found = condition(q)
    # The first row is the largest (descending) or smallest (ascending) by whether the value is there, value and place.
    c, down = sort_value(q.sort)
    best, shown = (F.max_by if down else F.min_by), F.struct("roi", "profit")
    place = -F.col("pos") if down else F.col("pos")
    there = c.isNotNull() if down else c.isNull()
    first = best(F.when(found, shown), F.when(found, F.struct(there.alias("there"), c.alias("value"), place.alias("place"))))
    out = every.agg(F.count("*").alias("n_total"), F.count_if(found).alias("n_found"), F.max(F.when(found, F.col("roi"))).alias("max_roi"), F.max(F.when(found, F.col("profit"))).alias("max_profit"), first.alias("first"))
    rounded = lambda c: F.floor(F.col(c) + 0.5)
    return out.select("n_total", "n_found", "max_roi", "max_profit", rounded("first.roi").alias("first_roi"), rounded("first.profit").alias("first_profit"))


def displayed(cards: DataFrame, market: Column) -> DataFrame:
    """What a result shows beside its values: series label, direct market link, stock and averages as
    text, of cards with profit and summary columns."""
    amount = lambda c, text_of, none: F.when(F.col(c).isNotNull(), text_of(F.col(c))).otherwise(none)
    out = cards.withColumn("series_label", F.coalesce(F.nullif("rarity", F.lit("")), F.col("model"))).withColumn("market_direct", market)
    out = out.withColumn("stock_display", amount("stock", lambda c: F.concat(text.shown_number(c), F.lit("枚")), "確認中"))
    for n in (7, 30, 90):
        out = out.withColumn(f"avg{n}_display", amount(f"avg{n}", lambda c: F.concat(F.replace(F.format_number(c, 2), F.lit(","), F.lit("")), F.lit("枚/日")), "蓄積中"))
    return out


def progress(cards: DataFrame, q: ProfitQuery) -> DataFrame:
    """One row: how many cards were found, how many of them are shown, that as a text, and whether there are more."""
    out = with_profit(cards, q.fee).agg(F.count_if(condition(q)).alias("n_found"))
    out = out.withColumn("n_shown", F.least("n_found", F.lit(q.limit)))
    return out.withColumn("progress", F.concat(text.shown_number(F.col("n_found")), F.lit("枚中 "), text.shown_number(F.col("n_shown")), F.lit("枚を表示"))).withColumn("has_more", F.col("n_shown") < F.col("n_found"))


def coverage_text(coverage: DataFrame) -> DataFrame:
    """A coverage with its text, one decimal in the rate."""
    shown = F.concat(text.shown_number(F.col("linked")), F.lit(" / "), text.shown_number(F.col("total")), F.lit("（"), F.format_string("%.1f", "rate"), F.lit("%）"))
    return coverage.withColumn("shown", F.when(F.col("total") > 0, shown).otherwise("集計中"))


def publish_order() -> list[Column]:
    return [F.coalesce("tv30", F.lit(0)).desc(), F.coalesce("price", F.lit(0.0)).desc(), F.col("pos").asc()]


def with_place(cards: DataFrame) -> DataFrame:
    """Cards with their ``place`` in the order of publication. Places are counted within groups of equal
    trade counts and like prices (cards without a price: like positions), and the numbers of cards
    in the groups before are added, so no task sees all cards; what one task orders is a row for
    each group."""
    bin_ = size_bin(F.coalesce("price", F.lit(0.0)))  # 0 for no price alone, so positions may cut it further
    group = F.struct((-F.coalesce("tv30", F.lit(0))).alias("a"), (-bin_).alias("b"), F.when(bin_ == 0, F.shiftright("pos", 16)).otherwise(0).alias("c"))
    grouped = cards.withColumn("place_group", group)
    sizes = grouped.groupBy("place_group").agg(F.count("*").alias("n"))
    before = sizes.select("place_group", F.coalesce(F.sum("n").over(Window.orderBy("place_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("place_group").orderBy(*publish_order()))
    return grouped.withColumn("own", own).join(before, "place_group").withColumn("place", F.col("before") + F.col("own")).drop("place_group", "before", "own")


#: Fixed values of the purchase guide: price ranges, target returns and hit rates.
GUIDE_RANGES = [(40000, 70000), (71000, 100000), (101000, 150000)]
GUIDE_RETURNS = (20, 10, 0)
GUIDE_HITS = {"70": 0.7, "50": 0.5}
MISS_SHARE = 0.75


def buy_price(psa_price: Column, target_roi: Column, mode: str = "70", fee: float = 13000.0, step: int = 1000) -> Column:
    """The purchase price at which a card of this graded price gives the target return, rounded to the
    step and not below zero."""
    hit, r = GUIDE_HITS[mode], target_roi / F.lit(100.0)
    below = r + 1 - (1 - hit) * MISS_SHARE
    raw = (F.lit(hit) * psa_price - F.lit(fee) * (1 + r)) / below
    return F.when(below > 0, F.greatest(F.lit(0.0), F.floor(raw / step + 0.5) * step).cast("double"))


def guided(cards: DataFrame, mode: str = "70", fee: float = 13000.0, step: int = 1000) -> DataFrame:
    """Each card with a graded price, once for each target return: the purchase price, and whether the
    card costs no more than that (null where its price isn't known)."""
    priced = cards.where("snkPsa10Price > 0").withColumn("target_roi", F.explode(F.array(*map(F.lit, GUIDE_RETURNS))))
    out = priced.withColumn("buy_price", buy_price(F.col("snkPsa10Price"), F.col("target_roi"), mode, fee, step))
    return out.withColumn("within", F.when(F.col("price") > 0, F.col("price") <= F.col("buy_price")))


def guide(cards: DataFrame, mode: str = "70", fee: float = 13000.0, step: int = 1000) -> DataFrame:
    """Purchase prices by graded price and target return, with the number of cards whose graded price
    rounds to that, and of those that cost no more than the purchase price of their own."""
    prices = F.explode(F.concat(*[F.sequence(F.lit(a), F.lit(b), F.lit(step)) for a, b in GUIDE_RANGES]))
    grid = cards.sparkSession.range(1).select(prices.alias("psa_price")).withColumn("target_roi", F.explode(F.array(*map(F.lit, GUIDE_RETURNS))))
    grid = grid.withColumn("buy_price", buy_price(F.col("psa_price"), F.col("target_roi"), mode, fee, step))
    near = (F.floor(F.col("snkPsa10Price") / step + 0.5) * step).cast("int").alias("psa_price")
    counts = guided(cards, mode, fee, step).groupBy(near, "target_roi").agg(F.count("*").alias("n_cards"), F.count_if("within").alias("n_within"))
    out = grid.join(counts, ["psa_price", "target_roi"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_cards", "n_within")})
