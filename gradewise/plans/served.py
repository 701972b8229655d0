"""Queries over what is written to be read by searches (orders in ranges, a text index), the guide over cards, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.operators import keyset, profit, text_index
from gradewise.plans.params import ProfitQuery
from gradewise.sources.cards import cards
from gradewise.sources.shared import shared_folder

PAGES = 3
#: Searches of one and two letters, of marks, of a label and of words across columns.
NEEDLES = ("7", "#2", "様子", "brand#1", "STEEL", "１２", "#4 1", "absent words", "-")


def page_by_key(spark: SparkSession, d: str, sort: str = "tx-desc") -> DataFrame:
    """The third page of a search, reached by the keys of the pages before."""
    folder, q = shared_folder(spark, "orders"), ProfitQuery(tx=1, roi=-1000, psaMax=None, sort=sort)
    keyset.write_order(cards(spark, d), folder, sort)
    shown = keyset.page(spark, folder, q)
    for _ in range(PAGES - 1):
        key = keyset.key_of(shown, sort)
        if key is None:
            break  # a page without rows is followed by none
        shown = keyset.page(spark, folder, q, key)
    return shown.select("id", "saleTx30d", "price", "psa10", "profit", "roi", "decision")


def search_by_index(spark: SparkSession, d: str) -> DataFrame:
    """All cards that each of some searches finds, by the index."""
    folder = shared_folder(spark, "index")
    # What the index and the searches read of cards, written once for both.
    cards(spark, d).select("pos", "id", "name", "model", "price", "snkPsa10Price", "tv7", "tv30", "p10tv7", "p10tv30").write.parquet(f"{folder}/cards")
    every = spark.read.parquet(f"{folder}/cards")
    text_index.write_index(every, folder)
    return text_index.indexed_each(every, folder, ProfitQuery(tx=0, roi=-1000, psaMax=None), NEEDLES).select("needle", "id")


def guide_cards(spark: SparkSession, d: str) -> DataFrame:
    return profit.guided(cards(spark, d)).select("id", "target_roi", "buy_price", "within")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "profit_page_key": page_by_key,
        "profit_page_key_roi": lambda spark, d: page_by_key(spark, d, "roi-asc"),
        "profit_search_index": search_by_index,
        "guide_cards": guide_cards,
        "guide_70": lambda spark, d: profit.guide(cards(spark, d), "70"),
        "guide_50": lambda spark, d: profit.guide(cards(spark, d), "50"),
    }


def oracle_sql(calc: str, normal: str) -> dict[str, str]:
    """``calc`` computes the relation ``found``; ``normal`` normalizes a text named ``text``."""
    page = calc + 'SELECT id, tx AS "saleTx30d", price, psa10, profit, roi, decision FROM found WHERE tx >= 1 AND roi >= -1000 AND psa10 >= 0 ORDER BY {} NULLS LAST, pos LIMIT 60 OFFSET 120'
    compact = f"regexp_replace({normal}, '[^0-9a-z぀-ヿ㐀-鿿]', '', 'g')"
    label = "CASE decision WHEN 'missing' THEN '未取得' WHEN 'valuable' THEN '出す価値あり' WHEN 'watch' THEN '様子見' ELSE '出さない' END"
    buy = "CAST(greatest(0e0, floor(({h} * {p} - 13000e0 * (1 + target_roi / 100e0)) / (target_roi / 100e0 + 1 - (1 - {h}) * 0.75e0) / 1000 + 0.5e0) * 1000) AS DOUBLE)"
    targets = "(VALUES (20), (10), (0)) AS t(target_roi)"
    priced = f""", g AS (SELECT id, target_roi, psa10, price, {buy.format(h="{h}", p="psa10")} AS buy_price FROM found CROSS JOIN {targets} WHERE psa10 > 0),
w AS (SELECT *, CASE WHEN price > 0 THEN price <= buy_price END AS within FROM g)"""
    guide = (
        calc
        + priced
        + f""", c AS (SELECT CAST(floor(psa10 / 1000 + 0.5e0) * 1000 AS INTEGER) AS psa_price, target_roi, count(*) AS n, count(*) FILTER (WHERE within) AS m FROM w GROUP BY 1, 2),
p AS (SELECT CAST(unnest(range(40000, 70001, 1000) || range(71000, 100001, 1000) || range(101000, 150001, 1000)) AS INTEGER) AS psa_price)
SELECT psa_price, target_roi, {buy.format(h="{h}", p="psa_price")} AS buy_price, coalesce(n, 0) AS n_cards, coalesce(m, 0) AS n_within FROM p CROSS JOIN {targets} LEFT JOIN c USING (psa_price, target_roi)"""
    )
    needles = ", ".join(f"('{n}')" for n in NEEDLES)
    return {
        "profit_page_key": page.format("tx DESC"),
        "profit_page_key_roi": page.format("roi"),
        "profit_search_index": calc + f""", h AS (SELECT id, {normal} AS hay, {compact} AS short FROM (SELECT *, concat_ws(' ', coalesce(name, ''), coalesce(model, ''), id, {label}) AS text FROM found WHERE roi >= -1000 AND psa10 >= 0)),
n AS (SELECT text AS needle, {normal} AS needed, {compact} AS small FROM (VALUES {needles}) AS v(text))
SELECT needle, id FROM n JOIN h ON contains(hay, needed) OR contains(short, small)""",
        "guide_cards": calc + priced.format(h="0.7e0") + " SELECT id, target_roi, buy_price, within FROM w",
        "guide_70": guide.format(h="0.7e0"),
        "guide_50": guide.format(h="0.5e0"),
    }
