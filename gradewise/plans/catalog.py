"""The queries over card-market data, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.functions import text
from gradewise.operators import buylist, match, pages, profit, stock
from gradewise.plans import market, runs, served
from gradewise.plans.params import MEASURES, ProfitQuery
from gradewise.sources import sinks
from gradewise.sources.cards import CARDS_SQL, cards, table

Query = Callable[[SparkSession, str], DataFrame]

CALC_SQL = (
    "WITH "
    + CARDS_SQL
    + """,
calc AS (SELECT *, "snkPsa10Price" AS psa10, CASE WHEN price > 0 AND "snkPsa10Price" > 0 THEN "snkPsa10Price" - price - 13000e0 END AS profit,
  CASE WHEN price > 0 AND "snkPsa10Price" > 0 THEN ("snkPsa10Price" - price - 13000e0) / (price + 13000e0) * 100 END AS roi,
  coalesce(tv30, 0) AS tx, coalesce(tv7, 0) AS tx7, coalesce(p10tv30, 0) AS ptx, coalesce(p10tv7, 0) AS ptx7 FROM cards),
found AS (SELECT *, CASE WHEN roi IS NULL THEN 'missing' WHEN roi >= 40 THEN 'valuable' WHEN roi >= 10 THEN 'watch' ELSE 'avoid' END AS decision FROM calc)
"""
)
SHOWN = ["id", "name", "price", "psa10", "profit", "roi", "decision"]
SHOWN_SQL = "SELECT id, name, price, psa10, profit, roi, decision FROM found "
BASE = ProfitQuery(tx=3)
BASE_SQL = "WHERE tx >= 3 AND roi >= 40 AND psa10 BETWEEN 0 AND 200000 "
#: By measure: the SQL value that is ordered.
SQL_ORDER = {
    "roi": "roi", "profit": "profit", "tx": "tx", "tx7": "tx7", "psaTx": "ptx", "psaTx7": "ptx7", "chg30": "chg30", "chg7": "chg7", "psa": "coalesce(psa10, 0)", "psaMin": '"snkPsa10Min"',
    "price": "coalesce(price, 0)", "listings": '"snkListings"', "days": "days", "updated": "coalesce(\"tLastAt\", '')", "tvel": "tvel",
}


def _search(q: ProfitQuery) -> Query:
    return lambda spark, d: profit.search(cards(spark, d), q).select(*SHOWN)


def profit_all(spark: SparkSession, d: str) -> DataFrame:
    return profit.with_profit(cards(spark, d)).select(*SHOWN, "roi_class", "bar_width", "saleTx30d", "saleTx7d", "psaTx30d", "psaTx7d")


def profit_decisions(spark: SparkSession, d: str) -> DataFrame:
    return profit.with_profit(cards(spark, d)).groupBy("decision", "decision_label").agg(F.count("*").alias("n"))


def profit_header(spark: SparkSession, d: str) -> DataFrame:
    return profit.header(cards(spark, d), BASE)


def publish_sort(spark: SparkSession, d: str) -> DataFrame:
    """All cards in the order of publication, with their place in it."""
    return profit.with_place(cards(spark, d)).select("id", "tv30", "price", "place")


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("card_id"), F.to_date("ts").alias("obs_date")).agg(F.count("*").cast("double").alias("stock"))
    return e


GRID_SQL = """WITH obs AS (SELECT user_id AS card_id, CAST(ts AS DATE) AS obs_date, CAST(count(*) AS DOUBLE) AS stock FROM events GROUP BY ALL),
axis AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) - 1 AS date_pos FROM (SELECT DISTINCT obs_date FROM obs ORDER BY obs_date DESC LIMIT 91)),
grid AS (SELECT i.card_id, a.date_pos, a.obs_date, o.stock FROM (SELECT DISTINCT card_id FROM obs) i CROSS JOIN axis a LEFT JOIN obs o ON o.card_id = i.card_id AND o.obs_date = a.obs_date)"""


def stock_grid(spark: SparkSession, d: str) -> DataFrame:
    return stock.history(observations(spark, d))


def stock_summary(spark: SparkSession, d: str) -> DataFrame:
    return stock.summary(stock.placed(observations(spark, d)))


def stock_current(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the cards that there are now, which are the parts."""
    return stock.current_summary(table(spark, d, "part").select(F.col("p_partkey").alias("id")), observations(spark, d))


def stock_to_check(spark: SparkSession, d: str) -> DataFrame:
    """Linked cards that are still to be checked on the last day of the events but one."""
    links = table(spark, d, "customer").where("c_nationkey <> 4").select(F.col("c_custkey").alias("card_id"), F.col("c_name").alias("url"), F.col("c_custkey").alias("pos"))
    return stock.to_check(links, observations(spark, d), "2024-01-29")


def stock_recorded(spark: SparkSession, d: str) -> DataFrame:
    """The observations after a run: customers of a positive balance were seen on a day of the events."""
    c = table(spark, d, "customer")
    outcomes = c.select(F.col("c_custkey").alias("card_id"), F.when(F.col("c_acctbal") > 0, "ok").otherwise("missed").alias("outcome"), F.col("c_nationkey").cast("double").alias("stock"))
    return stock.recorded(observations(spark, d), outcomes, "2024-01-29")


def stock_history_file(spark: SparkSession, d: str) -> DataFrame:
    """The history as its file has it: each card's values in the order of the dates."""
    return sinks.history_file(stock_grid(spark, d)).select("card_id", F.to_json("stocks").alias("stocks"))


STOCK_SQL = (
    GRID_SQL
    + """, p AS (SELECT *, lag(stock) OVER (PARTITION BY card_id ORDER BY date_pos) AS before, max(date_pos) OVER (PARTITION BY card_id) AS last FROM grid),
q AS (SELECT *, CASE WHEN before IS NOT NULL AND stock IS NOT NULL THEN greatest(0e0, before - stock) END AS fall FROM p),
s AS (SELECT card_id, max(stock) FILTER (WHERE date_pos = last) AS stock, floor(avg(fall) FILTER (WHERE date_pos > last - 7) * 100 + 0.5e0) / 100 AS avg7,
  floor(avg(fall) FILTER (WHERE date_pos > last - 30) * 100 + 0.5e0) / 100 AS avg30, floor(avg(fall) FILTER (WHERE date_pos > last - 90) * 100 + 0.5e0) / 100 AS avg90, count(stock) AS samples FROM q GROUP BY card_id)
SELECT *, CASE WHEN samples < 3 OR avg30 IS NULL THEN 'pending' WHEN avg30 >= 1 THEN 'high' WHEN avg30 >= 0.2e0 THEN 'normal' ELSE 'low' END AS demand,
  CASE WHEN samples < 3 OR avg30 IS NULL THEN '蓄積中' WHEN avg30 >= 1 THEN '買う人が多い' WHEN avg30 >= 0.2e0 THEN '普通' ELSE '少ない' END AS demand_label FROM s"""
)

def loose_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.loose(F.col("text"))).alias("loose"), F.md5(text.compact(F.col("text"))).alias("compact"))


NORMAL_SQL = "trim(translate(lower(coalesce(text, '')), '０１２３４５６７８９‐−–—', '0123456789----'), ' ' || chr(9) || chr(10) || chr(13) || chr(12288))"
LOOSE_SQL = f"SELECT doc_id, md5(regexp_replace({NORMAL_SQL}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS loose, md5(regexp_replace({NORMAL_SQL}, '[^0-9a-z぀-ヿ㐀-鿿]', '', 'g')) AS compact FROM documents"


def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda status: o.where(F.col("o_orderstatus") == status).select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("value"))
    out = match.merge_catalogs(side("O"), side("F"))
    return out.select("url", "value", F.col("place.__rank").alias("first_catalog"), F.col("place.pos").alias("first_pos"))


MERGE_SQL = """WITH u AS (SELECT 'u' || o_custkey AS url, o_orderkey AS pos, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS k FROM orders WHERE o_orderstatus IN ('O', 'F'))
SELECT url, arg_max(pos, k * 1000000000 + pos) AS value, CAST(arg_min(k, k * 1000000000 + pos) AS INTEGER) AS first_catalog, arg_min(pos, k * 1000000000 + pos) AS first_pos FROM u GROUP BY url"""


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    previous = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.col("l_suppkey").alias("link"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return match.carry_forward(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id")), previous, ["link"])


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of parts to suppliers' pages, today's catalog, and the misses so far."""
    links = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("card_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("url"))
    url = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("url")
    s = table(spark, d, "supplier")
    seen = s.where("s_suppkey % 4 <> 0").select(url, F.when(F.col("s_suppkey") % 5 == 0, "B").otherwise("A").alias("state"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey").cast("double")).alias("stock"), F.lit("2026-08-22").cast("date").alias("observed_at"))
    return links, seen, s.where("s_suppkey % 8 = 0").select(url, F.lit(1).alias("misses"))


def dead_links(spark: SparkSession, d: str) -> DataFrame:
    return stock.catalog_run(*_run(spark, d), "2026-08-22")


DEAD_SQL = """WITH l AS (SELECT l_orderkey AS card_id, l_suppkey AS k, 's' || l_suppkey AS url FROM lineitem WHERE l_linenumber = 1)
SELECT card_id, url, CASE WHEN k % 8 = 0 THEN 'invalid' WHEN k % 4 = 0 THEN 'missed' WHEN k % 5 = 0 THEN 'rejected' WHEN k % 7 = 0 THEN 'unknown' ELSE 'ok' END AS outcome,
  CASE WHEN k % 4 <> 0 AND k % 7 <> 0 THEN CAST(k AS DOUBLE) END AS stock, CASE WHEN k % 8 = 0 THEN 2 WHEN k % 4 = 0 THEN 1 END::INTEGER AS misses_next FROM l"""


def link_state(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "url string"), spark.createDataFrame([], "card_id bigint")
    before = _run(spark, d)[2].unionByName(spark.range(1).select(F.lit("no longer linked").alias("url"), F.lit(1).alias("misses")))
    misses, bad, _ = stock.next_state(dead_links(spark, d), *none, before)
    return misses.join(bad.withColumn("invalid", F.lit(True)), "url", "full").select("url", "misses", F.coalesce("invalid", F.lit(False)).alias("invalid"))


STATE_SQL = """WITH k AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1) SELECT 's' || k AS url, CASE WHEN k % 8 = 0 THEN 2 WHEN k % 4 = 0 THEN 1 END::INTEGER AS misses, k % 8 = 0 OR (k % 4 <> 0 AND k % 5 = 0) AS invalid FROM k WHERE k % 4 = 0 OR k % 5 = 0
UNION ALL SELECT 's' || s_suppkey, 1, false FROM supplier WHERE s_suppkey % 8 = 0 AND s_suppkey NOT IN (SELECT k FROM k) UNION ALL SELECT 'no longer linked', 1, false"""


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return stock.run_counts(dead_links(spark, d))


def link_due(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("card_id"))
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("card_id")).agg(F.max("o_orderdate").cast("string").alias("checked_at"))
    return stock.due(c, last, "2001-01-01 00:00:00")


DUE_SQL = "SELECT c_custkey AS card_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE d IS NULL OR d <= TIMESTAMP '2001-01-01' - INTERVAL 30 DAY"


def link_keep(spark: SparkSession, d: str) -> DataFrame:
    links, seen, _ = _run(spark, d)
    old = links.select(F.col("card_id").alias("id"), "url")
    new = links.where("card_id % 9 = 0").select(F.col("card_id").alias("id"), F.lit("new").alias("url"))
    bad = seen.where("url LIKE '%1'").select("url")
    return match.keep_links(old, new, seen.withColumn("name", F.lit("x")), bad)


KEEP_SQL = """SELECT l_orderkey AS id, CASE WHEN l_orderkey % 9 = 0 THEN 'new' WHEN l_suppkey % 4 <> 0 AND l_suppkey % 5 <> 0 AND l_suppkey % 10 <> 1 THEN 's' || l_suppkey END AS url FROM lineitem WHERE l_linenumber = 1"""


def listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("listing_id"), F.col("event_type").alias("shop"), F.col("user_id").alias("card"), F.col("value").alias("price"), F.col("ts").alias("posted_at"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def _on_listings(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(listings(spark, d))


EVENTS_SQL = "WITH e AS (SELECT event_id AS listing_id, event_type AS shop, user_id AS card, value AS price, ts AS posted_at, CAST(round(value * 100) AS BIGINT) AS cents FROM events) "
WINDOW_SQL = EVENTS_SQL + "SELECT shop, card, CAST(grouping(shop) AS TINYINT) AS all_shops, count(*) AS n, max(posted_at) AS last_seen, quantile_cont(price, 0.5) AS price_median FROM e {} GROUP BY GROUPING SETS ((shop, card), (card))"


VS_AVG_SQL = """, s AS (SELECT card, shop, count(*) AS n, sum(cents) AS c FROM e GROUP BY card, shop), a AS (SELECT card, sum(cents) AS c, count(*) AS n, min(price) AS price_min, max(price) AS price_max, quantile_cont(price, 0.5) AS price_median FROM e GROUP BY card),
m AS (SELECT card, shop, s.n, CAST(s.c AS DOUBLE) / s.n / 100 AS avg, CAST(a.c AS DOUBLE) / a.n / 100 AS avg_all, price_min, price_max, price_median FROM s JOIN a USING (card)), p AS (SELECT *, avg - avg_all AS difference, (avg - avg_all) / avg_all * 100 AS pct FROM m),
v AS (SELECT *, CASE WHEN pct <= -10 THEN 'cheap' WHEN pct >= 10 THEN 'expensive' ELSE 'average' END AS price_label, CASE WHEN n >= 10 THEN 'many' ELSE 'few' END AS count_label FROM p)"""


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return pages.headings(table(spark, d, "pages"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(table(spark, d, "pages")).select("page_id", F.col("at").cast("bigint").alias("place"), "href")


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Page counts of all pages, some with a last-page button before their address."""
    button = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a class="to_last_page pager_btn">'), F.col("page_id").cast("string"), F.lit("</a>"))).otherwise("")
    return table(spark, d, "pages").select("page_id", pages.total_pages(F.concat(button, "url", F.lit('"'), "html")).alias("n"))


def new_posts(spark: SparkSession, d: str) -> DataFrame:
    """Events as posts, of which several share an id or an image."""
    e = table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"), "event_type").alias("post_id"), F.col("ts").alias("posted_at"), F.when(F.col("value") > 5, F.floor(F.col("value") * 10).cast("string")).alias("image_hash"), "event_id")
    return buylist.new_posts(e.withColumn("posted_at", F.struct("posted_at", "event_id"))).select("post_id", F.col("posted_at.posted_at").alias("posted_at"), "image_hash")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "profit_finder": _search(BASE),
        "profit_page2": _search(ProfitQuery(tx=3, limit=120)),
        "profit_search": _search(ProfitQuery(tx=0, roi=-1000, psaMax=None, q="Brand#1")),
        "profit_hidden": _search(ProfitQuery(tx=0, roi=-1000, psaMax=None, hide=("valuable",), sort="profit-asc")),
        "profit_ranges": _search(ProfitQuery(tx=2, txMax=9, psaTx=1, psaTxMax=8, roi=10, psaMin=20000, priceMin=20000, priceMax=60000, sort="price-asc")),
        "profit_all": profit_all,
        "profit_decisions": profit_decisions,
        "profit_header_stats": profit_header,
        "publish_sort": publish_sort,
        "stock_retention": stock_grid,
        "stock_decrease": stock_summary,
        "stock_demand": lambda spark, d: stock_summary(spark, d).groupBy("demand").agg(F.count("*").alias("n")),
        "stock_current": stock_current,
        "stock_to_check": stock_to_check,
        "stock_recorded": stock_recorded,
        "stock_history_file": stock_history_file,
        "run_counts": run_counts,
        "profit_week": _search(ProfitQuery(tx=0, tx7=1, tx7Max=8, psaTx7=0, psaTx7Max=2, roi=-1000, psaMax=None, sort="tx7-desc")),
        "profit_search_label": _search(ProfitQuery(tx=0, roi=-1000, psaMax=None, q="様子見", sort="roi-asc")),
        "loose_text": loose_text,
        "catalog_merge": catalog_merge,
        "carry_forward": carry_forward,
        "dead_link_state": dead_links,
        "link_state": link_state,
        "link_due": link_due,
        "link_preserve": link_keep,
        "buylist_dedupe": _on_listings(buylist.dedupe),
        "buylist_daily": _on_listings(buylist.daily),
        "buylist_window_7": _on_listings(lambda x: buylist.window(x, 7, "2024-01-31 00:00:00")),
        "buylist_window_all": _on_listings(lambda x: buylist.window(x, None, "")),
        "buylist_window_30": _on_listings(lambda x: buylist.window(x, 30, "2024-01-31 00:00:00")),
        "buylist_board": _on_listings(lambda x: buylist.board(x.withColumn("confidence", F.col("price") / 500), "2024-01-31 00:00:00", "click", 1, 2, (5.0, 400.0), "cheap", 0.002)),
        "buylist_trend": _on_listings(lambda x: buylist.trend(x, 7)),
        "buylist_new_posts": new_posts,
        "buylist_vs_avg": _on_listings(buylist.against_mean),
        "buylist_price_changes": _on_listings(buylist.price_changes),
        "page_headings": page_headings,
        "page_links": page_links,
        "page_counts": page_counts,
    }
    for m in MEASURES:
        for way in ("asc", "desc"):
            out[f"profit_sort_{m}_{way}"] = _search(ProfitQuery(tx=1, roi=-1000, psaMax=None, sort=f"{m}-{way}"))
    return out | market.queries() | runs.queries() | served.queries()


def oracle_sql() -> dict[str, str]:
    all_cards = CALC_SQL + SHOWN_SQL
    out = {
        "profit_finder": all_cards + BASE_SQL + "ORDER BY roi DESC NULLS LAST, pos LIMIT 60",
        "profit_page2": all_cards + BASE_SQL + "ORDER BY roi DESC NULLS LAST, pos LIMIT 120",
        "profit_search": all_cards + "WHERE roi >= -1000 AND psa10 >= 0 AND (contains(lower(name || ' ' || model), 'brand#1') OR contains(regexp_replace(lower(name || ' ' || model), '[^0-9a-z]', '', 'g'), 'brand1')) ORDER BY roi DESC NULLS LAST, pos LIMIT 60",
        "profit_hidden": all_cards + "WHERE roi >= -1000 AND psa10 >= 0 AND decision <> 'valuable' ORDER BY profit ASC NULLS LAST, pos LIMIT 60",
        "profit_ranges": all_cards + "WHERE tx BETWEEN 2 AND 9 AND ptx BETWEEN 1 AND 8 AND roi >= 10 AND psa10 BETWEEN 20000 AND 200000 AND price BETWEEN 20000 AND 60000 ORDER BY coalesce(price, 0), pos LIMIT 60",
        "profit_all": CALC_SQL + 'SELECT id, name, price, psa10, profit, roi, decision, CASE WHEN roi >= 120 THEN \'good\' WHEN roi >= 80 THEN \'sky\' ELSE \'warn\' END AS roi_class, CASE WHEN roi IS NOT NULL THEN greatest(8e0, least(100e0, roi)) END AS bar_width, tx AS "saleTx30d", tx7 AS "saleTx7d", ptx AS "psaTx30d", ptx7 AS "psaTx7d" FROM found',
        "profit_decisions": CALC_SQL + "SELECT decision, CASE decision WHEN 'missing' THEN '未取得' WHEN 'valuable' THEN '出す価値あり' WHEN 'watch' THEN '様子見' ELSE '出さない' END AS decision_label, count(*) AS n FROM found GROUP BY decision",
        "profit_header_stats": CALC_SQL + f", b AS (SELECT * FROM found {BASE_SQL}), f AS (SELECT * FROM b ORDER BY roi DESC NULLS LAST, pos LIMIT 1) SELECT (SELECT count(*) FROM found) AS n_total, (SELECT count(*) FROM b) AS n_found, (SELECT max(roi) FROM b) AS max_roi, (SELECT max(profit) FROM b) AS max_profit, (SELECT CAST(floor(roi + 0.5e0) AS BIGINT) FROM f) AS first_roi, (SELECT CAST(floor(profit + 0.5e0) AS BIGINT) FROM f) AS first_profit",
        "publish_sort": "WITH " + CARDS_SQL + " SELECT id, tv30, price, row_number() OVER (ORDER BY coalesce(tv30, 0) DESC, coalesce(price, 0) DESC, pos) AS place FROM cards",
        "stock_retention": GRID_SQL + " SELECT card_id, CAST(date_pos AS INTEGER) AS date_pos, obs_date, stock FROM grid",
        "stock_decrease": STOCK_SQL,
        "stock_current": f"SELECT * FROM ({STOCK_SQL}) WHERE card_id IN (SELECT p_partkey FROM part)",
        "stock_to_check": "SELECT c_custkey AS card_id, c_name AS url, c_custkey AS pos FROM customer WHERE c_nationkey <> 4 AND c_custkey NOT IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-29')",
        "stock_recorded": "WITH n AS (SELECT c_custkey AS card_id, DATE '2024-01-29' AS obs_date, CAST(c_nationkey AS DOUBLE) AS stock FROM customer WHERE c_acctbal > 0) SELECT * FROM n UNION ALL SELECT user_id, CAST(ts AS DATE), CAST(count(*) AS DOUBLE) FROM events WHERE NOT (CAST(ts AS DATE) = DATE '2024-01-29' AND user_id IN (SELECT card_id FROM n)) GROUP BY 1, 2",
        "stock_history_file": GRID_SQL + " SELECT card_id, '[' || string_agg(coalesce(CAST(stock AS VARCHAR), 'null'), ',' ORDER BY date_pos) || ']' AS stocks FROM grid GROUP BY card_id",
        "run_counts": f"SELECT count(*) FILTER (WHERE outcome = 'ok') AS checked, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'invalid') AS broken, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM ({DEAD_SQL})",
        "profit_week": all_cards + "WHERE tx7 BETWEEN 1 AND 8 AND ptx7 BETWEEN 0 AND 2 AND roi >= -1000 AND psa10 >= 0 ORDER BY tx7 DESC, pos LIMIT 60",
        "profit_search_label": all_cards + "WHERE roi >= -1000 AND psa10 >= 0 AND decision = 'watch' ORDER BY roi, pos LIMIT 60",
        "stock_demand": f"SELECT demand, count(*) AS n FROM ({STOCK_SQL}) GROUP BY demand",
        "loose_text": LOOSE_SQL,
        "catalog_merge": MERGE_SQL,
        "carry_forward": "SELECT CAST(p_partkey AS VARCHAR) AS id, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS link FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey",
        "dead_link_state": DEAD_SQL,
        "link_state": STATE_SQL,
        "link_due": DUE_SQL,
        "link_preserve": KEEP_SQL,
        "buylist_dedupe": EVENTS_SQL + "SELECT shop, card, price, CAST(posted_at AS DATE) AS day, arg_min(listing_id, (posted_at, listing_id)) AS listing_id, count(*) AS n_posts FROM e GROUP BY shop, card, price, day",
        "buylist_daily": EVENTS_SQL + "SELECT shop, card, CAST(posted_at AS DATE) AS day, count(*) AS n, min(price) AS price_min, max(price) AS price_max, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS price_avg FROM e GROUP BY shop, card, day",
        "buylist_window_7": WINDOW_SQL.format("WHERE posted_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"),
        "buylist_window_all": WINDOW_SQL.format(""),
        "buylist_window_30": WINDOW_SQL.format("WHERE posted_at > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY"),
        "buylist_board": EVENTS_SQL + ", h AS (SELECT * FROM e WHERE price / 500 >= 0.002e0)" + VS_AVG_SQL.replace("FROM e", "FROM h") + ", c AS (SELECT card, shop, count(*) FILTER (WHERE posted_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS n7, count(*) FILTER (WHERE posted_at > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS n30, max(posted_at) AS last_seen FROM h GROUP BY card, shop) SELECT * FROM v JOIN c USING (card, shop) WHERE n7 >= 1 AND n30 >= 2 AND shop = 'click' AND avg BETWEEN 5 AND 400 AND price_label = 'cheap'",
        "buylist_trend": EVENTS_SQL + ", t AS (SELECT shop, card, CAST(posted_at AS DATE) AS day, count(*) AS n, min(price) AS price_min, max(price) AS price_max, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS price_avg FROM e WHERE card = 7 GROUP BY shop, card, day) SELECT *, price_avg - lag(price_avg) OVER (PARTITION BY shop ORDER BY day) AS change FROM t",
        "buylist_new_posts": "WITH e AS (SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) || '-' || event_type AS post_id, ts, event_id, CASE WHEN value > 5 THEN CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) END AS image_hash FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ts, event_id) AS n FROM e), i AS (SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY ts, event_id) AS m FROM o WHERE n = 1) SELECT post_id, ts AS posted_at, image_hash FROM i WHERE m = 1 OR image_hash IS NULL",
        "buylist_vs_avg": EVENTS_SQL + VS_AVG_SQL + " SELECT * FROM v",
        "buylist_price_changes": EVENTS_SQL + ", w AS (SELECT *, lag(price) OVER (PARTITION BY shop, card, CAST(posted_at AS DATE) ORDER BY posted_at, listing_id) AS before FROM e) SELECT listing_id, shop, card, before, price FROM w WHERE before IS NOT NULL AND before <> price",
        "page_headings": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages",
        "page_links": "SELECT page_id, n - 1 AS place, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages))",
        "page_counts": "SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN greatest(page_id, 1) ELSE coalesce(list_max(list_transform(regexp_extract_all(url || '\"' || html, '[?&]page=([0-9]+)', 1), lambda x: TRY_CAST(x AS INTEGER))), 1) END AS INTEGER) AS n FROM pages",
    }
    for m in MEASURES:
        for way in ("asc", "desc"):
            out[f"profit_sort_{m}_{way}"] = all_cards + f"WHERE tx >= 1 AND roi >= -1000 AND psa10 >= 0 ORDER BY {SQL_ORDER[m]} {way} NULLS LAST, pos LIMIT 60"
    return out | market.oracle_sql(STOCK_SQL, CALC_SQL) | runs.oracle_sql(STOCK_SQL, out["buylist_new_posts"]) | served.oracle_sql(CALC_SQL, NORMAL_SQL)
