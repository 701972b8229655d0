"""Queries over state that runs carry on: streams, daily price states, stock rings; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.operators import buylist, stock
from gradewise.sources import sinks
from gradewise.sources.cards import table
from gradewise.sources.shared import cut, shared_folder
from gradewise.streaming import links
from gradewise.streaming.buylist import unseen
from gradewise.streaming.state import append_available

NOW = "2024-01-31 00:00:00"


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files. A stream's path is a folder or a pattern, and the table may be
    one file, so the path is a pattern that only the table fits."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def run_to_end(rows: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there, read from where it was appended."""
    spark, base = rows.sparkSession, shared_folder(rows.sparkSession, name)
    append_available(rows, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def buylist_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of postings, of which several share an id or an image."""
    e = stream_of(spark, d, "events")
    post = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"), "event_type")
    posts = e.select(post.alias("post_id"), F.col("ts").alias("posted_at"), F.when(F.col("value") > 5, F.floor(F.col("value") * 10).cast("string")).alias("image_hash"), "event_id")
    return run_to_end(unseen(posts, ties="event_id"), "postings").select("post_id", "posted_at", "image_hash")


def link_stream(spark: SparkSession, d: str) -> DataFrame:
    """Seven runs over the links of line items to their suppliers' pages; a page is found by some runs only."""
    k, run = F.col("l_suppkey"), F.col("l_linenumber")
    found = stream_of(spark, d, "lineitem").select(
        F.concat(F.lit("s"), k.cast("string")).alias("url"), run.cast("bigint").alias("run"), ((k * 7 + run * 3) % 4 > 1).alias("seen"),
        F.when((k + run) % 5 == 0, "B").otherwise("A").alias("state"), F.when(k % 7 != 0, k.cast("double")).alias("stock"),
    )
    return run_to_end(links.outcomes(found), "links")


LINK_STREAM_SQL = """WITH r AS (SELECT DISTINCT l_suppkey AS k, CAST(l_linenumber AS BIGINT) AS run FROM lineitem),
s AS (SELECT *, (k * 7 + run * 3) % 4 > 1 AS seen FROM r), g AS (SELECT *, count(*) FILTER (WHERE seen) OVER (PARTITION BY k ORDER BY run) AS g FROM s),
m AS (SELECT *, CAST(count(*) FILTER (WHERE NOT seen) OVER (PARTITION BY k, g ORDER BY run) AS INTEGER) AS misses FROM g),
o AS (SELECT *, CASE WHEN NOT seen THEN CASE WHEN misses >= 2 THEN 'invalid' ELSE 'missed' END WHEN (k + run) % 5 = 0 THEN 'rejected' WHEN k % 7 = 0 THEN 'unknown' ELSE 'ok' END AS outcome FROM m)
SELECT 's' || k AS url, run, outcome, misses, CASE WHEN outcome = 'ok' THEN CAST(k AS DOUBLE) END AS stock FROM o"""


def listings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("shop"), F.col("user_id").alias("card"), F.col("value").alias("price"), F.col("ts").alias("posted_at"))


def buylist_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of 7, 30 and all days from the states of two halves of the events, merged."""
    e = listings(spark, d)
    states = [buylist.price_days(e.where(c), NOW) for c in ("card % 2 = 0", "card % 2 = 1")]
    return buylist.window_medians(buylist.merged_days(*states))


_PART = "count(price) FILTER ({0}) AS n{1}, quantile_cont(price, 0.5) FILTER ({0}) AS median{1}"
MEDIANS_SQL = f"""WITH e AS (SELECT event_type AS shop, user_id AS card, value AS price, ts AS posted_at FROM events WHERE ts <= TIMESTAMP '{NOW}')
SELECT shop, card, CAST(grouping(shop) AS INTEGER) AS all_shops, max(posted_at) AS last_seen, {", ".join(_PART.format(c, n) for c, n in ((f"WHERE posted_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY", "7"), (f"WHERE posted_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY", "30"), ("WHERE true", "_all")))}
FROM e GROUP BY GROUPING SETS ((shop, card), (card))"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("card_id"), F.to_date("ts").alias("obs_date")).agg(F.count("*").cast("double").alias("stock"))


def stock_ring(spark: SparkSession, d: str) -> DataFrame:
    """Summaries from rings: the history but for the last three runs, and these runs one by one."""
    obs = observations(spark, d)
    last = [r["obs_date"] for r in obs.select("obs_date").distinct().orderBy(F.desc("obs_date")).limit(3).collect()][::-1]
    rings = stock.ring_of(obs.where(F.col("obs_date") < F.lit(last[0])) if last else obs)
    for day in last:
        rings = stock.advanced(cut(rings), obs.where(F.col("obs_date") == F.lit(day)), str(day))
    return stock.ring_summary(rings)


def catalog_fresh(spark: SparkSession, d: str) -> DataFrame:
    """A run that takes only what the catalog observed on its day; some URLs have an older row, too."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    url = F.concat(F.lit("s"), k.cast("string")).alias("url")
    row = lambda pos, state, stock_, at: (url, F.lit(pos).alias("pos"), state.alias("state"), stock_.alias("stock"), at.cast("date").alias("observed_at"))
    newer = s.where(k % 4 != 0).select(*row(1, F.when(k % 5 == 0, "B").otherwise("A"), F.when(k % 7 != 0, k.cast("double")), F.when(k % 3 == 0, "2026-08-21").otherwise("2026-08-22")))
    older = s.where(k % 2 == 0).select(*row(0, F.lit("C"), F.lit(0.0), F.lit("2026-08-22")))
    cards = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("url"))
    return stock.catalog_run(cards, newer.unionByName(older), s.where(k % 6 == 0).select(url, F.lit(1).alias("misses")), "2026-08-22", fresh_only=True)


FRESH_SQL = """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS card_id, l_suppkey AS k FROM lineitem), g AS (SELECT *, k % 4 <> 0 AND k % 3 = 0 AS gone FROM l)
SELECT card_id, 's' || k AS url, CASE WHEN gone AND k % 6 = 0 THEN 'invalid' WHEN gone THEN 'missed' WHEN k % 4 = 0 OR k % 5 = 0 THEN 'rejected' WHEN k % 7 = 0 THEN 'unknown' ELSE 'ok' END AS outcome,
  CASE WHEN gone THEN NULL WHEN k % 4 = 0 THEN 0e0 WHEN k % 7 <> 0 THEN CAST(k AS DOUBLE) END AS stock, CAST(CASE WHEN gone THEN CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END END AS INTEGER) AS misses_next FROM g"""


def to_check_one(spark: SparkSession, d: str) -> DataFrame:
    """The one card of a repair run, if it is linked and not yet observed that day."""
    cards = table(spark, d, "customer").where("c_nationkey <> 4").select(F.col("c_custkey").alias("card_id"), F.col("c_name").alias("url"), F.col("c_custkey").alias("pos"))
    return stock.to_check(cards, observations(spark, d), "2024-01-29", only="149")


TO_CHECK_ONE_SQL = "SELECT c_custkey AS card_id, c_name AS url, c_custkey AS pos FROM customer WHERE c_nationkey <> 4 AND c_custkey = 149 AND c_custkey NOT IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-29')"


def stock_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The summaries as the second of two published runs left them, read from the current set."""
    obs, folder = observations(spark, d), shared_folder(spark, "stock")
    sinks.publish_run(folder, "2024-01-28", summary=stock.summary(stock.placed(obs.where("obs_date < DATE '2024-01-29'"))), cards=obs.select("card_id").distinct())
    now = stock.summary(stock.placed(obs))
    sinks.publish_run(folder, "2024-01-30", summary=now, cards=obs.select("card_id").distinct())
    out = sinks.read_run(spark, folder, "summary", now.schema)
    return out.join(sinks.read_run(spark, folder, "cards", obs.select("card_id").schema), "card_id", "left_semi")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "buylist_stream": buylist_stream,
        "link_stream": link_stream,
        "buylist_medians": buylist_medians,
        "stock_ring": stock_ring,
        "catalog_fresh": catalog_fresh,
        "stock_to_check_one": to_check_one,
        "stock_outputs": stock_outputs,
    }


def oracle_sql(stock_sql: str, posts_sql: str) -> dict[str, str]:
    return {
        "buylist_stream": posts_sql,
        "link_stream": LINK_STREAM_SQL,
        "buylist_medians": MEDIANS_SQL,
        "stock_ring": stock_sql,
        "catalog_fresh": FRESH_SQL,
        "stock_to_check_one": TO_CHECK_ONE_SQL,
        "stock_outputs": stock_sql,
    }
