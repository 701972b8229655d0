"""Buy-list postings: de-duplication, daily and window statistics, labels against the mean.

Medians are exact selections over mergeable state: how often each price was posted in each day of 24
hours that ends at the time of the daily run. Days add up to windows of any length, so the state of a day is made once
and one pass over it gives all windows. The place of a median is looked for in a coarse histogram
first, with a few bins to each power of 2; only the prices of its bins are then ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.functions.numbers import size_bin

#: Days of the windows; None is all days.
WIDTHS = (7, 30, None)


def new_posts(posts: DataFrame) -> DataFrame:
    """Each post once, and of posts that share an image only the first: (post_id, posted_at, image_hash)."""
    once = posts.groupBy("post_id").agg(F.min_by(F.struct(*[c for c in posts.columns if c != "post_id"]), F.struct("posted_at", "image_hash")).alias("p")).select("post_id", "p.*")
    # Posts without an image pass by: as a key of their own they would all be in one task.
    values = [c for c in once.columns if c != "image_hash"]
    pictured = once.where("image_hash IS NOT NULL").groupBy("image_hash").agg(F.min_by(F.struct(*values), F.struct("posted_at", "post_id")).alias("p"))
    return pictured.select("p.*", "image_hash").select(*once.columns).unionByName(once.where("image_hash IS NULL"))


def dedupe(listings: DataFrame) -> DataFrame:
    """One listing for each shop, card, price and day: the first one."""
    return listings.groupBy("shop", "card", "price", F.to_date("posted_at").alias("day")).agg(F.min_by("listing_id", F.struct("posted_at", "listing_id")).alias("listing_id"), F.count("*").alias("n_posts"))


def daily(listings: DataFrame) -> DataFrame:
    return listings.groupBy("shop", "card", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("n"), F.min("price").alias("price_min"), F.max("price").alias("price_max"), (F.sum("cents") / F.count("*") / 100).alias("price_avg"))


def price_days(listings: DataFrame, now: str) -> DataFrame:
    """The daily state (shop, card, age, price, n, last_seen): how often each price was posted in each
    day of 24 hours; the one that ends ``now`` has age 0, and later postings don't count. States of
    parts of the listings are merged by adding ``n`` and taking the latest ``last_seen``."""
    old = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("posted_at").cast("timestamp"))
    age = F.call_function("div", old, F.lit(86_400_000_000)).cast("int")
    return listings.where(old >= 0).groupBy("shop", "card", age.alias("age"), "price").agg(F.count("*").alias("n"), F.max("posted_at").alias("last_seen"))


def merged_days(*states: DataFrame) -> DataFrame:
    """One daily state of several of the same ``now``."""
    return reduce(DataFrame.unionByName, states).groupBy("shop", "card", "age", "price").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))


def medians(days: DataFrame, keys: list[str], widths: tuple[int | None, ...] = WIDTHS) -> DataFrame:
    """(keys, n<width>, median<width> for each width in days, ``_all`` without one) of a daily state (age,
    price, n and the keys). A width without postings has 0 and null; null prices count but aren't ordered."""
    names = ["_all" if w is None else str(w) for w in widths]
    weight = [F.sum(F.when(F.lit(True) if w is None else F.col("age") < w, F.col("n")).otherwise(0)) for w in widths]
    values = days.groupBy(*keys, "price").agg(*[c.alias(f"n{x}") for c, x in zip(weight, names, strict=True)]).withColumn("bin", size_bin(F.col("price")))
    priced = lambda x: F.when(F.col("price").isNotNull(), F.col(f"n{x}")).otherwise(0)
    bins = values.groupBy(*keys, "bin").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in names], *[F.sum(priced(x)).alias(f"p{x}") for x in names])
    key, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({f"of{x}": F.sum(f"p{x}").over(key) for x in names} | {f"before{x}": F.coalesce(F.sum(f"p{x}").over(order), F.lit(0)) for x in names} | {f"all{x}": F.sum(f"n{x}").over(key) for x in names})
    # The two middle places, from 0; of an odd count they are one.
    low, high = lambda x: F.floor((F.col(f"of{x}") - 1) / 2), lambda x: F.floor(F.col(f"of{x}") / 2)
    hit = lambda x: (F.col(f"p{x}") > 0) & (F.col(f"before{x}") <= high(x)) & (F.col(f"before{x}") + F.col(f"p{x}") > low(x))
    some = bins.where(reduce(Column.__or__, map(hit, names)))
    held = some.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("bin").alias("k_bin"), *[f"{c}{x}" for x in names for c in ("of", "before")])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    inside = values.where("price IS NOT NULL").join(held, same & (F.col("bin") == F.col("k_bin")))
    within = Window.partitionBy(*keys, "bin").orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.withColumns({f"at{x}": F.col(f"before{x}") + F.coalesce(F.sum(f"n{x}").over(within), F.lit(0)) for x in names})
    holds = lambda x, place: (F.col(f"at{x}") <= place) & (F.col(f"at{x}") + F.col(f"n{x}") > place)
    ends = [F.max(F.when(holds(x, f(x)), F.col("price"))).alias(f"{c}{x}") for x in names for c, f in (("low", low), ("high", high))]
    middle = placed.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(*ends)
    counted = bins.groupBy(*keys).agg(*[F.max(f"all{x}").alias(f"n{x}") for x in names])
    out = counted.join(middle, same, "left")
    return out.select(*keys, *[c for x in names for c in (f"n{x}", (F.col(f"low{x}") * 0.5 + F.col(f"high{x}") * 0.5).alias(f"median{x}"))])


def window_medians(days: DataFrame) -> DataFrame:
    """Counts and medians of 7, 30 and all days of a daily state, by shop and card and over all shops
    (shop is null, all_shops 1), with the last posting."""
    both = days.withColumn("all_shops", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("shop", F.when(F.col("all_shops") == 0, F.col("shop")))
    keys = ["shop", "card", "all_shops"]
    merged = both.groupBy(*keys, "age", "price").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))
    last = merged.groupBy(*[F.col(k).alias(f"l_{k}") for k in keys]).agg(F.max("last_seen").alias("last_seen"))
    return medians(merged, keys).join(last, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys])).drop(*[f"l_{k}" for k in keys])


def window(listings: DataFrame, days: int | None, now: str) -> DataFrame:
    """count, last seen and median price by shop and card, and over all shops (shop is null), of the
    last ``days`` days or of all."""
    end = F.lit(now).cast("timestamp")
    kept = listings if days is None else listings.where((F.col("posted_at") > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("posted_at") <= end))
    both = kept.select("shop", "card", "price", "posted_at", F.explode(F.array(F.lit(0), F.lit(1))).alias("all_shops")).withColumn("shop", F.when(F.col("all_shops") == 0, F.col("shop")))
    keys = ["shop", "card", "all_shops"]
    counts = both.groupBy(*keys, "price").agg(F.count("*").alias("n"), F.max("posted_at").alias("last_seen"))
    last = counts.groupBy(*[F.col(k).alias(f"l_{k}") for k in keys]).agg(F.max("last_seen").alias("last_seen"))
    found = medians(counts.withColumn("age", F.lit(0)), keys, (None,))
    out = found.join(last, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys]))
    return out.select("shop", "card", F.col("all_shops").cast("tinyint").alias("all_shops"), F.col("n_all").alias("n"), "last_seen", F.col("median_all").alias("price_median"))


def against_mean(listings: DataFrame, cheap: float = -10.0, dear: float = 10.0, many: int = 10) -> DataFrame:
    """Each shop's mean price of a card against the mean of all shops, with the difference, the least,
    largest and median price of all shops, and labels."""
    by_shop = listings.groupBy("card", "shop").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    of_all = listings.groupBy("card").agg(F.sum("cents").alias("all_cents"), F.count("*").alias("n_all"), F.min("price").alias("price_min"), F.max("price").alias("price_max"))
    middle = medians(listings.groupBy("card", "price").agg(F.count("*").alias("n")).withColumn("age", F.lit(0)), ["card"], (None,))
    out = by_shop.join(of_all, "card").join(middle.select("card", F.col("median_all").alias("price_median")), "card").select("card", "shop", "n", (F.col("cents") / F.col("n") / 100).alias("avg"), (F.col("all_cents") / F.col("n_all") / 100).alias("avg_all"), "price_min", "price_max", "price_median")
    out = out.withColumn("difference", F.col("avg") - F.col("avg_all")).withColumn("pct", F.col("difference") / F.col("avg_all") * 100)
    return out.withColumn("price_label", F.when(F.col("pct") <= cheap, "cheap").when(F.col("pct") >= dear, "expensive").otherwise("average")).withColumn("count_label", F.when(F.col("n") >= many, "many").otherwise("few"))


def board(listings: DataFrame, now: str, shop: str | None = None, least7: int = 0, least30: int = 0, prices: tuple[float, float] | None = None, label: str | None = None, confidence: float | None = None) -> DataFrame:
    """Counts of the last 7 and 30 days and all days by shop and card, with the comparison of
    ``against_mean``, filtered by shop, counts, mean price, label, and confidence of the listings."""
    held = listings if confidence is None else listings.where(F.col("confidence") >= confidence)
    since = lambda d: F.count_if(F.col("posted_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {d} DAYS"))
    counts = held.groupBy("card", "shop").agg(since(7).alias("n7"), since(30).alias("n30"), F.max("posted_at").alias("last_seen"))
    out = against_mean(held).join(counts, ["card", "shop"]).where((F.col("n7") >= least7) & (F.col("n30") >= least30))
    out = out if shop is None else out.where(F.col("shop") == shop)
    out = out if prices is None else out.where(F.col("avg").between(*prices))
    return out if label is None else out.where(F.col("price_label") == label)


def trend(listings: DataFrame, card) -> DataFrame:
    """One card's daily mean by shop, with the change since the shop's day before."""
    days = daily(listings.where(F.col("card") == card))
    return days.withColumn("change", F.col("price_avg") - F.lag("price_avg").over(Window.partitionBy("shop").orderBy("day"))).orderBy("shop", "day")


def price_changes(listings: DataFrame) -> DataFrame:
    """Listings whose price differs from the one before of the same shop and card on that day."""
    w = Window.partitionBy("shop", "card", F.to_date("posted_at")).orderBy("posted_at", "listing_id")
    return listings.withColumn("before", F.lag("price").over(w)).where("before IS NOT NULL AND before <> price").select("listing_id", "shop", "card", "before", "price")
