"""Stock histories: run positions, daily decrease, demand, and outcomes of a run.

The summary reads the observations as they are: pairs of neighbouring positions are made by a window
over a card, and the conditional means of the three widths share one aggregation on the same key, so
there is one shuffle by card. The dense grid of all positions is made for export only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTHS = (7, 30, 90)
RETAINED = 91
#: Demand by least mean decrease over 30 positions, and least samples.
DEMAND = [("high", 1.0), ("normal", 0.2)]
MIN_SAMPLES = 3
DEMAND_LABELS = {"high": "買う人が多い", "normal": "普通", "low": "少ない", "pending": "蓄積中"}
#: Misses in so many runs make a link invalid.
MISSES = 2


def axis(observations: DataFrame, retained: int = RETAINED) -> DataFrame:
    """(obs_date, date_pos, last): the last ``retained`` dates on which there was a run, in order. They
    are few, and their number is bounded."""
    dates = observations.select("obs_date").distinct().orderBy(F.desc("obs_date")).limit(retained)
    placed = dates.withColumn("date_pos", F.row_number().over(Window.orderBy("obs_date")) - 1)
    return F.broadcast(placed.withColumn("last", F.max("date_pos").over(Window.partitionBy())))


def placed(observations: DataFrame, retained: int = RETAINED) -> DataFrame:
    """Observations with their position and the last one; those before the retained dates have none."""
    return observations.join(axis(observations, retained), "obs_date", "left")


def history(observations: DataFrame, retained: int = RETAINED) -> DataFrame:
    """(card_id, obs_date, stock) to the dense grid (card_id, date_pos, obs_date, stock) of the last
    ``retained`` dates, for export: a row for each card and date."""
    dates = axis(observations, retained)
    series = observations.groupBy("card_id").agg(F.map_from_entries(F.collect_list(F.struct("obs_date", "stock"))).alias("series"))
    every = F.broadcast(dates.agg(F.array_sort(F.collect_list(F.struct("date_pos", "obs_date"))).alias("dates")))
    # One row holds all dates, so this only adds an array to each card.
    return series.join(every).select("card_id", "series", F.inline("dates")).select("card_id", "date_pos", "obs_date", F.col("series")[F.col("obs_date")].alias("stock"))


def summary(grid: DataFrame) -> DataFrame:
    """card_id, stock at the last position, avg7, avg30, avg90, samples, demand and its label, of
    (card_id, date_pos, stock, last), with a row for each observation or each position; without
    ``last`` a card's own last position counts. A decrease needs observations at neighbouring positions."""
    card = Window.partitionBy("card_id")
    w = card.orderBy("date_pos")
    last = F.col("last") if "last" in grid.columns else F.max("date_pos").over(card)
    before = F.when(F.lag("date_pos").over(w) == F.col("date_pos") - 1, F.lag("stock").over(w))
    pairs = grid.withColumns({"drop": F.when(before.isNotNull() & F.col("stock").isNotNull(), F.greatest(F.lit(0.0), before - F.col("stock"))), "last": last})
    mean = lambda n: F.avg(F.when(F.col("date_pos") > F.col("last") - n, F.col("drop")))
    out = pairs.groupBy("card_id").agg(
        F.max(F.when(F.col("date_pos") == F.col("last"), F.col("stock"))).alias("stock"),
        *[(F.floor(mean(n) * 100 + 0.5) / 100).alias(f"avg{n}") for n in WIDTHS],
        F.count(F.when(F.col("date_pos").isNotNull(), F.col("stock"))).alias("samples"),
    )
    return with_demand(out)


def with_demand(averages: DataFrame) -> DataFrame:
    """Adds demand and its label to avg30 and samples."""
    demand = F.when((F.col("samples") < MIN_SAMPLES) | F.col("avg30").isNull(), "pending")
    for name, least in DEMAND:
        demand = demand.when(F.col("avg30") >= least, name)
    out = averages.withColumn("demand", demand.otherwise("low"))
    return out.withColumn("demand_label", F.element_at(F.create_map(*[F.lit(x) for kv in DEMAND_LABELS.items() for x in kv]), F.col("demand")))


def ring_of(observations: DataFrame, retained: int = RETAINED) -> DataFrame:
    """The state of a run (card_id, run_date, ring): each card's values at the last ``retained`` run dates,
    the newest last, null where there was none, up to ``run_date``; rings are shorter while there
    were fewer runs. It is made from the history once; ``advanced`` carries it on."""
    dates = axis(observations, retained)
    n = F.broadcast(dates.agg(F.count("*").cast("int").alias("n"), F.max("obs_date").alias("run_date")))
    at = observations.join(dates, "obs_date", "left").where("stock IS NOT NULL")
    held = at.groupBy("card_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("date_pos").isNotNull(), F.struct("date_pos", "stock")))).alias("at"))
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("at")[i])
    return held.join(n).select("card_id", "run_date", cells.alias("ring"))


def advanced(rings: DataFrame, run: DataFrame, run_date: str, retained: int = RETAINED) -> DataFrame:
    """The rings after a run (card_id, stock) of ``run_date``. A later date than that of the rings shifts
    each by one place; the same date, as of a run that is sent again, replaces the last place where
    the run has a value; an earlier date changes nothing. A card that is new has a ring of its own
    length, as places before it count as null. The rings should be a stored table: their date is read
    first, and then there is one join by card; nothing else of the history is read."""
    day, at = date.fromisoformat(run_date), rings.agg(F.max("run_date").alias("at")).first()["at"]
    if at is not None and day < at:
        return rings
    new = run.where("stock IS NOT NULL").groupBy("card_id").agg(F.max("stock").alias("new"))
    ring = F.coalesce("ring", F.array().cast("array<double>"))
    if day == at:
        out = F.concat(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.array(F.coalesce("new", F.try_element_at(ring, F.lit(-1)))))
    else:
        longer = F.concat(ring, F.array("new"))
        out = F.when(F.size(longer) > retained, F.slice(longer, 2, retained)).otherwise(longer)
    return rings.select("card_id", "ring").join(new, "card_id", "full").select("card_id", F.lit(day).alias("run_date"), out.alias("ring"))


def ring_summary(rings: DataFrame) -> DataFrame:
    """What ``summary`` gives, from each card's ring alone, without a shuffle."""
    size = F.size("ring")
    pairs = F.zip_with(F.slice("ring", F.lit(1), size - 1), F.slice("ring", F.lit(2), size - 1), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), a - b)))
    with_drops = rings.withColumn("drops", F.when(size > 1, pairs).otherwise(F.array().cast("array<double>")))

    def mean(n: int) -> Column:
        last = F.slice("drops", F.greatest(F.size("drops") - n + 1, F.lit(1)), F.lit(n))
        some = F.filter(last, lambda x: x.isNotNull())
        return F.when(F.size(some) > 0, F.floor(F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some) * 100 + 0.5) / 100)

    out = with_drops.select("card_id", F.element_at("ring", -1).alias("stock"), *[mean(n).alias(f"avg{n}") for n in WIDTHS], F.size(F.filter("ring", lambda x: x.isNotNull())).cast("bigint").alias("samples"))
    return with_demand(out)


def current_summary(cards: DataFrame, observations: DataFrame) -> DataFrame:
    """The summaries of the cards that there are now; the series of others stay in the history."""
    return summary(placed(observations)).join(cards.select(F.col("id").alias("card_id")).distinct(), "card_id", "left_semi")


def with_summary(cards: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cards with stock, averages and demand, which is pending where there is no summary."""
    out = cards.join(summaries.withColumnRenamed("card_id", "id"), "id", "left")
    return out.withColumn("demand", F.coalesce("demand", F.lit("pending"))).withColumn("demand_label", F.coalesce("demand_label", F.lit(DEMAND_LABELS["pending"])))


def to_check(links: DataFrame, observations: DataFrame, today: str, only: str | None = None, batch: int = 0) -> DataFrame:
    """The linked cards (card_id, url, pos) not observed today, of one id if given, the first ``batch`` of
    all linked ones if positive."""
    out = links.where("url IS NOT NULL AND url <> ''")
    out = out.where(F.col("card_id").cast("string") == only) if only else out
    out = out.orderBy("pos").limit(batch) if batch > 0 else out
    seen = observations.where((F.col("obs_date") == F.lit(today).cast("date")) & F.col("stock").isNotNull()).select("card_id").distinct()
    return out.join(seen, "card_id", "left_anti")


def recorded(observations: DataFrame, outcomes: DataFrame, today: str) -> DataFrame:
    """The observations with those of a run, which replace others of the same card and day."""
    new = outcomes.where("outcome IN ('ok', 'moved') AND stock IS NOT NULL").select("card_id", F.lit(today).cast("date").alias("obs_date"), "stock")
    return observations.select("card_id", "obs_date", "stock").join(new, ["card_id", "obs_date"], "left_anti").unionByName(new)


def catalog_run(links: DataFrame, catalog: DataFrame, misses: DataFrame, run_date: str, fresh_only: bool = False) -> DataFrame:
    """Outcome of each linked card in a run on the catalog: (card_id, url, outcome, stock,
    misses_next). A URL that several cards share gets one more miss in a run, not one for each. Of
    a URL's rows in the catalog the last one counts (by ``pos``, if there is one). With ``fresh_only`` a
    row that wasn't observed on the day of the run is as if it weren't there."""
    place = F.col("pos") if "pos" in catalog.columns else F.lit(0)
    last = F.max_by(F.struct("state", "stock", "observed_at"), F.struct(place, "observed_at", "state", "stock"))
    seen = catalog.groupBy("url").agg(last.alias("v")).select("url", "v.*")
    if fresh_only:
        seen = seen.where(F.col("observed_at") == F.lit(run_date).cast("date"))
    found = links.join(seen.withColumn("seen", F.lit(True)), "url", "left").join(misses, "url", "left")
    gone = F.col("seen").isNull()
    after = F.when(gone, F.coalesce("misses", F.lit(0)) + 1)
    outcome = (
        F.when(gone & (after >= MISSES), "invalid").when(gone, "missed").when(F.upper(F.coalesce("state", F.lit("A"))) != "A", "rejected").when(F.col("stock").isNull(), "unknown").otherwise("ok")
    )
    return found.select("card_id", "url", outcome.alias("outcome"), "stock", after.cast("int").alias("misses_next"))


def next_state(outcomes: DataFrame, invalid: DataFrame, recheck: DataFrame, misses: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next (misses, invalid URLs, cards to recheck) after a run. Of the ``misses`` so far those
    of URLs that no card of the run has stay; a URL that was seen loses its count."""
    after = outcomes.where("misses_next IS NOT NULL").groupBy("url").agg(F.max("misses_next").alias("misses"))
    if misses is not None:
        after = after.unionByName(misses.select("url", "misses").join(outcomes.select("url").distinct(), "url", "left_anti"))
    bad = invalid.select("url").union(outcomes.where(F.col("outcome").isin("invalid", "rejected")).select("url")).distinct()
    again = outcomes.where(F.col("outcome") != "ok").select("card_id").union(recheck.select("card_id")).distinct()
    return after, bad, again.join(outcomes.where("outcome = 'ok'").select("card_id").distinct(), "card_id", "left_anti")


def product_run(pages: DataFrame) -> DataFrame:
    """Outcome of each fetched product page (card_id, url, http_status, valid, product_url, state, stock):
    (card_id, url, outcome, moved, next_url, stock). A page that moved can also be of another state."""
    status = F.col("http_status")
    moved = F.coalesce((F.col("product_url") != "") & (F.col("product_url") != F.col("url")), F.lit(False)) & (status < 400) & F.col("valid")
    outcome = (
        F.when(status.isin(404, 410), "invalid")
        .when(status.isNull() | (status >= 400), "failed")
        .when(~F.col("valid"), "invalid")
        .when(F.upper(F.coalesce("state", F.lit("A"))) != "A", "rejected")
        .when(moved, "moved")
        .otherwise("ok")
    )
    out = pages.select("card_id", "url", "product_url", F.coalesce(moved, F.lit(False)).alias("moved"), outcome.alias("outcome"), "stock")
    link = F.when(F.col("outcome").isin("ok", "moved"), F.when(F.col("moved"), F.col("product_url")).otherwise(F.col("url"))).when(F.col("outcome") == "failed", F.col("url"))
    return out.select("card_id", "url", "product_url", "outcome", "moved", link.alias("next_url"), F.when(F.col("outcome").isin("ok", "moved"), F.col("stock")).alias("stock"))


def next_product_state(outcomes: DataFrame, invalid: DataFrame, recheck: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next (invalid URLs, cards to recheck) after a run over product pages: a moved page's old URL
    becomes invalid, and a rejected one's new URL, too; failed pages change nothing."""
    gone = outcomes.where(F.col("outcome").isin("invalid", "rejected") | F.col("moved")).select(F.col("url"))
    new = outcomes.where("outcome = 'rejected' AND moved").select(F.col("product_url").alias("url"))
    bad = invalid.select("url").union(gone).union(new).distinct()
    again = recheck.select("card_id").union(outcomes.where(F.col("outcome").isin("invalid", "rejected")).select("card_id")).distinct()
    return bad, again.join(outcomes.where(F.col("outcome").isin("ok", "moved")).select("card_id"), "card_id", "left_anti")


def run_counts(outcomes: DataFrame) -> DataFrame:
    """One row: how many cards of a run on the catalog were checked, rejected, broken, or failed."""
    n = lambda *which: F.count_if(F.col("outcome").isin(*which))
    return outcomes.agg(n("ok").alias("checked"), n("rejected").alias("rejected"), n("invalid").alias("broken"), n("failed").alias("failed"))


def due(cards: DataFrame, checked: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Cards never checked, or last checked at least ``days`` ago."""
    last = checked.select("card_id", F.try_to_timestamp("checked_at").alias("at"))
    age = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {max(1, days)} DAYS")
    return cards.join(last, "card_id", "left").where(F.col("at").isNull() | (F.col("at") <= age)).drop("at")
