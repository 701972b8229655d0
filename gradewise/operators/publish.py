"""The daily publication: enriched cards, the published view, links to pages, and run metadata.

Addresses of sites are parameters. The enriched relation has all columns, also those that are not
published; the published one is a view of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.functions import text
from gradewise.operators import match, profit


@dataclass(frozen=True)
class Sites:
    """Addresses of the card source, the flea market and the shop."""

    source: str = "https://cards.example"
    market: str = "https://market.example"
    shop: str = "https://shop.example"


# Kinds of product pages on the market, and the fixed part of a search there.
PRODUCT_KINDS = "apparels|trading-cards|products"
SEARCH = "brandId=pokemon&categoryId=25&isUnderRetail=false&keywords="
# The game's name, numbers that are taken over if finite, and the published columns.
GAME = "ポケモン"
MONEY = ("price", "snkPrice", "snkPsa10Price", "snkPsa9Price", "snkPsa10Min", "chg7", "chg30", "tvel", "days", "kaitori", "tLast")
COUNTS = ("snkPsa10Count", "tv7", "tv30", "p10tv7", "p10tv30", "snkListings")
PUBLISHED = (
    "id", "name", "model", "img", "snkUrl", "price", "snkPsa10Price", "snkPsa10Min", "tv7", "tv30", "p10tv7", "p10tv30",
    "chg7", "chg30", "tvel", "days", "tLastAt", "snkListings", "cardrushUrl",
)
ENRICHED = (
    "id", "title", "name", "pageUrl", "model", "variant", "rarity", "psaQuery", "img", "snkrUrl", "price", "snkPrice", "snkPsa10Price", "snkPsa9Price", "snkPsa10Min", "snkPsa10Count",
    "officialPsa10Count", "officialPsaTotal", "officialPsaRate", "tv7", "tv30", "p10tv7", "p10tv30", "chg7", "chg30", "tvel", "days", "kaitori", "tLast", "tLastAt", "rawBacked", "snkListings",
    "cardrushUrl", "cardrushState", "cardrushName",
)


def finite(c: Column) -> Column:
    """A number, null if it is none or isn't finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def card_page(card_id: Column, sites: Sites = Sites()) -> Column:
    return F.concat(F.lit(f"{sites.source}/cards/"), card_id)


def market_search(name: Column, query: Column, sites: Sites = Sites(), parentheses: bool = False) -> Column:
    """The market's search for a card, by its name (else its grading query) up to the first bracket;
    parentheses stay only if asked."""
    asked = F.substring_index(F.coalesce(F.nullif(name, F.lit("")), query, F.lit("")), "[", 1)
    asked = text.tidy(asked if parentheses else F.regexp_replace(asked, r"\(.+?\)", ""))
    return F.when(asked != "", F.concat(F.lit(f"{sites.market}/search?{SEARCH}"), text.percent_encode(asked))).otherwise(f"{sites.market}/search/")


def shop_search(name: Column, model: Column | None = None, sites: Sites = Sites()) -> Column:
    return F.concat(F.lit(f"{sites.shop}/product-list?keyword="), text.percent_encode(text.display_name(name, model)))


def _host(address: str) -> str:
    return "(?:www\\.)?" + address.split("://")[1].replace(".", "\\.")


def is_direct(url: Column, sites: Sites = Sites()) -> Column:
    """Whether a link leads to a product page of the market."""
    return text.given(url).rlike(rf"(?i)^https?://{_host(sites.market)}/(?:{PRODUCT_KINDS})/[0-9]+")


def product_link(html: Column, sites: Sites = Sites()) -> Column:
    """The first product link of a page, on the market's host or relative, in one form; empty if none."""
    path = rf"(/(?:{PRODUCT_KINDS})/[0-9]+)"
    there = F.regexp_extract(text.given(html), rf"(?i){_host(sites.market)}{path}", 1)
    href = F.regexp_extract(text.given(html), rf"""(?i)href=["']([^"']*/(?:{PRODUCT_KINDS})/[0-9]+)""", 1)
    other = F.when(href.rlike("^http"), href).when(href.rlike("^/"), F.concat(F.lit(sites.market), href)).otherwise(F.concat(F.lit(f"{sites.market}/"), href))
    return F.when(there != "", F.concat(F.lit(sites.market), there)).when(href != "", other).otherwise("")


def pending_links(source: DataFrame, previous: DataFrame, batch: int = 500, sites: Sites = Sites()) -> DataFrame:
    """The first cards (id, pos) whose previous link is no product page; none for a batch of 0."""
    direct = previous.where(is_direct(F.col("snkUrl"), sites)).select("id").distinct()
    return source.select("id", "pos").join(direct, "id", "left_anti").orderBy("pos").limit(max(0, batch))


def link_progress(checked: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger (card_id, checked_at, found) after some lookups (card_id, ok, url, at): only those that
    were answered count, also where nothing was found."""
    new = results.where("ok").select("card_id", F.col("at").alias("checked_at"), (text.given(F.col("url")) != "").alias("found"))
    return checked.select("card_id", "checked_at", "found").join(new, "card_id", "left_anti").unionByName(new)


def enrich(source: DataFrame, population: DataFrame, catalog: DataFrame, previous: DataFrame, found: DataFrame | None = None, sites: Sites = Sites(), game: str = GAME) -> DataFrame:
    """The cards of a game with all 35 columns and pos: numbers if finite, graded population if it
    suffices, the shop entry whose keys all match, and the market link, which is one that was
    ``found`` (id, url) now, else the previous one, else a search."""
    cards = source.where(F.col("title") == game).withColumn("psaQuery", text.grading_query(F.col("name")))
    asked = match.with_population(cards.select("id", F.col("psaQuery").alias("psa_query")), population)
    shop = match.all_keys_match(cards.select("id", "name", "model", "variant", "rarity", F.col("psaQuery").alias("query")), catalog)
    first = catalog.groupBy("url").agg(F.min_by(F.struct("state", "name"), "pos").alias("e"))
    shop = shop.join(first, "url").select("id", F.col("url").alias("cardrushUrl"), F.coalesce("e.state", F.lit("A")).alias("cardrushState"), F.col("e.name").alias("cardrushName"))
    last = match.carry_forward(cards.select("id"), previous.select("id", "snkUrl", "pos"), ["snkUrl"]).select("id", F.col("snkUrl").alias("before"))
    out = cards.join(asked.select("id", F.col("rate").alias("officialPsaRate"), F.col("total").alias("officialPsaTotal"), F.col("count").alias("officialPsa10Count")), "id", "left").join(shop, "id", "left").join(last, "id", "left")
    out = out.join(found.select("id", F.col("url").alias("now")), "id", "left") if found is not None else out.withColumn("now", F.lit(None).cast("string"))
    link = F.coalesce(F.nullif("now", F.lit("")), F.nullif("before", F.lit("")), market_search(F.col("name"), F.col("psaQuery"), sites))
    made = {"pageUrl": card_page(F.col("id"), sites), "snkrUrl": link, "rawBacked": flag(F.col("rawBacked")), **{c: text.given(F.col(c)) for c in ("variant", "rarity", "tLastAt")}}
    made |= {c: finite(F.col(c).cast("double")) for c in MONEY} | {c: F.col(c).cast("bigint") for c in COUNTS}
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in ENRICHED], "pos")


def site_view(enriched: DataFrame) -> DataFrame:
    """The published columns, in the published order; a shop link only for state A."""
    link = F.when(F.col("cardrushState") == "A", F.col("cardrushUrl"))
    return enriched.orderBy(*profit.publish_order()).withColumn("snkUrl", F.col("snkrUrl")).withColumn("cardrushUrl", link).select(*PUBLISHED)


def tokyo_date(at: Column) -> Column:
    """The calendar date in Tokyo of a time in UTC."""
    return F.to_date(F.from_utc_timestamp(at, "Asia/Tokyo"))


def metadata(cards: DataFrame, now: str, source_url: str, chunk: str) -> DataFrame:
    """One row about a run: its sources, its date in Tokyo, its time, and the number of cards."""
    at = F.lit(now).cast("timestamp")
    return cards.agg(F.count("*").alias("totalCards")).select(F.lit(source_url).alias("sourceUrl"), F.lit(chunk).alias("chunkUrl"), tokyo_date(at).alias("updatedAt"), at.alias("generatedAt"), "totalCards")


def with_coverage(meta: DataFrame, coverage: DataFrame) -> DataFrame:
    """Metadata with a coverage (one row) in place of an earlier one."""
    return meta.drop("cardrushCoverage").join(coverage.select(F.struct("total", "linked", "missing", "rate").alias("cardrushCoverage")))
