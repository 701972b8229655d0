"""Queries over titles, matching, publication, pages and ledgers, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.functions import text
from gradewise.operators import match, pages, profit, publish, stock
from gradewise.plans import titles as t
from gradewise.plans.params import ProfitQuery
from gradewise.sources.cards import CARDS_SQL, cards, table
from gradewise.sources.shared import cut

Query = Callable[[SparkSession, str], DataFrame]
TODAY, NOW = "2026-08-22", "2026-08-21 23:21:00"


def titled(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, model, rarity, pos): the card titles of all parts."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(t.CARD).alias("name"), F.col("p_brand").alias("model"), F.expr(t.EXACT).alias("rarity"), F.col("p_partkey").alias("pos"))


def shop_entries(spark: SparkSession, d: str) -> DataFrame:
    """The shop's catalog: an entry of all parts."""
    title = F.expr(t.SHOP)
    listed = table(spark, d, "part").select(F.col("p_partkey").alias("id"), title.alias("title"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), text.state_label(title).alias("state"), F.expr(t.CODE).alias("model"), F.lit(None).cast("double").alias("stock"), F.col("p_partkey").alias("pos"))
    return match.catalog_entries(listed, TODAY)


def signature(spark: SparkSession, d: str) -> DataFrame:
    part, out = match.part, match.with_parts(titled(spark, d), "name", "model", "rarity")
    return out.select("id", part("base").alias("base"), part("card_no").alias("card_no"), part("rarity").alias("rare"), part("set_code").alias("code"), part("finish").alias("finish"), part("raw").alias("raw"), "display", text.grading_query(F.col("name")).alias("psa_query"), text.target_query(part("card_no"), part("set_code")).alias("target"))


SIGNATURE_SQL = f"""WITH {t.CARDS} SELECT id, base, card_no, rarity AS rare, code, finish, {t.loose('title')} AS raw, {t.display()} AS display, {t.grading_query('title')} AS psa_query,
CASE WHEN regexp_matches(card_no, '/[^0-9]') THEN card_no WHEN card_no <> '' AND code <> '' THEN card_no || ' ' || code ELSE '' END AS target FROM signed"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    return shop_entries(spark, d).select("id", "name", "state", F.array_join("keys", "|").alias("keys"))


#: The distinct keys in their first order.
ENTRIES_SQL = f"WITH {t.ENTRIES} SELECT id, name, state, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '|') AS keys FROM entries"


def seeds_of_titles(spark: SparkSession, d: str) -> DataFrame:
    c = titled(spark, d)
    return c.select("id", text.search_seed(F.col("name"), text.grading_query(F.col("name"))).alias("seed"))


def bad_urls(spark: SparkSession, d: str) -> DataFrame:
    """Links that were found to be dead: those of parts of the largest size."""
    return table(spark, d, "part").where("p_size >= 48").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"))


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return match.blocked_match(titled(spark, d), shop_entries(spark, d), bad_urls(spark, d))


_ALIKE = "l.{0} <> '' AND r.{0} <> '' AND (contains(l.{0}, r.{0}) OR contains(r.{0}, l.{0}))"
FUZZY_SQL = f"""WITH {t.CARDS}, {t.ENTRIES},
l AS (SELECT id, {t.loose(t.display())} AS name, {t.loose('base')} AS base, {t.loose('card_no')} AS no, {t.loose('code')} AS code, {t.loose('rarity')} AS rare, finish FROM signed),
r0 AS (SELECT id, name AS shown, state, {t.loose('name')} AS name, {t.loose('base')} AS base, {t.loose('card_no')} AS no, {t.loose('code')} AS code, {t.loose('rarity')} AS rare, finish, list_distinct(every) AS keys FROM entries),
b AS (SELECT DISTINCT no, code FROM r0 WHERE no <> '' AND code <> ''),
x AS (SELECT l.*, b.no IS NOT NULL AS exact FROM l LEFT JOIN b ON b.no = l.no AND b.code = l.code WHERE l.no <> ''),
r AS (SELECT * FROM r0 WHERE upper(state) = 'A' AND NOT regexp_matches(shown, '{t.GRADED}') AND id NOT IN (SELECT p_partkey FROM part WHERE p_size >= 48)),
c AS (SELECT l.id, r.id AS to_id, CASE WHEN {_ALIKE.format('name')} THEN {match.NAME_POINTS}e0 ELSE 0e0 END + CASE WHEN {_ALIKE.format('base')} THEN {match.BASE_POINTS}e0 ELSE 0e0 END + {match.NUMBER_POINTS}e0
    + CASE WHEN l.code <> '' AND l.code = r.code THEN {match.SET_POINTS}e0 ELSE 0e0 END + CASE WHEN l.rare <> '' AND l.rare = r.rare THEN {match.RARITY_POINTS}e0 ELSE 0e0 END
    + coalesce(list_sum(list_transform(list_filter(r.keys, lambda k: contains(l.name, k)), lambda k: least(2e0, length(k) / 8e0))), 0e0) AS score
  FROM x l JOIN r ON l.no = r.no AND l.finish = r.finish AND (NOT l.exact OR l.code = r.code))
SELECT id, 'u' || to_id AS url, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, to_id) AS n FROM c WHERE score >= {match.THRESHOLD}) WHERE n = 1"""


def key_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with few keys: number, set code and the name's first word."""
    keys = F.array(F.expr(t.NUMBER), F.expr(t.CODE), F.element_at(F.split("p_name", " "), 1))
    return table(spark, d, "part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.expr(t.SHOP).alias("name"), text.state_label(F.expr(t.SHOP)).alias("state"), keys.alias("keys"), F.col("p_partkey").alias("pos"))


def all_keys(spark: SparkSession, d: str) -> DataFrame:
    c = titled(spark, d).withColumn("variant", F.lit(None).cast("string")).withColumn("query", text.grading_query(F.col("name")))
    return match.all_keys_match(c, key_entries(spark, d))


_HAY = t.loose(f"title || ' ' || model || ' ' || exact || coalesce(' ' || ({t.grading_query('title')}), '')")
ALL_KEYS_CTE = f"""{t.CARDS}, {t.ENTRIES}, hay AS (SELECT id, {_HAY} AS hay, {t.finish('title')} AS finish FROM signed),
e AS (SELECT s.id, {t.finish('s.shown')} AS finish, [{t.loose(t.NUMBER)}, {t.loose(t.CODE)}, {t.loose("string_split(p_name, ' ')[1]")}] AS keys FROM split s JOIN part ON p_partkey = s.id WHERE upper(s.state) = 'A'),
linked AS (SELECT h.id, min(e.id) AS to_id FROM hay h JOIN e ON h.finish = e.finish AND contains(h.hay, e.keys[1]) AND contains(h.hay, e.keys[2]) AND contains(h.hay, e.keys[3]) GROUP BY h.id)"""


def population(spark: SparkSession, d: str) -> DataFrame:
    """Graded populations of all parts: by padded query, by the official name of the set, or by a label."""
    code, number = F.expr(t.CODE), F.expr(t.NUMBER)
    kind = F.col("p_partkey") % 4
    query = F.when(kind == 0, F.concat(F.lit("Pokemon Japanese "), F.upper(code), F.lit(" "), number)).when(kind == 1, F.concat(F.lit("Pokemon Japanese "), code, F.lit("-Series "), number)).otherwise(F.concat(F.lit("Spec "), F.col("p_partkey").cast("string")))
    label = F.when(kind == 2, F.concat(F.lit("Pokemon Japanese "), code, F.lit("  Set")))
    return table(spark, d, "part").select(query.alias("query"), (F.col("p_size") / F.lit(10.0)).alias("rate"), (F.col("p_partkey") * 10.0).alias("total"), F.col("p_partkey").cast("double").alias("count"), number.alias("card_no"), label.alias("source_set"), F.col("p_partkey").alias("pos"))


def population_join(spark: SparkSession, d: str) -> DataFrame:
    return match.with_population(titled(spark, d).select("id", text.grading_query(F.col("name")).alias("psa_query")), population(spark, d))


_SHORT = """CASE WHEN regexp_matches({0}, '^(?:SV|SM|XY|S|M|PCG|PMCG|CP|E)-P$') OR strpos({0}, '-') <= 1 OR (strpos({0}, '-') <= 4 AND length({0}) - strpos({0}, '-') <= 3) THEN {0} ELSE substring({0}, 1, strpos({0}, '-') - 1) END"""
POPULATION_CTE = f"""{t.CARDS}, pop AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, upper({t.CODE}) AS code, {t.NUMBER} AS no, p_size / 10e0 AS rate FROM part),
known AS (SELECT 'Pokemon Japanese ' || code || ' ' || no AS key, k, 0 AS kind FROM pop WHERE kind = 0
  UNION ALL SELECT 'Pokemon Japanese ' || {_SHORT.format("code || '-SERIES'")} || ' ' || no, k, 1 FROM pop WHERE kind = 1
  UNION ALL SELECT 'Pokemon Japanese ' || {_SHORT.format('code')} || ' ' || no, k, 1 FROM pop WHERE kind IN (0, 2)),
row_of AS (SELECT key, kind, max(k) AS k FROM known GROUP BY key, kind),
asked AS (SELECT id, {t.grading_query('title')} AS psa_query FROM signed),
pieces AS (SELECT id, psa_query, regexp_extract(psa_query, '^Pokemon Japanese (.+?) ([A-Z0-9-]+)$', 1) AS s, regexp_extract(psa_query, '^Pokemon Japanese (.+?) ([A-Z0-9-]+)$', 2) AS n FROM asked WHERE psa_query IS NOT NULL),
keys AS (SELECT id, 0 AS place, CASE WHEN s = '' THEN psa_query ELSE 'Pokemon Japanese ' || s || ' ' || n END AS key FROM pieces UNION ALL SELECT id, 1, 'Pokemon Japanese ' || s || ' ' || regexp_replace(n, '^0+', '') FROM pieces WHERE regexp_replace(n, '^0+', '') NOT IN ('', n)),
hit AS (SELECT id, arg_min(r.k, place * 2 + r.kind) AS k FROM keys JOIN row_of r USING (key) GROUP BY id)"""
POPULATION_SQL = f"""WITH {POPULATION_CTE} SELECT a.id, a.psa_query, CASE WHEN p.k * 10e0 >= 500 AND p.rate >= 1 THEN p.rate END AS rate, CASE WHEN p.k * 10e0 >= 500 AND p.rate >= 1 THEN p.k * 10e0 END AS total,
  CASE WHEN p.k * 10e0 >= 500 AND p.rate >= 1 THEN CAST(p.k AS DOUBLE) END AS count FROM asked a LEFT JOIN hit h ON h.id = a.id LEFT JOIN pop p ON p.k = h.k"""


def linked_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards with a link: parts of an even size have one."""
    return titled(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).alias("url")), "id")


def modern_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = linked_cards(spark, d)
    return profit.coverage_text(match.coverage(c.where(text.is_modern(text.set_code_of_card(F.col("name"), F.col("model"))))))


COVERAGE_SQL = f"""WITH {t.CARDS}, m AS (SELECT p_size % 2 = 0 AS linked FROM signed JOIN part ON p_partkey = id WHERE {t.modern(t.coverage_code('title', 'model'))}),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE NOT linked) AS missing, CAST(count(*) FILTER (WHERE linked) AS DOUBLE) / count(*) * 100 AS rate FROM m)
SELECT *, format('{{:,}}', linked) || ' / ' || format('{{:,}}', total) || '（' || printf('%.1f', rate) || '%）' AS shown FROM c"""


def attempted(spark: SparkSession, d: str, wanted: DataFrame) -> DataFrame:
    """Keys tried before: those of wanted cards of small size."""
    small = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return wanted.join(small, "id", "left_semi").select("key").distinct()


def queue(spark: SparkSession, d: str, batch: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    wanted = cut(match.wanted(titled(spark, d))) if wanted is None else wanted
    part = table(spark, d, "part")
    forced = part.where("p_brand LIKE '%1'").select(F.col("p_partkey").alias("id"))
    linked = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"))
    return match.unmatched_queue(wanted, linked, attempted(spark, d, wanted), forced, batch)


QUEUE_CTE = f"""{t.CARDS}, {t.WANTED}, tried AS (SELECT DISTINCT key FROM wanted JOIN part ON p_partkey = id WHERE p_size < 10),
c AS (SELECT w.key, w.id, w.query, w.promo, p_brand LIKE '%1' AS forced, tr.key IS NOT NULL AS tried FROM wanted w JOIN part ON p_partkey = w.id LEFT JOIN tried tr ON tr.key = w.key WHERE w.key <> '' AND p_size % 2 <> 0),
todo AS (SELECT key, id AS pos, id, query, promo, forced FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM c WHERE NOT tried OR forced) WHERE n = 1)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    wanted = cut(match.wanted(titled(spark, d)))
    return match.attempted_after(attempted(spark, d, wanted), queue(spark, d, wanted=wanted))


def seed_queue(spark: SparkSession, d: str) -> DataFrame:
    done = spark.range(1).select(F.explode(F.array(F.lit("M2A"), F.lit("CP6"))).alias("code"))
    return match.seeds(match.wanted(titled(spark, d)), done)


SEED_SQL = f"WITH {t.CARDS}, {t.WANTED} SELECT upper(code) AS code, count(*) AS n, upper(code) LIKE '%-P' AS promo FROM wanted WHERE code <> '' AND upper(code) NOT IN ('M2A', 'CP6') GROUP BY 1"


def source_cards(spark: SparkSession, d: str) -> DataFrame:
    """The card source: all parts with their sales; every fifth is of another game."""
    c = cards(spark, d).drop("name", "model", "rarity", "size")
    own = titled(spark, d).select(F.col("id").cast("string").alias("id"), "name", "model", "rarity")
    other = {"title": F.when(F.col("pos") % 5 == 0, "other").otherwise(publish.GAME), "variant": F.lit(None).cast("string"), "img": F.concat(F.lit("i"), F.col("id")), "snkPrice": F.col("price") * 2, "snkPsa9Price": F.when(F.col("price") > 0, F.lit(float("nan"))), "snkPsa10Count": F.col("tv7"), "kaitori": F.col("price") / 2, "tLast": F.lit(None).cast("double"), "rawBacked": F.col("pos") % 2 == 0}
    return c.join(own, "id").withColumns(other)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("id"), F.lit("https://market.example/products/1").alias("snkUrl"), F.col("p_partkey").alias("pos"))
    found = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").cast("string").alias("id"), F.lit("https://market.example/apparels/2").alias("url"))
    return publish.enrich(source_cards(spark, d), population(spark, d), key_entries(spark, d), c, found)


def card_enriched(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d).select(*publish.ENRICHED)


_ENCODED = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
_ASKED = "trim(regexp_replace(string_split(title, '[')[1], '\\(.+?\\)', '', 'g'))"
ENRICHED_CTE = f"""{CARDS_SQL}, {ALL_KEYS_CTE}, {POPULATION_CTE.replace(t.CARDS + ", ", "")},
gate AS (SELECT h.id, p.k, p.rate FROM hit h JOIN pop p ON p.k = h.k WHERE p.k * 10e0 >= 500 AND p.rate >= 1),
en AS (SELECT c.id, '{publish.GAME}' AS title, s.title AS name, 'https://cards.example/cards/' || c.id AS "pageUrl", s.model, '' AS variant, s.exact AS rarity, a.psa_query AS "psaQuery", 'i' || c.id AS img,
  CASE WHEN c.size = 7 THEN 'https://market.example/apparels/2' WHEN c.size > 25 THEN 'https://market.example/products/1' ELSE 'https://market.example/search?{publish.SEARCH}' || {_ENCODED.format(_ASKED.replace("title", "s.title"))} END AS "snkrUrl",
  c.price, c.price * 2 AS "snkPrice", c."snkPsa10Price", CAST(NULL AS DOUBLE) AS "snkPsa9Price", c."snkPsa10Min", c.tv7 AS "snkPsa10Count", CAST(g.k AS DOUBLE) AS "officialPsa10Count", g.k * 10e0 AS "officialPsaTotal", g.rate AS "officialPsaRate",
  c.tv7, c.tv30, c.p10tv7, c.p10tv30, c.chg7, c.chg30, c.tvel, c.days, c.price / 2 AS kaitori, CAST(NULL AS DOUBLE) AS "tLast", coalesce(c."tLastAt", '') AS "tLastAt", CASE WHEN c.pos % 2 = 0 THEN 1 ELSE 0 END AS "rawBacked", c."snkListings",
  'u' || k.to_id AS "cardrushUrl", en0.state AS "cardrushState", en0.shown AS "cardrushName", c.pos
FROM cards c JOIN signed s ON s.id = c.pos JOIN asked a ON a.id = c.pos LEFT JOIN gate g ON g.id = c.pos LEFT JOIN linked k ON k.id = c.pos LEFT JOIN split en0 ON en0.id = k.to_id WHERE c.pos % 5 <> 0)"""


def card_site(spark: SparkSession, d: str) -> DataFrame:
    return publish.site_view(enriched(spark, d))


def run_meta(spark: SparkSession, d: str) -> DataFrame:
    c = linked_cards(spark, d)
    meta = publish.metadata(c, NOW, "https://cards.example/cards", "https://cards.example/c.js")
    out = publish.with_coverage(meta, match.coverage(c))
    return out.select("sourceUrl", "chunkUrl", "updatedAt", "generatedAt", "totalCards", "cardrushCoverage.linked", "cardrushCoverage.rate")


def url_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.percent_encode(text.given(F.col("text")))).alias("encoded"))


def html_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.decode_html(F.col("html")).alias("decoded"))


_DECODED = "regexp_replace({0}, '<[^>]+>', ' ', 'g')"
for _entity, _char in (("&nbsp;|&#160;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;|&#34;", "'\"'"), ("&#39;|&apos;", "chr(39)")):
    _DECODED = f"regexp_replace({_DECODED}, '(?i){_entity}', {_char}, 'g')"
_DECODED = t.collapse(_DECODED)


def shop_pages(spark: SparkSession, d: str) -> DataFrame:
    """Listing pages of twenty parts each, every third in Markdown."""
    return table(spark, d, "part").select(F.expr(PAGE).alias("page_id"), F.col("p_partkey"), F.expr(ITEM).alias("item")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]), "\n").alias("body"))


PAGE = "CAST(floor(p_partkey / 20) AS BIGINT)"
_URL = "'https://shop.example/product/' || CAST(p_partkey AS STRING)"
_LEFT = "CASE p_partkey % 4 WHEN 0 THEN '在庫数 1,0' || CAST(p_size + 10 AS STRING) || ' 枚' WHEN 1 THEN 'SOLD OUT' WHEN 2 THEN ' × ' ELSE '' END"
ITEM = (
    f"CASE WHEN {PAGE} % 3 = 0 THEN CASE WHEN p_partkey % 20 = 0 THEN 'Markdown Content:' ELSE '' END || chr(10) || '[![Image 3: ' || {t.SHOP} || '](https://i.example/1.jpg) ' || CASE WHEN p_partkey % 7 = 0 THEN '〔状態B〕' ELSE '' END || {_LEFT} || ' {{' || {t.NUMBER} || '/069}}[**' || {t.CODE} || '**] ](' || {_URL} || ')'"
    f" ELSE '<li class=\"list_item_cell list_item_' || CAST(p_partkey AS STRING) || ' \"><p>' || {_LEFT} || '</p><a href=\"' || {_URL} || '\" class=\"item_data_link\"><img src=\"i.jpg\" alt=\"' || {t.SHOP} || '\" width=\"1\"></a><span class=\"model_number_value\">' || {t.CODE} || '</span></li>' END"
).replace("{{", "{").replace("}}", "}")


def shop_items(spark: SparkSession, d: str) -> DataFrame:
    found = pages.shop_items(shop_pages(spark, d))
    return match.catalog_entries(found, TODAY).select("id", "url", "name", "state", "stock", "observed_at")


_NAME = t.collapse("regexp_replace(shown, '^〔状態[^〕]+〕', '') || ' [' || code || ']'")
#: Every part must come out again; only Markdown pages whose first part is there are marked as such.
ITEMS_SQL = f"""WITH i AS (SELECT p_partkey, {PAGE} AS page, {t.SHOP} AS shown, {t.CODE} AS code FROM part),
m AS (SELECT page FROM i WHERE page % 3 = 0 AND p_partkey % 20 = 0),
x AS (SELECT i.*, m.page IS NOT NULL AS mark, i.page % 3 = 0 AS wants FROM i LEFT JOIN m ON m.page = i.page)
SELECT CAST(p_partkey AS VARCHAR) AS id, 'https://shop.example/product/' || p_partkey AS url, {_NAME} AS name,
  CASE WHEN mark THEN CASE WHEN p_partkey % 7 = 0 THEN 'B' ELSE 'A' END ELSE coalesce(nullif(regexp_extract(shown, '(?i)^〔状態([A-D]-?)〕', 1), ''), 'A') END AS state,
  CASE p_partkey % 4 WHEN 0 THEN CAST('10' || (SELECT p_size + 10 FROM part q WHERE q.p_partkey = x.p_partkey) AS DOUBLE) WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 END AS stock, DATE '{TODAY}' AS observed_at FROM x WHERE mark OR NOT wants"""


def product_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fetched product pages of all parts: in HTML or Markdown, some missing, moved or of another state."""
    k, size = F.col("p_partkey"), F.col("p_size")
    title, left = F.expr(t.SHOP), F.expr(_LEFT)
    html = F.when(k % 2 == 0, F.concat(F.lit("<H1 class='x'>"), title, F.lit("</H1><p>販売価格 &amp; "), left, F.lit("</p>"))).when(k % 3 == 0, F.concat(F.lit("Title: "), title, F.lit("\n\n"), left)).otherwise(F.concat(F.lit("# "), title, F.lit("\nno price\n"), left))
    url = F.concat(F.lit(pages.SHOP), F.lit("/product/"), k.cast("string"))
    final = F.when(size % 10 == 3, F.concat(F.lit(pages.SHOP), F.lit("/product/9000000"), k.cast("string"))).when(size % 10 == 4, F.concat(F.lit("https://elsewhere.example/"), k.cast("string"))).otherwise(url)
    status = F.when(size % 10 == 1, 404).when(size % 10 == 2, 503).otherwise(200)
    return table(spark, d, "part").select(k.alias("card_id"), url.alias("link"), final.alias("url"), status.alias("http_status"), html.alias("html"))


def product_run(spark: SparkSession, d: str) -> DataFrame:
    p = product_pages(spark, d)
    read = pages.product_page(p.select("url", "html").distinct())
    return stock.product_run(p.join(read, "url").select("card_id", F.col("link").alias("url"), "http_status", "valid", "product_url", "state", "stock"))


PRODUCT_CTE = f"""p AS (SELECT p_partkey AS k, p_size % 10 AS z, {t.SHOP} AS shown, {_LEFT} AS had, p_size FROM part),
read AS (SELECT *, coalesce(nullif(upper(regexp_extract(shown, '(?i)〔状態([A-D]-?)〕', 1)), ''), 'A') AS state, CASE k % 4 WHEN 0 THEN CAST('10' || (p_size + 10) AS DOUBLE) WHEN 1 THEN 0e0 END AS stock FROM p),
judged AS (SELECT *, z <> 4 AND (k % 2 = 0 OR stock IS NOT NULL) AS valid FROM read),
run AS (SELECT *, CASE WHEN z = 1 THEN 'invalid' WHEN z = 2 THEN 'failed' WHEN NOT valid THEN 'invalid' WHEN state <> 'A' THEN 'rejected' WHEN z = 3 THEN 'moved' ELSE 'ok' END AS outcome, z = 3 AND valid AS moved FROM judged)"""
PRODUCT_SQL = f"""WITH {PRODUCT_CTE} SELECT k AS card_id, 'https://shop.example/product/' || k AS url, CASE WHEN z = 4 THEN '' WHEN z = 3 THEN 'https://shop.example/product/9000000' || k ELSE 'https://shop.example/product/' || k END AS product_url, outcome, moved,
  CASE WHEN outcome = 'failed' OR outcome = 'ok' THEN 'https://shop.example/product/' || k WHEN outcome = 'moved' THEN 'https://shop.example/product/9000000' || k END AS next_url, CASE WHEN outcome IN ('ok', 'moved') THEN stock END AS stock FROM run"""


def product_state(spark: SparkSession, d: str) -> DataFrame:
    """What the run over product pages leaves: invalid URLs and cards to recheck, as one relation."""
    first = table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("card_id"))
    bad, again = stock.next_product_state(product_run(spark, d), spark.range(1).select(F.lit("old").alias("url")), first)
    return bad.select(F.lit("invalid").alias("kind"), F.col("url").alias("key")).unionByName(again.select(F.lit("recheck").alias("kind"), F.col("card_id").cast("string").alias("key")))


PRODUCT_STATE_SQL = f"""WITH {PRODUCT_CTE} SELECT 'invalid' AS kind, 'old' AS key UNION SELECT 'invalid', 'https://shop.example/product/' || k FROM run WHERE outcome IN ('invalid', 'rejected') OR moved
UNION SELECT 'invalid', 'https://shop.example/product/9000000' || k FROM run WHERE outcome = 'rejected' AND moved
UNION SELECT 'recheck', CAST(k AS VARCHAR) FROM run WHERE (outcome IN ('invalid', 'rejected') OR p_size < 5) AND outcome NOT IN ('ok', 'moved')"""


def market_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of all cards: source page, searches, and the product link in a page's markup."""
    c = titled(spark, d).withColumn("query", text.grading_query(F.col("name")))
    kind = F.col("id") % 4
    path = F.concat(F.lit("/trading-cards/"), F.col("id").cast("string"))
    html = F.when(kind == 0, F.concat(F.lit("x https://www.market.example"), path, F.lit("/used/7 y"))).when(kind == 1, F.concat(F.lit('<a href="'), path, F.lit('">'))).when(kind == 2, F.concat(F.lit("<a href='https://other.example"), path, F.lit("'>"))).otherwise("none")
    link = publish.product_link(html)
    return c.select("id", publish.card_page(F.col("id").cast("string")).alias("page"), publish.market_search(F.col("name"), F.col("query")).alias("search"), publish.market_search(F.col("name"), F.col("query"), parentheses=True).alias("full_search"), publish.shop_search(F.col("name"), F.col("model")).alias("shop"), link.alias("link"), publish.is_direct(link).alias("direct"))


_DISPLAY = f"WITH titles AS (SELECT p_partkey AS id, {t.CARD} AS title, p_brand AS model, '' AS exact, {t.collapse(t.CARD)} AS src FROM part), signed AS (SELECT *, {t.parts('src', 'model', 'exact')} FROM titles)"
LINKS_SQL = f"""{_DISPLAY} SELECT id, 'https://cards.example/cards/' || id AS page, 'https://market.example/search?{publish.SEARCH}' || {_ENCODED.format(_ASKED)} AS search, 'https://market.example/search?{publish.SEARCH}' || {_ENCODED.format("trim(string_split(title, '[')[1])")} AS full_search,
  'https://shop.example/product-list?keyword=' || {_ENCODED.format(t.display())} AS shop, CASE id % 4 WHEN 0 THEN 'https://market.example/trading-cards/' || id WHEN 1 THEN 'https://market.example/trading-cards/' || id WHEN 2 THEN 'https://other.example/trading-cards/' || id ELSE '' END AS link, id % 4 < 2 AS direct FROM signed"""


def link_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of link lookups after a run over customers: orders say when each was looked up before."""
    before = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("card_id")).agg(F.max("o_orderdate").cast("timestamp").alias("checked_at"), (F.count("*") > 5).alias("found"))
    c = table(spark, d, "customer")
    results = c.select(F.col("c_custkey").alias("card_id"), (F.col("c_nationkey") < 20).alias("ok"), F.when(F.col("c_nationkey") < 5, F.col("c_name")).alias("url"), F.lit(NOW).cast("timestamp").alias("at")).where("c_acctbal > 0")
    return publish.link_progress(before, results)


LEDGER_SQL = f"""WITH r AS (SELECT c_custkey AS card_id, c_nationkey < 5 AS found FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20)
SELECT card_id, TIMESTAMP '{NOW}' AS checked_at, found FROM r UNION ALL SELECT o_custkey, max(o_orderdate), count(*) > 5 FROM orders WHERE o_custkey NOT IN (SELECT card_id FROM r) GROUP BY 1"""


def pending(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    links = p.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "https://www.market.example/products/5").otherwise("https://market.example/search?x=/products/5").alias("snkUrl"))
    return publish.pending_links(p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos")), links)


def fresh_items(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    items = o.where("o_orderstatus = 'O'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderkey").alias("pos"))
    return match.fresh_items(items, o.where("o_orderstatus = 'P'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("url")))


def override_inject(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    catalog = s.where("s_acctbal > 0").select(F.col("s_name").alias("url"), F.lit("catalog").alias("name"), F.col("s_nationkey").alias("stock"))
    return match.inject_overrides(catalog, s.where("s_nationkey < 10").select(F.col("s_name").alias("url"), F.lit("override").alias("name")))


def relinked(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all customers after a relink and an update in place, without columns of earlier versions."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("url"), F.lit("x").alias("state"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").cast("string").alias("url"))
    return match.upsert(match.relink(c, o), table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("url")), "id", ["url"])


def link_totals(spark: SparkSession, d: str) -> DataFrame:
    return match.link_counts(linked_cards(spark, d), F.length("name") % 2 == 0)


def rechecks(spark: SparkSession, d: str) -> DataFrame:
    c = linked_cards(spark, d)
    return match.remaining_rechecks(c.where("id % 3 = 0").select("id"), c)


def script_urls(spark: SparkSession, d: str) -> DataFrame:
    """Script links and the data chunk's address in markup made of all pages."""
    html = F.concat(F.lit('<script src="/_next/static/chunks/webpack-'), F.hex("page_id"), F.lit('.js?dpl=d1"></script><script src="/_next/static/chunks/2.js"></script>'), F.col("html"), F.lit('<link href="/_next/static/chunks/2.js"/>'))
    runtime = F.concat(F.lit('a=>"static/chunks/"+e+"."+{280:1}[e];'), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"static/chunks/"+e+".'), F.lower(F.hex("page_id")), F.lit('.js"'))).otherwise(""))
    return table(spark, d, "pages").select("page_id", F.array_join(pages.script_links(html), " ").alias("scripts"), pages.chunk_url(runtime, "https://cards.example").alias("chunk"))


SCRIPTS_SQL = """SELECT page_id, '/_next/static/chunks/webpack-' || to_hex(page_id) || '.js?dpl=d1 /_next/static/chunks/2.js' AS scripts,
CASE WHEN page_id % 2 = 0 THEN 'https://cards.example/_next/static/chunks/280.' || lower(to_hex(page_id)) || '.js' END AS chunk FROM pages"""


def profit_displayed(spark: SparkSession, d: str) -> DataFrame:
    """What results show, for cards whose stock summary is that of the user of their number."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("card_id"), F.to_date("ts").alias("obs_date")).agg(F.count("*").cast("double").alias("stock"))
    c = profit.with_profit(cards(spark, d)).select("pos", F.col("pos").alias("id"), F.when(F.col("pos") % 2 == 0, F.col("rarity")).alias("rarity"), "model")
    shown = profit.displayed(stock.with_summary(c, stock.current_summary(c, e)), publish.is_direct(F.when(F.col("id") % 3 == 0, "http://market.example/products/1").otherwise("x")))
    return shown.select("id", "series_label", "market_direct", "stock_display", "avg7_display", "avg30_display", "avg90_display", "demand", "demand_label")


def queries() -> dict[str, Query]:
    return {
        "signature": signature,
        "catalog_entries": entries,
        "search_seeds": seeds_of_titles,
        "finish_kind": lambda spark, d: titled(spark, d).select("id", text.finish_kind(F.col("name")).alias("finish"), text.finish_label(text.finish_kind(F.col("name"))).alias("label")),
        "state_labels": lambda spark, d: table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.state_label(F.expr(t.SHOP)).alias("state"), text.strip_state(F.expr(t.SHOP)).alias("rest")),
        "modern_codes": lambda spark, d: titled(spark, d).select("id", (c := text.set_code_of_card(F.col("name"), F.col("model"))).alias("code"), text.is_modern(c).alias("modern"), text.is_promo(F.col("name"), text.set_code(F.col("name"))).alias("promo")),
        "url_encode": url_encode,
        "html_decode": html_decode,
        "fuzzy_match": fuzzy_match,
        "all_keys_match": all_keys,
        "psa_join": population_join,
        "modern_coverage": modern_coverage,
        "seed_queue": seed_queue,
        "unmatched_queue": queue,
        "attempted_ledger": ledger,
        "card_enriched": card_enriched,
        "card_site": card_site,
        "run_meta": run_meta,
        "shop_items": shop_items,
        "product_run": product_run,
        "product_state": product_state,
        "market_links": market_links,
        "link_ledger": link_ledger,
        "link_pending": pending,
        "fresh_items": fresh_items,
        "override_inject": override_inject,
        "relink": relinked,
        "link_counts": link_totals,
        "link_rechecks": rechecks,
        "script_urls": script_urls,
        "profit_displayed": profit_displayed,
        "profit_progress": lambda spark, d: profit.progress(cards(spark, d), ProfitQuery(tx=3)),
    }


def oracle_sql(stock_sql: str, calc_sql: str) -> dict[str, str]:
    shown = "coalesce(printf('%.2f', {0}) || '枚/日', '蓄積中')"
    return {
        "signature": SIGNATURE_SQL,
        "catalog_entries": ENTRIES_SQL,
        "search_seeds": f"WITH {t.CARDS.replace(t.EXACT, chr(39) * 2)}, a AS (SELECT *, upper(trim(regexp_extract(coalesce({t.grading_query('title')}, ''), '(?i)^Pokemon Japanese\\s+(.+?)\\s+[0-9]+', 1))) AS asked FROM signed) SELECT id, CASE WHEN code <> '' THEN upper(code) WHEN asked <> '' THEN asked ELSE {t.display()} END AS seed FROM a".replace("p_brand AS model", "'' AS model"),
        "finish_kind": f"WITH {t.CARDS} SELECT id, finish, {t.finish_label('finish')} AS label FROM signed",
        "state_labels": f"SELECT p_partkey AS id, coalesce(nullif(regexp_extract({t.SHOP}, '(?i)^〔状態([A-D]-?)〕', 1), ''), 'A') AS state, regexp_replace({t.SHOP}, '^〔状態[^〕]+〕', '') AS rest FROM part",
        "modern_codes": f"WITH {t.CARDS} SELECT id, {t.coverage_code('title', 'model')} AS code, {t.modern(t.coverage_code('title', 'model'))} AS modern, {t.promo('title', 'code')} AS promo FROM signed",
        "url_encode": f"SELECT doc_id, md5({_ENCODED.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS encoded FROM documents",
        "html_decode": f"SELECT page_id, {_DECODED.format('html')} AS decoded FROM pages",
        "fuzzy_match": FUZZY_SQL,
        "all_keys_match": f"WITH {ALL_KEYS_CTE} SELECT id, 'u' || to_id AS url FROM linked",
        "psa_join": POPULATION_SQL,
        "modern_coverage": COVERAGE_SQL,
        "seed_queue": SEED_SQL,
        "unmatched_queue": f"WITH {QUEUE_CTE} SELECT * FROM todo",
        "attempted_ledger": f"WITH {QUEUE_CTE} SELECT key FROM tried UNION SELECT key FROM todo",
        "card_enriched": f"WITH {ENRICHED_CTE} SELECT * EXCLUDE (pos) FROM en",
        "card_site": f"""WITH {ENRICHED_CTE} SELECT id, name, model, img, "snkrUrl" AS "snkUrl", price, "snkPsa10Price", "snkPsa10Min", tv7, tv30, p10tv7, p10tv30, chg7, chg30, tvel, days, "tLastAt", "snkListings", CASE WHEN "cardrushState" = 'A' THEN "cardrushUrl" END AS "cardrushUrl" FROM en""",
        "run_meta": f"SELECT 'https://cards.example/cards' AS \"sourceUrl\", 'https://cards.example/c.js' AS \"chunkUrl\", DATE '2026-08-22' AS \"updatedAt\", TIMESTAMP '{NOW}' AS \"generatedAt\", count(*) AS \"totalCards\", count(*) FILTER (WHERE p_size % 2 = 0) AS linked, CAST(count(*) FILTER (WHERE p_size % 2 = 0) AS DOUBLE) / count(*) * 100 AS rate FROM part",
        "shop_items": ITEMS_SQL,
        "product_run": PRODUCT_SQL,
        "product_state": PRODUCT_STATE_SQL,
        "market_links": LINKS_SQL,
        "link_ledger": LEDGER_SQL,
        "link_pending": "SELECT p_partkey AS id, p_partkey AS pos FROM part WHERE p_size <= 10 OR p_size % 2 <> 0 ORDER BY pos LIMIT 500",
        "fresh_items": "SELECT 'c' || o_custkey AS url, min(o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey",
        "override_inject": "SELECT s_name AS url, CASE WHEN s_acctbal > 0 THEN 'catalog' ELSE 'override' END AS name, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS stock FROM supplier WHERE s_acctbal > 0 OR s_nationkey < 10",
        "relink": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey <> 3 THEN (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders WHERE o_custkey = c_custkey) END AS url FROM customer",
        "link_counts": f"WITH {t.CARDS} SELECT count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 0) AS matched, count(*) FILTER (WHERE length(title) % 2 = 0) AS direct FROM signed JOIN part ON p_partkey = id",
        "link_rechecks": "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 <> 0",
        "script_urls": SCRIPTS_SQL,
        "profit_displayed": f"""WITH s AS ({stock_sql}) SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS series_label, p_partkey % 3 = 0 AS market_direct, coalesce(CAST(CAST(s.stock AS BIGINT) AS VARCHAR) || '枚', '確認中') AS stock_display,
  {shown.format('avg7')} AS avg7_display, {shown.format('avg30')} AS avg30_display, {shown.format('avg90')} AS avg90_display, coalesce(demand, 'pending') AS demand, coalesce(demand_label, '蓄積中') AS demand_label FROM part LEFT JOIN s ON card_id = p_partkey""",
        "profit_progress": calc_sql + ", n AS (SELECT count(*) AS n FROM found WHERE tx >= 3 AND roi >= 40 AND psa10 BETWEEN 0 AND 200000) SELECT n AS n_found, least(n, 60) AS n_shown, format('{:,}', n) || '枚中 ' || least(n, 60) || '枚を表示' AS progress, n > 60 AS has_more FROM n",
    }
