"""Raw pages to columns: titles, links, page counts, script links, shop items and product pages.

The shop's address is a parameter, as the patterns below hold for any host.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.functions import text

#: The default address of the shop whose pages are read.
SHOP = "https://shop.example"
# Fixed forms of the shop's pages; HOST stands for its address.
HTML_ITEM = (
    r'<li class="list_item_cell list_item_([0-9]+)\s*">[\s\S]*?<a href="(HOST/product/[0-9]+)" class="item_data_link">'
    r'[\s\S]*?alt="([^"]+)"[^>]*>[\s\S]*?<span class="model_number_value">([^<]+)</span>'
)
MARKDOWN = "Markdown Content:"
MARKDOWN_ITEM = r"!\[Image [0-9]+: ([^\]]+)\]\([^)]+\)\s*(.*?)\]\((HOST/product/([0-9]+))\)\s*\z"
MARKDOWN_MODEL = r"\}\[(?:\*\*)?([A-Za-z0-9-]+)(?:\*\*)?\]"
LAST_PAGE = r'class="to_last_page pager_btn">([0-9]+)<'
PAGE_LINK = r"[?&]page=([0-9]+)"
SCRIPT = r"""/_next/static/chunks/[^"'\\s]+\.js(?:\?dpl=[^"'\\s]+)?"""
CHUNK = r'static/chunks/"\+e\+"\.([a-z0-9]+)\.js"'
PRICED, SOLD_OUT = "販売価格", r"(?i)再入荷を知らせる|SOLD\s*OUT"


def at_host(pattern: str, host: str) -> str:
    return pattern.replace("HOST", re.escape(host))


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("at", "href"))


def headings(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


def total_pages(html: Column) -> Column:
    """The number on the last-page button, else the largest page number in a link, else 1."""
    last = F.nullif(F.regexp_extract(html, LAST_PAGE, 1), F.lit("")).try_cast("int")
    numbers = F.array_max(F.transform(F.regexp_extract_all(html, F.lit(PAGE_LINK), F.lit(1)), lambda x: x.try_cast("int")))
    return F.coalesce(F.when(last == 0, 1).otherwise(last), numbers, F.lit(1))


def script_links(html: Column) -> Column:
    """The distinct script links of a page, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(0)))


def chunk_url(runtime: Column, site: str, number: int = 280) -> Column:
    """The address of a data chunk by the hash in the loader's script; null where it has none."""
    found = F.regexp_extract(runtime, CHUNK, 1)
    return F.when(found != "", F.concat(F.lit(f"{site}/_next/static/chunks/{number}."), found, F.lit(".js")))


def shop_items(pages: DataFrame, host: str = SHOP) -> DataFrame:
    """(page_id, pos, id, url, title, state, model, stock): items of listing pages (page_id, body), in
    HTML or, where the body says so, in Markdown."""
    is_markdown = F.contains(F.col("body"), F.lit(MARKDOWN))
    html = F.lit(at_host(HTML_ITEM, host))
    found = F.arrays_zip(*[F.regexp_extract_all("body", html, F.lit(i)).alias(n) for i, n in enumerate(("whole", "id", "url", "title", "model"))])
    rows = pages.where(~is_markdown).select("page_id", F.posexplode(found).alias("pos", "i"))
    left = rows.select("page_id", "pos", "i.id", "i.url", "i.title", text.state_label(F.col("i.title")).alias("state"), "i.model", text.stock_of(F.col("i.whole")).alias("stock"))
    lines = pages.where(is_markdown).select("page_id", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    pick = lambda i: F.regexp_extract("line", at_host(MARKDOWN_ITEM, host), i)
    state = F.when(pick(2).rlike("^〔状態[^〕]+〕"), text.state_label(pick(2))).otherwise("A")
    right = lines.where(pick(4) != "").select("page_id", "pos", pick(4).alias("id"), pick(3).alias("url"), pick(1).alias("title"), state.alias("state"), F.regexp_extract("line", MARKDOWN_MODEL, 1).alias("model"), text.stock_of(F.col("line")).alias("stock"))
    return left.unionByName(right)


def product_page(pages: DataFrame, host: str = SHOP) -> DataFrame:
    """(url, title, product_url, state, stock, valid) of product pages (url, html), in HTML or Markdown."""
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in patterns], F.lit(""))
    title = text.decode_html(first(r"(?i)<h1[^>]*>([\s\S]*?)</h1>", r"(?im)^Title:\s*(.+)$", r"(?m)^#\s+(.+)$"))
    number = lambda body: F.get(F.regexp_extract_all(body, F.lit(r"在庫数\s*([0-9,]+)\s*枚"), F.lit(1)), F.lit(0))
    stock = lambda body: F.coalesce(F.regexp_replace(number(body), ",", "").try_cast("double"), F.when(body.rlike(SOLD_OUT), 0.0))
    read = text.once(text.decode_html(F.col("html")), lambda body: F.struct(stock(body).alias("stock"), F.contains(body, F.lit(PRICED)).alias("priced")))
    state = lambda t: F.coalesce(F.upper(F.get(F.regexp_extract_all(t, F.lit(r"(?i)〔状態([A-D]-?)〕"), F.lit(1)), F.lit(0))), F.lit("A"))
    headed = text.once(title, lambda t: F.struct(t.alias("title"), state(t).alias("state")))
    address = F.regexp_extract(text.given(F.col("url")), at_host(r"(?i)HOST/product/[0-9]+", host), 0)
    out = pages.select("url", headed.alias("head"), address.alias("product_url"), read.alias("read")).select("url", "head.title", "product_url", "head.state", "read.stock", "read.priced")
    return out.withColumn("valid", (F.col("title") != "") & (F.col("product_url") != "") & (F.col("priced") | F.col("stock").isNotNull())).drop("priced")
