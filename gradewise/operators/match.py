"""Cards to shop products: catalog entries, blocked scoring, all-keys matching, catalog merges and link upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.functions import text
from gradewise.sources.shared import cut

# What marks a graded item, the points of a score, and the least score of a match.
GRADED = r"(?i)(?:PSA|ARS|CGC|BGS|ACE)\s*10|鑑定済"
NAME_POINTS, BASE_POINTS, NUMBER_POINTS, SET_POINTS, RARITY_POINTS = 10, 6, 10, 4, 2
KEY_POINTS, KEY_LENGTH = 2.0, 8
THRESHOLD = 11
#: Longest piece of a key by which texts and keys meet, and the bits of a filter of pieces.
GRAM = 3
BLOOM_BITS = 1 << 21
#: Tasks of a core over titles to parse.
TASKS = 4
#: Lengths of the beginnings by which a text meets those that contain it.
WIDTHS = 1, 2, 4, 8, 16


def sold_as_new(state: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(state, F.lit("")), F.lit("A"))) == "A"


def matchable(state: Column, name: Column) -> Column:
    return sold_as_new(state) & ~text.given(name).rlike(GRADED)


def catalog_entries(listed: DataFrame, today: str) -> DataFrame:
    """Catalog rows (id, name, url, state, stock, observed_at, keys, pos) of listed products (id, title,
    url, state, model, stock, pos): the name is the title without its state, with the model in brackets; the keys are the name, its parts and
    two joins of them, each once."""
    full = text.collapse(F.concat(text.strip_state(F.col("title")), F.when(text.given(F.col("model")) != "", F.concat(F.lit(" ["), F.col("model"), F.lit("]"))).otherwise("")))
    out = spread(listed).select("id", full.alias("name"), "url", F.coalesce(F.nullif("state", F.lit("")), F.lit("A")).alias("state"), "stock", F.lit(today).cast("date").alias("observed_at"), "pos")
    joined = [F.col("name"), *[part(k) for k in ("base", "card_no", "set_code", "rarity")], F.concat(*[part(k) for k in ("base", "rarity", "card_no", "set_code")]), F.concat(*[part(k) for k in ("base", "card_no", "set_code")])]
    keys = F.array_distinct(F.filter(F.array(*map(text.loose, joined)), lambda k: k != ""))
    return with_parts(out).select(*out.columns, keys.alias("keys"))


def part(name: str) -> Column:
    """A part of a title that ``with_parts`` added."""
    return F.col("part")[name]


def with_parts(titles: DataFrame, name: str = "name", model: str | None = None, exact: str | None = None) -> DataFrame:
    """Adds the components of a title as a struct ``part``, and its display name ``display``."""
    some = lambda c: None if c is None else F.col(c)
    return titles.withColumn("part", text.components(F.col(name), some(model), some(exact))).withColumn("display", text.once(F.col("part"), text.named))


def spread(titles: DataFrame) -> DataFrame:
    """Titles dealt to all cores: parsing one takes far longer than reading it, so files and shuffles
    that are small in bytes would leave it to a few tasks."""
    return titles.repartition(TASKS * titles.sparkSession.sparkContext.defaultParallelism)


def _alike(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def blocked_match(cards: DataFrame, catalog: DataFrame, invalid: DataFrame | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """(id, url, score): each card's best catalog entry.

    ``cards`` has id, name, model and rarity, ``catalog`` url, name, state, keys and pos. If any entry
    has the card's number and set code, only those are candidates; else those of the same number; a
    card without a number has none. The two are separate equi-joins. Graded items, other states and
    ``invalid`` URLs are left out only afterwards, so they keep a block from falling back. Of equal
    scores the first entry wins.

    A score is that of an entry's profile (set code, rarity, and which of number, code and rarity
    are among its keys) and that of its own texts (name, base, other keys). Cards meet each profile of
    their block once, and of the entries only those of families (equal number, finish and base) that share a
    text with them (``related``): any other scores what the first entry of its profile does. Cards with
    equal parts are compared once, and the best is one value, kept by partial aggregation.
    """
    keyed = lambda name: {"name": name, "base": part("base"), "number": part("card_no"), "code": part("set_code"), "rare": part("rarity")}
    titles = with_parts(spread(cards.select("name", "model", "rarity").distinct()), "name", "model", "rarity")
    left = titles.select(F.struct("name", "model", "rarity").alias("title"), *[text.loose(c).alias(f"l_{k}") for k, c in keyed(F.col("display")).items()], part("finish").alias("l_finish"))
    # Titles are written before they are filtered: a filter would go down to the files and parse each once more, in few tasks.
    left = cut(left.select("title", F.struct(*left.columns[1:]).alias("parts"))).where("parts.l_number <> ''")
    entries = with_parts(catalog.select("url", "name", "state", "pos", "keys")).withColumnRenamed("name", "shown")
    entries = entries.select("url", "state", "pos", "shown", F.filter(F.transform("keys", text.loose), lambda k: k != "").alias("keys"), part("finish").alias("finish"), *[text.loose(c).alias(k) for k, c in keyed(F.col("shown")).items()])
    entries = cut(entries).where("number <> ''")
    blocks = entries.where("code <> ''").select(F.col("number").alias("l_number"), F.col("code").alias("l_code")).distinct().withColumn("exact", F.lit(True))
    # The ids are given to rows that are written, as they must not change when they are computed again.
    asked = cut(left.select("parts").distinct().select("parts", "parts.*").join(blocks, ["l_number", "l_code"], "left")).withColumn("t", F.monotonically_increasing_id())
    usable = entries.where(matchable(F.col("state"), F.col("shown")))
    if invalid is not None:
        usable = usable.join(invalid.select("url").distinct(), "url", "left_anti")
    shared = {"number": F.lit(True), "code": F.col("code") != F.col("number"), "rare": ~F.col("rare").isin(F.col("number"), F.col("code"))}
    held = F.coalesce("keys", F.array().cast("array<string>"))
    is_part = lambda c: lambda k: k == F.col(c)
    times = [F.when(first, F.size(F.filter(held, is_part(c)))).otherwise(0).alias(f"n_{c}") for c, first in shared.items()]
    own = F.filter(held, lambda k: ~k.isin(*[F.col(c) for c in shared])).alias("own")
    profile = ["number", "code", "rare", "finish", *[f"n_{c}" for c in shared]]
    usable = usable.select("*", *times, own).groupBy(*profile, "name", "base", "own").agg(F.min(F.struct("pos", "url")).alias("first"))
    usable = cut(usable.withColumn("family", F.when(F.col("base") != "", F.col("base")).otherwise(F.col("name"))))
    same = (F.col("l_number") == F.col("number")) & (F.col("l_finish") == F.col("finish"))

    def met(some: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
        return some.where("exact").join(right, cond & (F.col("l_code") == F.col("code"))).unionByName(some.where("exact IS NULL").join(right, cond))

    points = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    worth = lambda k: F.least(F.lit(KEY_POINTS), F.length(k) / KEY_LENGTH)
    of_profile = float(NUMBER_POINTS) + points((F.col("l_code") != "") & (F.col("l_code") == F.col("code")), SET_POINTS) + points((F.col("l_rare") != "") & (F.col("l_rare") == F.col("rare")), RARITY_POINTS)
    for c in shared:
        of_profile += F.when(F.contains(F.col("l_name"), F.col(c)), F.col(f"n_{c}") * worth(F.col(c))).otherwise(0.0)
    of_texts = (
        points(_alike(F.col("l_name"), F.col("name")), NAME_POINTS)
        + points(_alike(F.col("l_base"), F.col("base")), BASE_POINTS)
        + F.aggregate(F.filter("own", lambda k: F.contains(F.col("l_name"), k)), F.lit(0.0), lambda s, k: s + worth(k))
    )
    profiles = usable.groupBy(*profile).agg(F.min("first").alias("first"))
    close = asked.join(related(asked, usable), "t").withColumnRenamed("family", "of")
    found = met(asked, profiles, same).select("t", of_profile.alias("score"), "first")
    found = found.unionByName(met(close, usable, same & (F.col("of") == F.col("family"))).select("t", (of_profile + of_texts).alias("score"), "first"))
    top = found.where(F.col("score") >= threshold).groupBy("t").agg(F.max_by(F.struct("first.url", "score"), F.struct("score", -F.col("first.pos"))).alias("b"))
    best = left.join(asked.select("parts", "t").join(top, "t").select("parts", "b"), "parts").select(F.col("title").alias("of"), "b")
    title = F.struct("name", "model", "rarity")
    return cards.select("id", title.alias("title")).join(best, F.col("title").eqNullSafe(F.col("of"))).select("id", "b.url", "b.score")


def related(asked: DataFrame, usable: DataFrame) -> DataFrame:
    """(t, family), each once: the families of entries that share a text with a card's parts, so that
    the entry's name or base and the card's contain one another or an own key stands in the card's name."""
    block = ["number", "finish"]
    sides = asked.select("t", F.col("l_number").alias("number"), F.col("l_finish").alias("finish"), "l_name", "l_base")
    # A text of an entry that contains another of it adds no family.
    every = F.array_distinct(F.array_append("own", F.col("name")))
    least = F.filter(every, lambda k: (k != "") & ~F.exists(every, lambda j: (j != "") & (j != k) & F.contains(k, j)))
    texts = usable.select(*block, "family", F.explode(least).alias("needle")).distinct()
    names = usable.select(*block, "family", F.col("name").alias("hay")).distinct()
    bases = usable.where("base <> ''").select(*block, "family").distinct()
    asked_bases = sides.select(*block, "l_base").distinct()
    alike = containing(bases.withColumn("needle", F.col("family")), asked_bases.withColumn("hay", F.col("l_base")), block)
    alike = alike.unionByName(containing(asked_bases.withColumn("needle", F.col("l_base")), bases.withColumn("hay", F.col("family")), block), allowMissingColumns=True)
    out = containing(texts, sides.select("t", *block, F.col("l_name").alias("hay")), block).select("t", "family")
    out = out.unionByName(containing(sides.select("t", *block, F.col("l_name").alias("needle")), names, block).select("t", "family"))
    return out.unionByName(sides.join(alike.select(*block, "l_base", "family").distinct(), [*block, "l_base"]).select("t", "family")).distinct()


def containing(needles: DataFrame, hays: DataFrame, block: list[str]) -> DataFrame:
    """The rows of ``needles`` (needle) and ``hays`` (hay) of equal ``block`` where the hay contains the
    needle, which is not empty. They meet on the needle's beginning, of the greatest of WIDTHS that it
    has; of a hay only pieces that begin a needle are shuffled, which a Bloom filter decides."""
    width = F.coalesce(*[F.when(F.length("needle") >= w, F.lit(w)) for w in reversed(WIDTHS)])
    needles = needles.where("needle <> ''").withColumn("gram", F.substring(F.col("needle"), F.lit(1), width))
    widths = sorted(r["w"] for r in needles.select(width.alias("w")).distinct().collect())  # of WIDTHS
    pieces = hays.withColumn("gram", F.explode(grams(F.col("hay"), widths))).where(membership(needles.select("gram").distinct(), "gram")(F.col("gram")))
    return needles.join(pieces, [*block, "gram"]).where(F.contains(F.col("hay"), F.col("needle"))).drop("gram")


def grams(c: Column, widths: list[int]) -> Column:
    """The distinct pieces of a text of these widths; of width 0 the empty one."""

    def pieces(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(c) - n + 1)
        return F.when(F.length(c) >= n, F.transform(places, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[pieces(n) if n else F.array(F.lit("")) for n in widths])) if widths else F.array().cast("array<string>")


def membership(values: DataFrame, column: str, bits: int = BLOOM_BITS) -> Callable[[Column], Column]:
    """A test whether a text may be among ``values``: a Bloom filter of ``bits`` bits, of bounded size
    whatever the number of values, as a scalar subquery. It is never wrong where it says no."""
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]
    set_bits = values.select(F.explode(F.array(*places(F.col(column)))).alias("p")).groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("word"))
    every = values.sparkSession.range(bits // 64).join(set_bits, "id", "left")
    dense = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))), lambda x: x["word"]).alias("words"))
    words = dense.scalar()

    def may_hold(c: Column) -> Column:
        hit = [F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in places(c)]
        return hit[0] & hit[1]

    return may_hold


def contained_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(t, finish, held): for each text of (t, hay, finish) the keys of ``keys`` (key, none empty) that stand in
    it, as structs (n, key) in order, with n the number of texts that have the key's anchor.

    Texts and keys meet on the anchor: a piece of the key (GRAM letters where it is so long), of these
    the one that stands in the fewest texts; then the key is tested. Pieces of texts are counted only
    if a key has them, and shuffled with the text only if they are anchors, which Bloom filters of bounded size
    decide at the texts. Anchors that very many texts have are split by adaptive execution.
    """
    width = F.least(F.length("key"), F.lit(GRAM))
    keys = cut(keys.select("key").distinct().withColumn("width", width))
    widths = sorted(r["width"] for r in keys.select("width").distinct().collect())  # of 1 to GRAM
    texts = cut(texts.withColumn("grams", text.once(F.col("hay"), lambda c: grams(c, widths))))
    places = F.sequence(F.lit(1), F.length("key") - F.col("width") + 1)
    pieces = keys.select("key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("key"), i, F.col("width"))))).alias("gram"))
    of_texts = texts.select("t", "hay", "finish", F.explode("grams").alias("gram"))
    common = of_texts.where(membership(pieces, "gram")(F.col("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text has is no anchor: its key stands in no text.
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a")
    anchors = cut(pieces.join(common, "gram", "left").groupBy("key").agg(rarest).where("a.n > 0").select("key", "a.n", "a.gram"))
    met = of_texts.where(membership(anchors, "gram")(F.col("gram"))).join(anchors, "gram").where(F.contains(F.col("hay"), F.col("key")))
    return met.groupBy("t", "finish").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("held"))


def all_keys_match(cards: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, url): the first catalog entry of state A whose every key stands in the card's text, with
    equal finish. ``cards`` has id, name, model, variant, rarity and query.

    Equal texts of cards, equal entries and equal keys count once. The keys that stand in a text are
    found first (``contained_keys``). Entries are then reached key by key, the rarest key first: a text
    goes on from a prefix of an entry's keys to the prefixes that are one key longer, by an equi-join
    for each length. So a text costs the prefixes that stand in it as a whole, however many
    entries share one of its keys.
    """
    parts = [F.nullif(text.given(F.col(c)), F.lit("")) for c in ("name", "model", "variant", "rarity", "query")]
    entries = catalog.where(sold_as_new(F.col("state")) & (F.size("keys") > 0)).select(F.array_sort(F.array_distinct(F.transform("keys", text.loose))).alias("keys"), text.finish_kind(F.col("name")).alias("finish"), F.struct("pos", "url").alias("at"))
    entries = entries.groupBy("keys", "finish").agg(F.min("at").alias("first"))
    # An empty key, as of marks alone or null, stands in every text.
    entries = cut(entries.withColumn("keys", F.filter("keys", lambda k: k != "")))
    full = text.loose(F.concat_ws(" ", *parts))
    hay = cut(cards.select("id", full.alias("hay"), text.finish_kind(F.col("name")).alias("finish")))
    # The ids are given to rows that are written, as they must not change when they are computed again.
    texts = cut(hay.select("hay", "finish").distinct()).withColumn("t", F.monotonically_increasing_id())
    held = cut(contained_keys(texts, entries.select(F.explode("keys").alias("key"))))
    ranks = held.select(F.explode("held").alias("k")).select("k.n", "k.key").distinct()
    named = entries.withColumn("entry", F.monotonically_increasing_id())
    listed = named.select("entry", "finish", "first", F.size("keys").alias("size"), F.explode("keys").alias("key")).join(ranks, "key")
    listed = listed.groupBy("entry", "finish", "first", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    # An entry with a key that no text has matches nothing.
    reached = cut(listed.where(F.size("keys") == F.col("size")).select("finish", "first", F.transform("keys", lambda k: k["key"]).alias("keys")))
    found = texts.join(entries.where(F.size("keys") == 0).groupBy("finish").agg(F.min("first").alias("first")), "finish").select("t", "first")
    for step in prefix_steps(held.select("t", "finish", F.transform("held", lambda k: k["key"]).alias("held")), reached):
        found = found.unionByName(step.where("first IS NOT NULL").select("t", "first"))
    best = texts.join(found.groupBy("t").agg(F.min("first").alias("first")), "t").select("hay", "finish", "first")
    return hay.join(best, ["hay", "finish"]).groupBy("id").agg(F.min("first").alias("first")).select("id", "first.url")


def prefix_steps(held: DataFrame, entries: DataFrame) -> list[DataFrame]:
    """By length, the prefixes of entries' keys (finish, keys, first) that texts (t, finish, held) hold as a
    whole: (t, finish, held, last, prefix, first), where ``first`` is that of an entry whose keys end there.
    ``held`` and ``keys`` are in one order."""
    longest = entries.agg(F.max(F.size("keys"))).first()[0] or 0
    now, out = held.withColumn("last", F.lit(0)).withColumn("prefix", F.array().cast("array<string>")), []
    for n in range(1, longest + 1):
        ends = F.min(F.when(F.size("keys") == n, F.col("first"))).alias("first")
        known = entries.where(F.size("keys") >= n).groupBy("finish", F.slice("keys", 1, n).alias("prefix")).agg(ends)
        more = now.select("t", "finish", "held", "last", "prefix", F.posexplode("held").alias("at", "key")).where("at >= last")
        now = more.select("t", "finish", "held", (F.col("at") + 1).alias("last"), F.array_append("prefix", F.col("key")).alias("prefix")).join(known, ["finish", "prefix"])
        now = cut(now)
        out.append(now)
        now = now.drop("first")
    return out


def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Union by URL: the last catalog's values, the first occurrence's place."""
    every = None
    for rank, c in enumerate(catalogs):
        c = c.where("url IS NOT NULL AND url <> ''").withColumn("__rank", F.lit(rank))
        every = c if every is None else every.unionByName(c)
    place = F.struct(F.col("__rank"), F.col("pos"))
    values = [c for c in every.columns if c not in ("url", "pos", "__rank")]
    out = every.groupBy("url").agg(F.min(place).alias("first"), F.max_by(F.struct(*values), place).alias("v"))
    return out.select("url", "v.*", F.struct("first.__rank", "first.pos").alias("place"))


def inject_overrides(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    return catalog.unionByName(overrides.join(catalog, "url", "left_anti"), allowMissingColumns=True)


def keep_links(cards: DataFrame, matched: DataFrame, catalog: DataFrame, invalid: DataFrame) -> DataFrame:
    """The new match's URL, else the old one if its entry is matchable and not invalid, else null."""
    usable = catalog.where(matchable(F.col("state"), F.col("name"))).select("url").distinct().join(invalid, "url", "left_anti").withColumn("good", F.lit(True))
    out = cards.join(matched.groupBy("id").agg(F.min("url").alias("new")), "id", "left").join(usable, "url", "left")
    return out.select("id", F.coalesce("new", F.when(F.col("good"), F.col("url"))).alias("url"))


def carry_forward(cards: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the previous run by id; of repeated ids the last row counts."""
    last = previous.groupBy("id").agg(F.max_by(F.struct(*columns), "pos").alias("v")).select("id", "v.*")
    return cards.join(last, "id", "left")


def wanted(cards: DataFrame) -> DataFrame:
    """The modern and promo cards of (id, name, model, rarity, pos), with their set code, whether they
    are promos, and their target query and its key."""
    out = with_parts(cards, "name", "model", "rarity").withColumn("promo", text.is_promo(F.col("name"), part("set_code")))
    out = out.withColumn("query", text.target_query(part("card_no"), part("set_code"))).withColumn("modern", text.is_modern(text.set_code_of_card(F.col("name"), F.col("model"))))
    return out.where("modern OR promo").select(*cards.columns, F.upper(part("set_code")).alias("code"), "promo", "query", text.loose(F.col("query")).alias("key"))


def unmatched_queue(wanted_cards: DataFrame, matched: DataFrame, attempted: DataFrame, recheck: DataFrame, batch: int = 40) -> DataFrame:
    """The next target queries of ``wanted`` cards: those unmatched, not tried yet (by key) or marked for
    recheck, forced ones first, then promos, in source order, each key once. A batch of 0 or less is all."""
    out = wanted_cards.where("key <> ''").join(matched.select("id").distinct(), "id", "left_anti")
    out = out.join(attempted.select("key").distinct().withColumn("tried", F.lit(True)), "key", "left").join(recheck.select("id").distinct().withColumn("forced", F.lit(True)), "id", "left")
    first = F.min(F.struct("pos", "id", "query", "promo", F.coalesce("forced", F.lit(False)).alias("forced")))
    out = out.where("tried IS NULL OR forced").groupBy("key").agg(first.alias("c")).select("key", "c.*").orderBy(F.desc("forced"), F.desc("promo"), "pos")
    return out.limit(batch) if batch > 0 else out


def attempted_after(attempted: DataFrame, queue: DataFrame) -> DataFrame:
    """The keys tried so far and those of a queue, whether they found anything or not."""
    return attempted.select("key").union(queue.select("key")).distinct()


def seeds(cards: DataFrame, completed: DataFrame, top: int = 0) -> DataFrame:
    """Set codes to crawl: (code, n, promo) of ``wanted`` cards, promos first, then the most cards; of the
    first ``top`` (all, if 0) those not completed."""
    out = cards.where("code <> ''").groupBy("code").agg(F.count("*").alias("n")).withColumn("promo", F.col("code").rlike(r"(?i)-P\z"))
    order = [F.desc("promo"), F.desc("n"), F.col("code").asc()]
    out = out.orderBy(*order).limit(top) if top > 0 else out
    return out.join(completed.select("code").distinct(), "code", "left_anti").orderBy(*order)


def fresh_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """The items of a page whose URL has not been seen, each URL once (the first)."""
    return items.join(seen.select("url").distinct(), "url", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).where("n = 1").drop("n")


def upsert(rows: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``new`` (at most one row a key) where it has the key."""
    found = new.select(F.col(key).alias("new_key"), F.struct(*columns).alias("new_values"))
    out = rows.join(found, F.col(key) == F.col("new_key"), "left")
    values = {c: F.when(F.col("new_values").isNotNull(), F.col(f"new_values.{c}")).otherwise(F.col(c)) for c in columns}
    return out.select(*[values[c].alias(c) if c in values else c for c in rows.columns])


def relink(cards: DataFrame, links: DataFrame, legacy: tuple[str, ...] = ("searchUrl", "queryName", "state", "shopName")) -> DataFrame:
    """Cards with the link of ``links`` (id, url) as ``url``, null where there is none, and without the
    columns of earlier versions."""
    return cards.drop("url", *legacy).join(links.select("id", "url"), "id", "left")


def remaining_rechecks(recheck: DataFrame, links: DataFrame) -> DataFrame:
    """Cards to recheck that have no link yet."""
    return recheck.select("id").distinct().join(links.where("url IS NOT NULL AND url <> ''").select("id"), "id", "left_anti")


def link_counts(cards: DataFrame, direct: Column) -> DataFrame:
    """How many cards there are, have a shop link ``url``, and have a direct market link."""
    return cards.agg(F.count("*").alias("n"), F.count_if(text.given(F.col("url")) != "").alias("matched"), F.count_if(direct).alias("direct"))


def coverage(cards: DataFrame) -> DataFrame:
    """total, linked, missing, rate (percent; 0 without cards) of cards with a column ``url``."""
    linked = F.count_if(F.coalesce(F.col("url"), F.lit("")) != "")
    out = cards.agg(F.count("*").alias("total"), linked.alias("linked"))
    return out.select("total", "linked", (F.col("total") - F.col("linked")).alias("missing"), F.when(F.col("total") > 0, F.col("linked") / F.col("total") * 100).otherwise(0.0).alias("rate"))


def grading_aliases(population: DataFrame) -> DataFrame:
    """(key, row): population rows (query, rate, total, count, card_no, source_set, pos) under the short
    codes of their query's set and of their label; the last row of a key wins."""
    form = rf"(?i)^{text.LANGUAGE}\s+(.+?)\s+([0-9]+)\z"
    known = text.given(F.col("query")).rlike(form)
    number = F.when(known, F.regexp_extract("query", form, 2)).otherwise(text.tidy(text.given(F.col("card_no"))))
    codes = F.array(F.when(known, text.short_code(F.regexp_extract("query", form, 1))), text.short_code(F.nullif(text.set_of_label(F.col("source_set")), F.lit(""))))
    names = population.select("rate", "total", "count", "pos", number.alias("number"), F.posexplode(codes).alias("at", "code")).where("code <> '' AND number <> ''")
    key = F.concat_ws(" ", F.lit(text.LANGUAGE), "code", "number")
    return names.groupBy(key.alias("key")).agg(F.max_by(F.struct("rate", "total", "count"), F.struct("pos", "at")).alias("row"))


def with_population(cards: DataFrame, population: DataFrame, min_rate: float = 1.0, min_total: float = 500.0) -> DataFrame:
    """rate, total and count of the first candidate key that is known, as a query before as an alias, if
    all are there and total and rate suffice. ``cards`` has id and psa_query."""
    own = population.groupBy(F.col("query").alias("key")).agg(F.max_by(F.struct("rate", "total", "count"), "pos").alias("row")).withColumn("kind", F.lit(0))
    known = own.unionByName(grading_aliases(population).withColumn("kind", F.lit(1)))
    keys = cards.select("id", F.posexplode(text.grading_candidates(F.col("psa_query"))).alias("at", "key"))
    found = keys.join(known, "key").groupBy("id").agg(F.min_by("row", F.struct("at", "kind")).alias("row"))
    good = (F.col("row.total") >= min_total) & (F.col("row.rate") >= min_rate) & F.col("row.count").isNotNull()
    return cards.join(found, "id", "left").select(*cards.columns, *[F.when(good, F.col(f"row.{c}")).alias(c) for c in ("rate", "total", "count")])
