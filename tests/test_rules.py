"""Scalar rules, the URL form of a search, histories against a plain form, and a scripted run of days."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.functions import text
from gradewise.operators import match, pages, profit, stock
from gradewise.plans.params import ProfitQuery
from gradewise.sources import sinks
from gradewise.sources.cards import CARD, assigned_json, read_json, read_population
from gradewise.streaming.buylist import append_daily


def test_url_round_trip():
    q = ProfitQuery(fee=9000.0, tx=3.0, priceMax=500.0, sort="chg7-asc", q="ピカ チュウ", hide=("watch",), showCalc=False)
    assert ProfitQuery.from_url(q.to_url()) == q
    assert ProfitQuery.from_url("?sort=nonsense&fee=-1&roi=x&guide=60&hide=none") == ProfitQuery()


def test_missing_file_is_empty(spark, tmp_path):
    assert read_json(spark, str(tmp_path / "none.json"), CARD).count() == 0


def test_display_name(spark):
    row = spark.createDataFrame([("メガゲンガーex SAR [M2a 240/193]",)], "t string").select(text.display_name(F.col("t"))).first()
    assert row[0] == "メガゲンガーex【SAR】{240/193} [M2a]"


def test_candidates(spark):
    row = spark.range(1).select(text.grading_candidates(F.lit("Pokemon Japanese S6A 093"))).first()
    assert row[0] == ["Pokemon Japanese S6A 093", "Pokemon Japanese S6A 93"]


def test_decrease_against_plain_form(spark):
    rnd = random.Random(3)
    series = {c: [rnd.choice([None, *map(float, range(9))]) for _ in range(40)] for c in range(20)}
    grid = spark.createDataFrame([(c, i, v) for c, s in series.items() for i, v in enumerate(s)], "card_id int, date_pos int, stock double")
    for r in stock.summary(grid).collect():
        s = series[r["card_id"]]
        for n in stock.WIDTHS:
            tail = s[-(n + 1) :]
            falls = [max(0.0, a - b) for a, b in zip(tail, tail[1:], strict=False) if a is not None and b is not None]
            want = int(sum(falls) / len(falls) * 100 + 0.5) / 100 if falls else None
            assert r[f"avg{n}"] == want
        assert r["samples"] == sum(v is not None for v in s)


def test_two_misses_make_a_link_invalid(spark):
    links = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "card_id int, url string")
    catalog = spark.createDataFrame([("b", "A", 2.0, None)], "url string, state string, stock double, observed_at date")
    misses = spark.createDataFrame([], "url string, misses int")
    none = spark.createDataFrame([], "url string"), spark.createDataFrame([], "card_id int")
    first = stock.catalog_run(links, catalog, misses, "2026-08-22")
    assert {r["card_id"]: r["outcome"] for r in first.collect()} == {1: "missed", 2: "missed", 3: "ok"}
    misses, bad, again = stock.next_state(first, *none)
    assert [tuple(r) for r in misses.collect()] == [("a", 1)] and bad.count() == 0 and again.count() == 2
    second = stock.catalog_run(links, catalog, misses, "2026-08-23")
    _, bad, _ = stock.next_state(second, bad, again)
    assert [r["url"] for r in bad.collect()] == ["a"]


def _sides(spark, cards, entries):
    left = spark.createDataFrame(cards, "id int, name string, model string, rarity string")
    listed = spark.createDataFrame([(i, t, f"u{i}", s, None, None, i) for i, t, s in entries], "id int, title string, url string, state string, model string, stock double, pos int")
    return left, match.catalog_entries(listed, "2026-08-22")


def test_exact_block_without_fallback(spark):
    left, right = _sides(spark, [(1, "x [s 001/002]", "", "")], [(7, "x PSA10 [s 001/002]", "A"), (8, "x [t 001/002]", "A")])
    assert match.blocked_match(left, right).count() == 0
    assert match.blocked_match(left, right.where("id = 8")).first()["url"] == "u8"


def test_match_scores_rejections_and_ties(spark):
    cards = [(1, "abcdefgh SR [s1 001/002]", "", ""), (2, "no number SR [s1]", "", ""), (3, "mirror(ミラー) [s1 005/006]", "", ""), (4, "other [s2 009/010]", "", "")]
    entries = [(1, "abcdefgh SR [s1 001/002]", "A"), (2, "abcdefgh SR [s1 001/002]", "A"), (3, "no number SR", "A"), (4, "mirror [s1 005/006]", "A"), (5, "mirror マスボ [s1 005/006]", "A"), (6, "mirror ミラー [s1 005/006]", "B"), (7, "unlike [s3 009/010]", "A"), (8, "other [s2 009/010]", "A")]
    left, right = _sides(spark, cards, entries)
    bad = spark.createDataFrame([("u8",)], "url string")
    got = {r["id"]: (r["url"], r["score"]) for r in match.blocked_match(left, right, bad).collect()}
    # Keys in the name abcdefghsr001002s1: base 1, number .75, set .25, rarity .25; of equal scores the first entry wins.
    # The entry's own name and joins of its parts stand in another order than the display name has.
    assert got[1] == ("u1", 6 + 10 + 4 + 2 + 1 + 0.75 + 0.25 + 0.25 + 2.0) and set(got) == {1}


# Titles with what the rules make of them: set code, number, rarity, base, finish, grading query.
TITLES = [
    ("ヒロシマのピカチュウ P [SV-P 261]", "SV-P", "261/SV-P", "P", "ヒロシマのピカチュウ", "", "Pokemon Japanese SV-P 261"),
    ("メガゲンガーex SAR [M2a 240/193]", "M2a", "240/193", "SAR", "メガゲンガーex", "", "Pokemon Japanese M2A 240"),
    ("ニンフィアVMAX HR: SA [S6a 093/069]", "S6a", "093/069", "HR", "ニンフィアVMAX", "", "Pokemon Japanese S6A 093"),
    ("ピカチュウ [PROMO 123 SV-P]", "SV-P", "123/SV-P", "", "ピカチュウ", "", "Pokemon Japanese PROMO 123"),
    ("ピカチュウ {012/sm-p}", "sm-p", "012/SM-P", "", "ピカチュウ {012/sm-p}", "", None),
    ("ピカチュウ {012/069} [sv9]", "sv9", "012/069", "", "ピカチュウ {012/069}", "", "Pokemon Japanese SV9"),
    ("リザードン [012/069]", "", "012/069", "", "リザードン", "", None),
    ("リザードン [S8b 012]", "S8b", "", "", "リザードン", "", "Pokemon Japanese S8B 012"),
    ("ボスの指令 S [S1 001/002]", "S1", "001/002", "", "ボスの指令 S", "", "Pokemon Japanese S1 001"),
    ("マスターボール [SV1 001/002]", "SV1", "001/002", "", "マスターボール", "", "Pokemon Japanese SV1 001"),
    ("マスターボールミラー [SV1 001/002]", "SV1", "001/002", "", "", "master-ball-mirror", "Pokemon Japanese SV1 001"),
    ("ヤドン(マスボミラー) [SV2a 079/165]", "SV2a", "079/165", "", "ヤドン", "master-ball-mirror", "Pokemon Japanese SV2A 079"),
    ("ヤドン モンボ [SV2a 079/165]", "SV2a", "079/165", "", "ヤドン", "monster-ball-mirror", "Pokemon Japanese SV2A 079"),
    ("ヤドン SAR 仕様 [SV2a 079/165]", "SV2a", "079/165", "", "ヤドン", "sar-style", "Pokemon Japanese SV2A 079"),
    ("カイリュー 1ED", "", "", "", "カイリュー", "first-edition", None),
    ("カイリュー A1EDX", "", "", "", "カイリュー A1EDX", "", None),
    ("リーリエ 旧裏 ★ [#025 x]", "", "", "", "リーリエ 旧裏 ★", "old-back", "Pokemon Japanese #025 X"),
    ("ゲッコウガ プロモ [XY-P 001]", "XY-P", "001/XY-P", "P", "ゲッコウガ", "", "Pokemon Japanese XY-P 001"),
    ("ゲッコウガ PR x", "", "", "P", "ゲッコウガ PR x", "", None),
    ("ゲッコウガ [M1 001/002]【UR】", "M1", "001/002", "UR", "ゲッコウガ", "", "Pokemon Japanese M1 001"),
    ("イーブイ　RRR：プロモ", "", "", "P", "イーブイ", "", None),
    ("Mew EX RR", "", "", "RR", "Mew EX", "", None),
    ("Hop", "", "", "", "Ho", "", None),
    ("", "", "", "", "", "", None),
]


def test_titles(spark):
    t = F.col("t")
    got = spark.createDataFrame([(x[0],) for x in TITLES], "t string").select("t", text.set_code(t), text.card_number(t), text.rarity(t), text.display_base(text.collapse(t)), text.finish_kind(t), text.grading_query(t)).collect()
    assert [tuple(r) for r in got] == TITLES


def test_parts_by_model_and_given_rarity(spark):
    row = spark.createDataFrame([("x", "012/034 y", "sr"), ("x", None, "SRX")], "t string, m string, r string").select(text.components(F.col("t"), F.col("m"), F.col("r")).alias("c")).select("c.*").collect()
    assert [(r["card_no"], r["rarity"]) for r in row] == [("012/034", "SR"), ("", "")]


def test_short_codes_and_labels(spark):
    cases = [("SV-P x", "SV-P"), ("pmcg1-2", "PMCG1-2"), ("S8B-Vmax Climax", "S8B"), ("m2-abc", "M2-ABC"), ("ABCD-E", "ABCD"), ("sm9 Tag", "SM9"), ("-x", "-X"), ("", "")]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(text.short_code(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in cases]
    label = spark.createDataFrame([("2023 Pokemon Japanese  Sv2a   Set",), ("none",)], "t string").select(text.set_of_label(F.col("t"))).collect()
    assert [r[0] for r in label] == ["SV2A SET", ""]


def test_population_falls_back_to_aliases(spark):
    population = spark.createDataFrame([("Pokemon Japanese S8B-Vmax Climax 245", 50.0, 900.0, 450.0, None, None, 0), ("other", 60.0, 700.0, 420.0, "93", "Pokemon Japanese S6a Eevee", 1), ("Pokemon Japanese X 1", 50.0, 499.0, 1.0, None, None, 2)], "query string, rate double, total double, count double, card_no string, source_set string, pos int")
    cards = spark.createDataFrame([(1, "Pokemon Japanese S8B 245"), (2, "Pokemon Japanese S6A 093"), (3, "Pokemon Japanese X 1"), (4, None)], "id int, psa_query string")
    got = {r["id"]: r["total"] for r in match.with_population(cards, population).collect()}
    assert got == {1: 900.0, 2: 700.0, 3: None, 4: None}


def test_all_keys_by_short_and_empty_keys(spark):
    cards = spark.createDataFrame([(1, "Ab X9", "m", None, "", ""), (2, "other", None, None, None, None)], "id int, name string, model string, variant string, rarity string, query string")
    entries = [("a", "A", "n", ["zz"], 1), ("b", "a", "n", ["x9", "ab"], 2), ("c", "A", "n", ["--"], 3), ("d", "B", "n", ["ab"], 0), ("e", "A", "n ミラー", ["ab"], 0), ("f", "A", "n", [], 0)]
    catalog = spark.createDataFrame(entries, "url string, state string, name string, keys array<string>, pos int")
    assert {r["id"]: r["url"] for r in match.all_keys_match(cards, catalog).collect()} == {1: "b", 2: "c"}


def test_all_keys_match_costs_what_stands_in_a_text(spark):
    """Many entries share a key with every text: a text reaches only the prefixes that it holds, not these entries."""
    n = 200
    cards = spark.createDataFrame([(i // 2, f"common item{i:04d}z", None, None, None, None) for i in range(n)], "id int, name string, model string, variant string, rarity string, query string")
    listed = [(f"u{i}", "A", "n", ["common", f"item{i:04d}z"] if i % 5 else ["common", f"item{i:04d}z", "absent"], i) for i in range(n)]
    listed += [("null", "A", "n", ["item0011z", None], -1), ("late", "A", "n", ["", "common", "item0010z"], 500)]
    catalog = spark.createDataFrame(listed, "url string, state string, name string, keys array<string>, pos int")
    got = {r["id"]: r["url"] for r in match.all_keys_match(cards, catalog).collect()}
    want = {}
    for i in range(n):
        for url, _, _, keys, pos in listed:
            if all((k or "") in f"commonitem{i:04d}z" for k in keys):
                want[i // 2] = min(want.get(i // 2, (pos, url)), (pos, url))
    assert got == {k: url for k, (_, url) in want.items()}
    held = spark.createDataFrame([(i, "", [f"item{i:04d}z", "common"]) for i in range(n)], "t bigint, finish string, held array<string>")
    entries = spark.createDataFrame([("", [f"item{i:04d}z", "common"], i) for i in range(n)], "finish string, keys array<string>, first int")
    assert [s.count() for s in match.prefix_steps(held, entries)] == [n, n]


def test_listing_and_product_pages(spark):
    item = '<li class="list_item_cell list_item_77 "><b>在庫数 1,204 枚</b><a href="https://shop.example/product/77" class="item_data_link"><img alt="〔状態A-〕Mew【RR】{012/069}"></a><span class="model_number_value">sv9</span></li>'
    markdown = "Markdown Content:\r\n[![Image 4: Mew【RR】{012/069}](https://i.example/a.jpg) 〔状態B〕Mew {012/069}[**sv9**] SOLD OUT](https://shop.example/product/78)\r\n[x](https://shop.example/product/79)"
    frame = spark.createDataFrame([(1, item * 2), (2, markdown)], "page_id int, body string")
    got = [(r["id"], r["state"], r["model"], r["stock"]) for r in pages.shop_items(frame).orderBy("page_id", "pos").collect()]
    assert got == [("77", "A-", "sv9", 1204.0)] * 2 + [("78", "B", "sv9", 0.0)]
    counts = spark.createDataFrame([('<a class="to_last_page pager_btn">12</a>?page=3',), ("?page=3&page=11",), ("page=9",)], "h string").select(pages.total_pages(F.col("h"))).collect()
    assert [r[0] for r in counts] == [12, 11, 1]
    html = [("https://shop.example/product/1", "<h1>〔状態b〕 A &amp;lt; B</h1> 在庫数 3 枚"), ("https://shop.example/product/2", "Title: X\n\n再入荷を知らせる"), ("https://shop.example/product/3", "# Y\nnothing"), ("https://elsewhere.example/4", "<h1>Z</h1>販売価格")]
    got = [(r["title"], r["state"], r["stock"], r["valid"]) for r in pages.product_page(spark.createDataFrame(html, "url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([("〔状態b〕 A < B", "B", 3.0, True), ("X", "A", 0.0, True), ("Y", "A", None, False), ("Z", "A", None, False)], key=str)


def test_written_outputs_are_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("1", "n", 2.5), ("2", None, None)], "id string, name string, price double")
    sinks.write_json(rows, f"{tmp_path}/cards")
    assert sorted(map(tuple, read_json(spark, f"{tmp_path}/cards", rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "broken.json").write_text("{not json")
    assert read_json(spark, str(tmp_path / "broken.json"), rows.schema).dropna("all").count() == 0
    (tmp_path / "p.json").write_text('{"byQuery": {"q": {"psa10Rate": 50.5, "psaTotal": 10, "psa10Count": 5, "cardNo": "1"}}}')
    assert read_population(spark, str(tmp_path / "p.json")).first().asDict() == {"query": "q", "rate": 50.5, "total": 10.0, "count": 5.0, "card_no": "1", "source_set": None, "pos": 0}
    script = spark.createDataFrame([('window.x = {"a": 1};\n',)], "t string")
    assert assigned_json(script, "t", T.StructType([T.StructField("a", T.IntegerType())])).first()["value"]["a"] == 1
    sinks.write_stock_run(f"{tmp_path}/run", cards=rows, invalid=rows.select("id"))
    assert spark.read.json(f"{tmp_path}/run/invalid").count() == 2


def test_postings_are_appended_once(spark, tmp_path):
    schema = "post_id string, image_hash string, posted_at timestamp, price double"
    now = "2026-08-22 10:00:00"
    day = lambda rows: spark.createDataFrame(rows, "post_id string, image_hash string, t string, price double").select("post_id", "image_hash", F.to_timestamp("t").alias("posted_at"), "price")
    folder, to, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for rows in ([("a", "1", now, 1.0), ("b", "2", now, 2.0)], [("a", "1", now, 1.0), ("c", "3", now, 3.0)]):
        day(rows).write.mode("append").parquet(folder)
        append_daily(spark, folder, spark.createDataFrame([], schema).schema, to, state).awaitTermination(120)
    assert sorted(r["post_id"] for r in spark.read.parquet(to).collect()) == ["a", "b", "c"]


def test_a_page_that_moved_and_is_rejected(spark):
    rows = [(1, "o", 200, True, "n", "B", 1.0), (2, "o", 200, True, "n", "A", None), (3, "o", 404, None, None, None, None), (4, "o", 500, None, None, None, None), (5, "o", None, None, None, None, None)]
    out = stock.product_run(spark.createDataFrame(rows, "card_id int, url string, http_status int, valid boolean, product_url string, state string, stock double"))
    got = {r["card_id"]: (r["outcome"], r["moved"], r["next_url"]) for r in out.collect()}
    assert got == {1: ("rejected", True, None), 2: ("moved", True, "n"), 3: ("invalid", False, None), 4: ("failed", False, "o"), 5: ("failed", False, "o")}
    bad, again = stock.next_product_state(out, spark.createDataFrame([], "url string"), spark.createDataFrame([(2,), (9,)], "card_id int"))
    assert {r["url"] for r in bad.collect()} == {"o", "n"} and {r["card_id"] for r in again.collect()} == {1, 3, 9}


def test_misses_of_unlinked_urls_stay(spark):
    outcomes = spark.createDataFrame([(1, "a", "ok", 1.0, None)], "card_id int, url string, outcome string, stock double, misses_next int")
    misses, _, _ = stock.next_state(outcomes, spark.createDataFrame([], "url string"), spark.createDataFrame([], "card_id int"), spark.createDataFrame([("a", 1), ("z", 1)], "url string, misses int"))
    assert [tuple(r) for r in misses.collect()] == [("z", 1)]


def test_missing_return_has_no_bar(spark):
    row = spark.createDataFrame([(None, None, None, None, None, None)], "price double, snkPsa10Price double, tv30 int, tv7 int, p10tv30 int, p10tv7 int")
    assert profit.with_profit(row).first()["bar_width"] is None


def test_sparse_and_dense_summaries_agree(spark):
    rnd = random.Random(4)
    rows = [(c, f"2026-01-{d:02d}", float(rnd.randrange(9))) for c in range(12) for d in range(1, 29) if rnd.random() < 0.7]
    obs = spark.createDataFrame(rows, "card_id int, d string, stock double").select("card_id", F.to_date("d").alias("obs_date"), "stock")
    sparse, dense = stock.summary(stock.placed(obs, 20)), stock.summary(stock.history(obs, 20))
    assert sorted(map(tuple, sparse.collect())) == sorted(map(tuple, dense.collect()))


def test_texts_meet_what_contains_them(spark):
    rnd = random.Random(5)
    some = lambda n: sorted({"".join(rnd.choice("abé漢") for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 17, 20]))) for _ in range(n)})
    needles = some(60)
    hays = [*some(40), *(h + n + h for h, n in zip(some(30), needles[::2], strict=False))]
    left = spark.createDataFrame([(i % 2, n) for i, n in enumerate(needles)], "block int, needle string")
    right = spark.createDataFrame([(i % 2, h) for i, h in enumerate(hays)], "block int, hay string").distinct()
    got = [tuple(r) for r in match.containing(left, right, ["block"]).select("block", "needle", "hay").collect()]
    want = {(i % 2, n, h) for i, n in enumerate(needles) for j, h in enumerate(hays) if n and n in h and i % 2 == j % 2}
    assert sorted(got) == sorted(want)


def test_blocked_match_compares_what_shares_a_text(spark, monkeypatch):
    n = 60
    names = ["".join(random.Random(i).choices("abcdefghjkmnopqrstuvwxyz", k=12)) for i in range(n)]
    left, right = _sides(spark, [(i, f"{x} [s1 001/002]", "", "") for i, x in enumerate(names)], [(100 + i, f"{x} {{001/002}} [s1]", "A") for i, x in enumerate(names[1:])])
    pairs, related = [], match.related
    monkeypatch.setattr(match, "related", lambda *a: pairs.append(related(*a)) or pairs[0])
    got = {r["id"]: r["url"] for r in match.blocked_match(left, right).collect()}
    # The first card shares the number and set code alone, which is a profile's score; of equal scores the first entry wins.
    assert got == {0: "u100"} | {i: f"u{99 + i}" for i in range(1, n)}
    assert pairs[0].count() == n - 1
