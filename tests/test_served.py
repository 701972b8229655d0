"""Pages by key, text search by index and the guide against plain forms."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from gradewise.operators import keyset, profit, text_index
from gradewise.plans.params import ProfitQuery
from gradewise.sources.cards import CARD, MANIFEST, read_catalog, read_json



def some_cards(spark, n, seed=1):
    """Cards with many ties, missing values, and one name that a third of them has."""
    rnd = random.Random(seed)
    names = ["Pikachu", "ピカチュウ", "リザードン ex", "Mew-Two 12", "", None, "a%b_c", "１２３", "é\tx"]
    rows = []
    for pos in range(n):
        r = dict.fromkeys(CARD.fieldNames()) | {"id": f"k{pos}", "name": "Pikachu" if rnd.random() < 0.33 else rnd.choice(names), "model": rnd.choice(["SV1", "M-P", None]), "pos": pos}
        for f in CARD.fields[5:]:
            kind = f.dataType.typeName()
            r[f.name] = rnd.choice([None, 0, 1, 2, 5]) if kind == "long" else rnd.choice([None, "2026-01-01", "2026-02-02"]) if kind == "string" else rnd.choice([None, -1.5, 0.0, 2.5, rnd.uniform(1, 90000)])
        r["price"], r["snkPsa10Price"] = rnd.choice([0.0, None, 500.0, 20000.0]), rnd.choice([None, 14000.0, 60000.0, 90000.0])
        rows.append(r)
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CARD.fields) + ", pos bigint").repartition(3)


def walked(spark, folder, q):
    out, key, pages = [], None, 0
    while True:
        shown = keyset.page(spark, folder, q, key)
        ids = [r["id"] for r in shown.orderBy(*profit.order(q.sort)).collect()]
        if not ids:
            return out, pages
        out, pages = out + ids, pages + 1
        assert len(ids) <= q.limit
        key = keyset.key_of(shown, q.sort)


#: One measure of each kind of missing value and of each type; all orders share the rest.
@pytest.mark.parametrize("sort", [f"{m}-{d}" for m in ("roi", "tx", "updated", "listings") for d in ("asc", "desc")])
def test_pages_by_key_are_the_whole_order(spark, tmp_path, sort):
    cards = some_cards(spark, 80).cache()
    q = ProfitQuery(tx=0, roi=-1e9, psaMax=None, sort=sort, limit=25)
    keyset.write_order(cards, str(tmp_path), sort, per_range=24)
    want = [r["id"] for r in profit.matches(profit.with_profit(cards), q).orderBy(*profit.order(sort)).collect()]
    got, pages = walked(spark, str(tmp_path), q)
    assert got == want and pages == -(-len(want) // 25)


def test_a_late_page_opens_the_folders_that_it_needs(spark, tmp_path):
    cards, q = some_cards(spark, 2000, 2), ProfitQuery(tx=0, roi=-1e9, psaMax=None, sort="chg30-desc", limit=20)
    keyset.write_order(cards, str(tmp_path), q.sort, per_range=100)
    found = profit.matches(profit.with_profit(cards), q).orderBy(*profit.order(q.sort)).select("id", "pos", F.col("chg30").alias("order_value")).collect()
    at = 400
    want = [r["id"] for r in found[at : at + 20]]
    key, rows = found[at - 1], f"{tmp_path}/{q.sort}/fee=13000/rows"
    folders = sorted(int(f.split("=")[1]) for f in os.listdir(rows) if f.startswith("range="))
    assert len(folders) == 20
    ends = {r["range"]: r["last"] for r in spark.read.parquet(f"{tmp_path}/{q.sort}/fee=13000/ends").collect()}
    after = lambda last: last["order_value"] is None or last["order_value"] < key["order_value"] or (last["order_value"] == key["order_value"] and last["pos"] > key["pos"])
    first = min(n for n in folders if after(ends[n]))
    for n in folders:
        if not first <= n < first + 2:
            shutil.rmtree(f"{rows}/range={n}")
    assert [r["id"] for r in keyset.page(spark, str(tmp_path), q, key).orderBy(*profit.order(q.sort)).collect()] == want


def test_pages_of_no_cards(spark, tmp_path):
    keyset.write_order(some_cards(spark, 3).where("pos < 0"), str(tmp_path), "roi-desc")
    shown = keyset.page(spark, str(tmp_path), ProfitQuery())
    assert shown.count() == 0 and keyset.key_of(shown, "roi-desc") is None


def test_search_by_index_is_the_scan(spark, tmp_path):
    cards = some_cards(spark, 200, 3).cache()
    text_index.write_index(cards, str(tmp_path), per_range=150)
    for needle in ("P", "pi", "ピ", "ピカチ", "リザードンEX", "-", "a%b", "１２", "12 sv1", "é", "k19", "様子見", "nothing here", "u\0"):
        q = ProfitQuery(tx=0, roi=-1e9, psaMax=None, q=needle)
        want = sorted(r["pos"] for r in profit.matches(profit.with_profit(cards), q).collect())
        assert sorted(r["pos"] for r in text_index.indexed(cards, str(tmp_path), q).collect()) == want, needle


def test_the_index_of_no_cards(spark, tmp_path):
    none = some_cards(spark, 3).where("pos < 0")
    text_index.write_index(none, str(tmp_path))
    for needle in ("a", "abc", "-"):
        assert text_index.indexed(none, str(tmp_path), ProfitQuery(q=needle)).count() == 0


def test_candidates_are_few(spark, tmp_path):
    cards = some_cards(spark, 300, 4)
    text_index.write_index(cards, str(tmp_path), per_range=200)
    assert text_index.candidates(spark, str(tmp_path), "sv1 k123").count() <= 3
    assert text_index.candidates(spark, str(tmp_path), "---") is None


def test_the_index_is_a_list_for_each_piece_and_part(spark, tmp_path):
    """The rows of the index are pieces of parts, not pieces of cards: cards of equal names add none."""
    few, many = ([(pos, f"k{pos % 5}", "Pikachu", "SV1", None, None, 0, 0, 0, 0) for pos in range(n)] for n in (50, 4096))
    rows = []
    for i, data in enumerate((few, many)):
        cards = spark.createDataFrame(data, "pos bigint, id string, name string, model string, price double, snkPsa10Price double, tv7 bigint, tv30 bigint, p10tv7 bigint, p10tv30 bigint")
        text_index.write_index(cards, f"{tmp_path}/{i}")
        rows.append(spark.read.parquet(f"{tmp_path}/{i}/fee=13000/rows").count())
        for needle in ("k3", "K-3 未", "pika"):  # the first is shorter than a piece
            found = sorted(r["pos"] for r in text_index.candidates(spark, f"{tmp_path}/{i}", needle).collect())
            assert found == [pos for pos, *_ in data if needle == "pika" or pos % 5 == 3]
    assert rows[0] == rows[1] < 50


def test_many_searches_at_once_are_the_scans(spark, tmp_path):
    """Places over many parts, also negative ones; needles of each kind, equal in compact form, and absent ones."""
    cards = some_cards(spark, 300, 5).withColumn("pos", (F.col("pos") - 40) * 1500).cache()
    text_index.write_index(cards, str(tmp_path), per_range=60)
    needles = ["k1", "K-1", "-", "", "7", "sv1k2", "SV1 k2", "pikachu m", "様", "k1", "zzz", "z", "12 m-p k", "ピカチュウ"]
    q = ProfitQuery(tx=0, roi=-1e9, psaMax=None)
    want = sorted((n, r["pos"]) for n in dict.fromkeys(needles) for r in profit.matches(profit.with_profit(cards), ProfitQuery(tx=0, roi=-1e9, psaMax=None, q=n)).collect())
    assert sorted((r["needle"], r["pos"]) for r in text_index.indexed_each(cards, str(tmp_path), q, needles).collect()) == want


def test_a_search_tests_the_texts_of_its_candidates_alone(spark, tmp_path):
    """A filter on the text must not move below the join with the candidates, where it would see all cards."""
    cards = some_cards(spark, 300, 6).cache()
    text_index.write_index(cards, str(tmp_path))
    plan = text_index.indexed(cards, str(tmp_path), ProfitQuery(tx=0, roi=-1e9, psaMax=None, q="k123"))._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.splitlines() if "Contains(" in line]
    assert tests and all("Join" in line for line in tests)


def test_guide_prices(spark):
    rows = [(1, 50000.0, 10000.0), (2, 50499.0, 1e6), (3, 1000.0, 1.0), (4, None, 5.0), (5, 60000.0, None)]
    cards = spark.createDataFrame(rows, "id int, snkPsa10Price double, price double")
    got = {(r["id"], r["target_roi"]): (r["buy_price"], r["within"]) for r in profit.guided(cards).collect()}
    # 0.7 * 50000 - 13000 = 22000, by 1 - 0.3 * 0.75 = 0.775: 28387, so 28000.
    assert got[1, 0] == (28000.0, True) and got[2, 0][1] is False and got[3, 20] == (0.0, False) and got[5, 0][1] is None
    assert 4 not in {k[0] for k in got}
    grid = {(r["psa_price"], r["target_roi"]): (r["buy_price"], r["n_cards"], r["n_within"]) for r in profit.guide(cards).collect()}
    assert len(grid) == 3 * (31 + 30 + 50) and grid[50000, 0] == (28000.0, 2, 1) and grid[70000, 10][1:] == (0, 0)


def test_manifest_and_catalog_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"name": "SV1", "kind": "pop", "url": "https://h/1"}, {"name": "SV2", "kind": "spec", "url": "https://h/2", "needsReview": True, "note": "n"}]))
    rows = [tuple(r) for r in read_json(spark, str(tmp_path / "m.json"), MANIFEST).orderBy("name").collect()]
    assert rows == [("SV1", "pop", "https://h/1", None, None), ("SV2", "spec", "https://h/2", True, "n")]
    (tmp_path / "c.json").write_text(json.dumps([{"detailUrl": "u1", "name": "a", "state": "A", "stock": 3, "matchKeys": ["a", "b"], "other": 1}, {"name": "no address"}, {"detailUrl": "u2", "name": None}]))
    got = read_catalog(spark, str(tmp_path / "c.json")).orderBy("pos").collect()
    assert [(r["url"], r["name"], r["state"], r["stock"], r["keys"], r["pos"]) for r in got] == [("u1", "a", "A", 3.0, ["a", "b"], 0), ("u2", None, None, None, None, 2)]
    (tmp_path / "o.json").write_text(json.dumps({"not": "an array"}))
    assert read_catalog(spark, str(tmp_path / "o.json")).count() == 0
    assert read_catalog(spark, str(tmp_path / "none.json")).count() == 0
