"""Streams against their batch forms, in several splits into batches, with replays."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gradewise.operators import buylist, match, profit, stock
from gradewise.sources import sinks
from gradewise.streaming import links
from gradewise.streaming.buylist import FirstOfKey, append_daily
from gradewise.streaming.state import append_available, combined, distinct_rows, first_rows



@pytest.fixture(autouse=True)
def few_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def posts_of(spark, rows):
    return spark.createDataFrame(rows, "post_id string, image_hash string, t int, price double").select("post_id", "image_hash", (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("t"))).alias("posted_at"), "price")


def some_posts(n, seed):
    rnd = random.Random(seed)
    return [(f"p{rnd.randrange(n // 2)}" if rnd.random() < 0.97 else None, rnd.choice([None, *[f"i{k}" for k in range(n // 3)]]), t, float(t)) for t in range(n)]


@pytest.mark.parametrize(("cuts", "files"), [([], None), ([1, 7, 30, 31], None), ([20, 40], 1)])
def test_a_stream_of_postings_is_the_batch_in_any_split(spark, tmp_path, cuts, files):
    rows = some_posts(60, len(cuts))
    folder, to, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = posts_of(spark, rows[:1]).schema
    edges = [0, *cuts, len(rows)]
    for a, b in zip(edges, edges[1:], strict=False):
        posts_of(spark, rows[a:b]).coalesce(1).write.mode("append").parquet(folder)
        if files is None:
            append_daily(spark, folder, schema, to, state).awaitTermination(200)
    if files is not None:
        append_daily(spark, folder, schema, to, state, files=files).awaitTermination(200)
    got = spark.read.parquet(to).select("post_id", "posted_at", "image_hash")
    want = buylist.new_posts(posts_of(spark, rows)).select("post_id", "posted_at", "image_hash")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_one_key_alone_is_enough(spark, tmp_path):
    folder, to, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    first = [("a", "1", 0, 1.0), ("b", None, 1, 1.0)]
    later = [("a", "9", 5, 1.0), ("c", "1", 6, 1.0), ("d", None, 7, 1.0), ("b", None, 8, 1.0), ("e", "9", 9, 1.0)]
    for rows in (first, later):
        posts_of(spark, rows).write.mode("append").parquet(folder)
        append_daily(spark, folder, posts_of(spark, rows).schema, to, state).awaitTermination(200)
    # e has the image of the second a, which was dropped for its id: that image was not seen.
    assert sorted(r["post_id"] for r in spark.read.parquet(to).collect()) == ["a", "b", "d", "e"]


def plain_outcomes(found):
    """By URL: the outcomes of runs in order, each run once."""
    out, state = {}, {}
    for run in sorted({f[1] for f in found}):
        for url, seen, kind, left in sorted({(f[0], *f[2:]) for f in found if f[1] == run}, key=str):
            state[url] = 0 if seen else state.get(url, 0) + 1
            if seen:
                outcome = "rejected" if (kind or "A") != "A" else "unknown" if left is None else "ok"
            else:
                outcome = "invalid" if state[url] >= stock.MISSES else "missed"
            out[url, run] = (url, run, outcome, state[url], left if outcome == "ok" else None)
    return sorted(out.values())


@pytest.mark.parametrize("batches", [[[1, 2, 3, 4, 5]], [[1], [2], [2], [3, 4], [4], [5, 3]], [[1, 2], [2, 3], [3, 4, 5]]])
def test_replayed_runs_count_once(spark, tmp_path, batches):
    rnd = random.Random(2)
    found = []
    for run in range(1, 6):
        for u in range(12):
            if rnd.random() < 0.85:
                seen = rnd.random() < 0.5
                fact = (f"u{u}", run, seen, rnd.choice([None, "A", "B"]) if seen else None, rnd.choice([None, 2.0, 0.0]) if seen else None)
                found += [fact] * rnd.choice([1, 1, 3])  # several cards share a URL
    folder, to, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], "url string, run bigint, seen boolean, state string, stock double").schema
    for batch in batches:
        spark.createDataFrame([f for f in found if f[1] in batch], schema).write.mode("append").parquet(folder)
        stream = links.outcomes(spark.readStream.schema(schema).parquet(folder))
        append_available(stream, to, state).awaitTermination(200)
    got = sorted(tuple(r) for r in spark.read.parquet(to).select("url", "run", "outcome", "misses", "stock").collect())
    assert got == plain_outcomes(found)


def test_outcomes_are_those_of_the_batch_run(spark, tmp_path):
    """One run on a catalog, as a batch and as a stream."""
    cards = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d")], "card_id int, url string")
    catalog = spark.createDataFrame([("b", "B", 1.0), ("c", "A", None), ("d", None, 3.0)], "url string, state string, stock double").withColumn("observed_at", F.lit("2026-01-01").cast("date"))
    batch = stock.catalog_run(cards, catalog.withColumn("pos", F.lit(1)), spark.createDataFrame([], "url string, misses int"), "2026-01-01")
    found = cards.select("url").distinct().join(catalog.withColumn("seen", F.lit(True)), "url", "left").select("url", F.lit(1).cast("bigint").alias("run"), F.coalesce("seen", F.lit(False)).alias("seen"), "state", "stock")
    folder, to, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    found.write.parquet(folder)
    append_available(links.outcomes(spark.readStream.schema(found.schema).parquet(folder)), to, state).awaitTermination(200)
    assert {(r["url"], r["outcome"]) for r in batch.collect()} == {(r["url"], r["outcome"]) for r in spark.read.parquet(to).collect()}


def test_medians_from_merged_days(spark):
    rnd = random.Random(6)
    now = 1_770_000_000
    prices = [None, 0.0, -3.5, 1e-9, 7.25, 7.25, 7.5, 1e12, *[round(rnd.random() * 50, 1) for _ in range(30)]]
    rows = [(rnd.choice(["s", "t", None]), rnd.randrange(4), rnd.choice(prices), now - rnd.choice([-1, 0, 1, 7 * 86400 - 1, 7 * 86400, 30 * 86400, rnd.randrange(50 * 86400)])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "shop string, card int, price double, t long").select("shop", "card", "price", F.timestamp_seconds("t").alias("posted_at"))
    text = spark.range(1).select(F.timestamp_seconds(F.lit(now)).cast("string")).first()[0]
    halves = [buylist.price_days(frame.where(c), text) for c in ("card < 2", "card >= 2 AND coalesce(price, 0) < 7.3", "card >= 2 AND coalesce(price, 0) >= 7.3")]
    want = {}
    for shop, card, price, t in rows:
        if t <= now:
            for key in ((shop, card, 0), (None, card, 1)):
                want.setdefault(key, []).append((t, price))
    for state in (buylist.price_days(frame, text), buylist.merged_days(*halves)):
        got = {(r["shop"], r["card"], r["all_shops"]): r for r in buylist.window_medians(state).collect()}
        assert got.keys() == want.keys()
        for key, held in want.items():
            for name, days in (("7", 7), ("30", 30), ("_all", 10**6)):
                some = [p for t, p in held if t > now - days * 86400]
                ordered = sorted(p for p in some if p is not None)
                k = len(ordered)
                middle = ordered[(k - 1) // 2] * 0.5 + ordered[k // 2] * 0.5 if k else None
                assert (got[key][f"n{name}"], got[key][f"median{name}"]) == (len(some), middle), (key, name)


def test_rings_carried_on_run_by_run_are_the_history(spark):
    rnd = random.Random(9)
    days = [f"2026-01-{d:02d}" for d in (1, 2, 4, 5, 9, 10, 11, 12)]
    rows = [(c, d, float(rnd.randrange(9))) for d in days for c in range(8) if rnd.random() < 0.6 and (c != 7 or d > "2026-01-09")]
    obs = spark.createDataFrame(rows, "card_id int, d string, stock double").select("card_id", F.to_date("d").alias("obs_date"), "stock")
    stored = lambda r: spark.createDataFrame(r.collect(), r.schema)
    for retained in (5, 91):
        rings = stock.ring_of(obs.where("obs_date < DATE '2026-01-05'"), retained)
        for day in days[3:]:
            run = obs.where(F.col("obs_date") == F.lit(day).cast("date")).select("card_id", "stock")
            rings = stored(stock.advanced(rings, run, day, retained))
            if day == "2026-01-09":  # a run that is sent again, and one of a day before, change nothing
                rings = stored(stock.advanced(stored(stock.advanced(rings, run, day, retained)), run, "2026-01-02", retained))
        held = stock.ring_summary(rings).where("samples > 0")
        want = stock.summary(stock.placed(obs, retained)).where("samples > 0")
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, want.select(*held.columns).collect()))
    none = stock.ring_of(obs.limit(0))
    assert stock.ring_summary(none).count() == 0
    first = stock.ring_summary(stock.advanced(none, obs.where("obs_date = DATE '2026-01-01'").select("card_id", "stock"), "2026-01-01"))
    assert first.where("demand <> 'pending' OR samples <> 1").count() == 0 and first.count() > 0


def test_a_failed_run_leaves_the_last_set(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    folder = f"{tmp_path}/set"
    read = lambda name: sorted(r["v"] for r in sinks.read_run(spark, folder, name, rows(1).schema).collect())
    assert read("cards") == [] and sinks.current_run(spark, folder) is None
    sinks.publish_run(folder, "1", cards=rows(1), invalid=rows(7, 8))
    broken = rows(3).select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_run(folder, "2", cards=rows(2), invalid=broken)
    assert read("cards") == [1] and read("invalid") == [7, 8]
    sinks.publish_run(folder, "2", cards=rows(2), invalid=rows(9))
    assert read("cards") == [2] and read("invalid") == [9] and read("other") == []
    sinks.publish_run(folder, "2", cards=rows(5))
    assert read("cards") == [5] and read("invalid") == []


def test_places_of_publication(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 0, 0, 0, 3, 500, 511]), rnd.choice([None, 0.0, 10.0, 10.5, 9e9])) for i in [*range(200), 70_000, 140_000]]
    cards = spark.createDataFrame(rows, "pos long, tv30 long, price double").repartition(3)
    got = {r["pos"]: r["place"] for r in profit.with_place(cards).collect()}
    assert [got[r[0]] for r in sorted(rows, key=lambda r: (-(r[1] or 0), -(r[2] or 0.0), r[0]))] == list(range(1, len(rows) + 1))


def test_membership_never_denies(spark):
    held = spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string")
    test = match.membership(held, "k", bits=1 << 12)
    assert held.where(~test(F.col("k"))).count() == 0
    others = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("k"))
    assert others.where(test(F.col("k"))).count() < 200
    assert others.where(match.membership(held.limit(0), "k")(F.col("k"))).count() == 0


def test_the_last_row_of_a_repeated_url_counts(spark):
    links_ = spark.createDataFrame([(1, "a")], "card_id int, url string")
    rows = [("a", i, s, float(i), "2026-01-01") for i, s in enumerate(["A", "B", "A", "C"])]
    catalog = spark.createDataFrame(rows, "url string, pos int, state string, stock double, d string").withColumn("observed_at", F.col("d").cast("date")).repartition(4)
    out = stock.catalog_run(links_, catalog, spark.createDataFrame([], "url string, misses int"), "2026-01-01")
    assert out.first()["outcome"] == "rejected"
    fresh = stock.catalog_run(links_, catalog, spark.createDataFrame([], "url string, misses int"), "2026-01-02", fresh_only=True)
    assert fresh.first()["outcome"] == "missed"


def test_a_bucket_of_keys_asks_the_store_once():
    """Many new and known keys of one bucket: one look at the store and one addition, and the first row of each new key."""

    class Store:
        asked, held = 0, [("k3",)]

        def getListState(self, *_):  # noqa: N802
            return self

        def exists(self):
            return bool(self.held)

        def get(self):
            self.asked += 1
            return iter(self.held)

        def appendList(self, rows):  # noqa: N802
            self.asked += 1
            self.held = self.held + rows

    store, step = Store(), FirstOfKey("k", ("t",), 10)
    step.init(store)
    rows = [Row(k=f"k{i % 50}", t=None if i == 99 else 100 - i) for i in range(100)] + [Row(k=None, t=1)]
    got = {r["k"]: r["t"] for r in step.handleInputRows((0,), iter(rows), None)}
    assert got == {**{f"k{i}": 50 - i for i in range(49) if i != 3}, "k49": None, None: 1}
    assert store.asked == 2 and not list(step.handleInputRows((0,), iter(rows), None))


def test_a_batch_adds_one_entry_to_a_bucket():
    """The store reads a list whole for each entry that is added, so the entries mustn't be as many as the keys."""

    class Store:
        held, added = [], []

        def getListState(self, *_):  # noqa: N802
            return self

        def exists(self):
            return bool(self.held)

        def get(self):
            return iter(self.held)

        def appendList(self, rows):  # noqa: N802
            self.added = self.added + [len(rows)]
            self.held = self.held + rows

    odd = ["", " ", "\x1f", "\x1e", "\x1eb", "\x1ee", "\x1e\x1f", "\x1f\x1e", "a\x1fb", "a", "b", "\n", "\\", "\U0001f0cf"]
    store, step = Store(), FirstOfKey("k", ("t",), 10)
    step.init(store)
    given = lambda keys: [r["k"] for r in step.handleInputRows((0,), iter([Row(k=k, t=0) for k in keys]), None)]
    first, later = [f"k{i}" for i in range(1000)], ["a\x1f", "\x1fa", "e", "k", "\x1eb\x1f"]
    assert given(first) == first and given(odd) == odd and given([*odd, *first]) == []
    assert given(later) == later and given([None]) == [None] and given([None, "", *later]) == []
    assert store.added == [1, 1, 1, 1, 1, 2]


def test_the_first_rows_of_a_task():
    rows = pa.table({"k": ["a", "b", "a", None, None], "t": [2, 5, None, 4, 3], "x": ["p", "q", "r", "s", "t"]})
    assert sorted(first_rows(rows, "k", ("t", "x")).to_pylist(), key=repr) == sorted([{"k": "a", "t": None, "x": "r"}, {"k": "b", "t": 5, "x": "q"}, {"k": None, "t": 3, "x": "t"}], key=repr)


def test_equal_rows_of_a_task_come_once(spark):
    rows = spark.range(5000).coalesce(1).select(F.lit("u").alias("url"), (F.col("id") % 3).alias("run"), F.lit(None).cast("double").alias("stock"))
    assert sorted(map(tuple, combined(rows, distinct_rows).collect())) == [("u", k, None) for k in range(3)]
