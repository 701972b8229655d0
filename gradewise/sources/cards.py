"""Sources: JSON files with a declared schema, and card relations derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The published card relation.
CARD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "name", "model", "img", "snkUrl")]
    + [T.StructField(c, T.DoubleType()) for c in ("price", "snkPsa10Price", "snkPsa10Min")]
    + [T.StructField(c, T.LongType()) for c in ("tv7", "tv30", "p10tv7", "p10tv30")]
    + [T.StructField(c, T.DoubleType()) for c in ("chg7", "chg30", "tvel", "days")]
    + [T.StructField("tLastAt", T.StringType()), T.StructField("snkListings", T.LongType()), T.StructField("cardrushUrl", T.StringType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_folder(spark: SparkSession, path: str) -> bool | None:
    """None where there is nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(hadoop).isDirectory() if fs.exists(hadoop) else None


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON of the declared schema: a file that holds one array, or a folder of lines. An empty relation
    where there is none; what can't be read is left out. Numbers that aren't finite become null."""
    folder = is_folder(spark, path)
    if folder is None:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=not folder)
    number = {f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if c in number else c for c in df.columns])


#: Graded populations by query, and pages of sets that list them.
POPULATION = T.StructType([T.StructField(c, T.DoubleType()) for c in ("psa10Rate", "psaTotal", "psa10Count")] + [T.StructField(c, T.StringType()) for c in ("cardNo", "sourceSet")])
MANIFEST = T.StructType([T.StructField(c, T.BooleanType() if c == "needsReview" else T.StringType()) for c in ("name", "kind", "url", "needsReview", "note")])


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """(query, rate, total, count, card_no, source_set, pos) of a file with an object ``byQuery``."""
    whole = read_json(spark, path, T.StructType([T.StructField("byQuery", T.MapType(T.StringType(), POPULATION))]))
    rows = whole.select(F.posexplode(F.map_entries("byQuery")).alias("pos", "e"))
    names = {"rate": "psa10Rate", "total": "psaTotal", "count": "psa10Count", "card_no": "cardNo", "source_set": "sourceSet"}
    return rows.select(F.col("e.key").alias("query"), *[F.col(f"e.value.{v}").alias(k) for k, v in names.items()], "pos")


#: The shop's catalog; rows in a folder of lines carry their place, those of a file have it by their order.
CATALOG = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "detailUrl", "state")] + [T.StructField("stock", T.DoubleType()), T.StructField("observedAt", T.StringType()), T.StructField("matchKeys", T.ArrayType(T.StringType())), T.StructField("pos", T.LongType())])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, url, state, stock, observed_at, keys, pos) of a catalog: a folder of lines or a file with
    one array. What isn't an array, and rows without a URL, give nothing."""
    if is_folder(spark, path):
        rows = read_json(spark, path, CATALOG)
    elif is_folder(spark, path) is None:
        rows = spark.createDataFrame([], CATALOG)
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(CATALOG)).alias("rows"))
        rows = whole.select(F.posexplode("rows").alias("at", "r")).select("r.*", F.col("at").cast("bigint").alias("at")).drop("pos").withColumnRenamed("at", "pos")
    names = {"url": "detailUrl", "observed_at": "observedAt", "keys": "matchKeys"}
    columns = [F.col(names.get(c, c)).alias(c) for c in ("id", "name", "url", "state", "stock")]
    return rows.where("detailUrl <> ''").select(*columns, F.to_date(F.substring("observedAt", 1, 10)).alias("observed_at"), F.col("matchKeys").alias("keys"), "pos")


def assigned_json(texts: DataFrame, column: str, schema: T.StructType | T.ArrayType) -> DataFrame:
    """Scripts that assign one JSON value to a global: the value, as a column ``value``."""
    bare = F.regexp_replace(F.regexp_replace(column, r"^[^=]*=\s*", ""), r";?\s*\z", "")
    return texts.withColumn("value", F.from_json(bare, schema))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards from parts and their line items; money in whole cents until it is divided once."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag", "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    last = F.broadcast(li.agg(F.max("l_shipdate").alias("now")))
    age = lambda d: F.col("l_shipdate") > F.col("now") - F.expr(f"INTERVAL {d} DAYS")
    open_, graded, back = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    mean = lambda cond: F.sum(F.when(cond, F.col("cents"))).cast("double") / (F.lit(100.0) * F.count(F.when(cond, 1)))
    some = lambda cond, x: F.when(F.count(F.when(cond, 1)) > 0, x)
    change = lambda d: F.when((F.count(F.when(age(d), 1)) > 0) & (F.count(F.when(age(2 * d) & ~age(d), 1)) > 0), (F.floor(mean(age(d)) / mean(age(2 * d) & ~age(d)) * 10000) / 100 - 100))
    sales = li.join(last).groupBy("l_partkey").agg(
        some(open_, F.floor(mean(open_) + 0.5)).cast("double").alias("price"),
        some(graded, F.floor(2 * mean(graded) + 0.5)).cast("double").alias("snkPsa10Price"),
        (F.min(F.when(graded, F.col("cents"))) / 100.0).cast("double").alias("snkPsa10Min"),
        *[F.count(F.when(age(d) & c, 1)).alias(n) for n, d, c in (("tv7", 90, F.lit(True)), ("tv30", 365, F.lit(True)), ("p10tv7", 90, back), ("p10tv30", 365, back))],
        change(90).cast("double").alias("chg7"),
        change(365).cast("double").alias("chg30"),
        F.nullif(F.count(F.when(open_, 1)), F.lit(0)).alias("snkListings"),
        F.datediff(F.max("now"), F.max("l_shipdate")).cast("double").alias("days"),
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("tLastAt"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("model"), F.col("p_type").alias("rarity"), F.col("p_size").alias("size"))
    return part.join(sales, "l_partkey", "left").drop("l_partkey").withColumn("tvel", F.when(F.col("price") > 0, F.coalesce("tv30", F.lit(0)) * F.lit(100.0) / F.col("price")))


CARDS_SQL = """
li AS (SELECT l_partkey, l_linestatus AS ls, l_returnflag AS rf, l_shipdate AS d, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, (SELECT max(l_shipdate) FROM lineitem) AS m FROM lineitem),
sales AS (SELECT l_partkey,
  floor(CAST(sum(cents) FILTER (WHERE ls = 'O') AS DOUBLE) / (100e0 * count(*) FILTER (WHERE ls = 'O')) + 0.5e0) AS price,
  floor(2 * (CAST(sum(cents) FILTER (WHERE ls = 'F') AS DOUBLE) / (100e0 * count(*) FILTER (WHERE ls = 'F'))) + 0.5e0) AS "snkPsa10Price",
  min(cents) FILTER (WHERE ls = 'F') / 100e0 AS "snkPsa10Min",
  count(*) FILTER (WHERE d > m - INTERVAL 90 DAY) AS tv7, count(*) FILTER (WHERE d > m - INTERVAL 365 DAY) AS tv30,
  count(*) FILTER (WHERE d > m - INTERVAL 90 DAY AND rf = 'R') AS p10tv7, count(*) FILTER (WHERE d > m - INTERVAL 365 DAY AND rf = 'R') AS p10tv30,
  floor((CAST(sum(cents) FILTER (WHERE d > m - INTERVAL 90 DAY) AS DOUBLE) / (100e0 * count(*) FILTER (WHERE d > m - INTERVAL 90 DAY))) / (CAST(sum(cents) FILTER (WHERE d > m - INTERVAL 180 DAY AND d <= m - INTERVAL 90 DAY) AS DOUBLE) / (100e0 * count(*) FILTER (WHERE d > m - INTERVAL 180 DAY AND d <= m - INTERVAL 90 DAY))) * 10000) / 100 - 100 AS chg7,
  floor((CAST(sum(cents) FILTER (WHERE d > m - INTERVAL 365 DAY) AS DOUBLE) / (100e0 * count(*) FILTER (WHERE d > m - INTERVAL 365 DAY))) / (CAST(sum(cents) FILTER (WHERE d > m - INTERVAL 730 DAY AND d <= m - INTERVAL 365 DAY) AS DOUBLE) / (100e0 * count(*) FILTER (WHERE d > m - INTERVAL 730 DAY AND d <= m - INTERVAL 365 DAY))) * 10000) / 100 - 100 AS chg30,
  nullif(count(*) FILTER (WHERE ls = 'O'), 0) AS "snkListings", CAST(date_diff('day', CAST(max(d) AS DATE), CAST(max(m) AS DATE)) AS DOUBLE) AS days, strftime(max(d), '%Y-%m-%d') AS "tLastAt"
  FROM li GROUP BY l_partkey),
cards AS (SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS model, p_type AS rarity, p_size AS size, sales.* EXCLUDE (l_partkey),
  CASE WHEN price > 0 THEN coalesce(tv30, 0) * 100e0 / price END AS tvel FROM part LEFT JOIN sales ON l_partkey = p_partkey)"""
