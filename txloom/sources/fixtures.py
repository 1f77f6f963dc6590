"""A transaction graph, node features and predictions derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions.storage import hash_unit

CLASSIFIERS = ("LR", "MLP", "NB", "RF", "SVC", "XGB")
VARIANTS = ("base", "degree", "pagerank", "core", "spectral")
RUNS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that contain the same part from the same supplier, earlier order first: ``src, dst``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    dated = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("l_partkey", "l_suppkey", F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k")).alias("o"))
    a, b = dated.withColumnRenamed("o", "x"), dated.withColumnRenamed("o", "y")
    pairs = a.join(b, ["l_partkey", "l_suppkey"]).filter("x < y")
    return pairs.select(F.col("x.k").cast("string").alias("src"), F.col("y.k").cast("string").alias("dst")).distinct()


def tx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node table: ``tx_id, time_step, class`` and numeric ``f_*``."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("tx_id"),
        (F.floor(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 50) + 1).cast("int").alias("time_step"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(-1).alias("class"),
        F.col("o_totalprice").alias("f_totalprice"),
    )
    line = table(spark, sf_dir, "lineitem")
    sums = [f(F.col(f"l_{c}")).alias(f"f_{n}_{c}") for c in ("quantity", "extendedprice", "discount", "tax") for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max))]
    per = line.groupBy(F.col("l_orderkey").cast("string").alias("tx_id")).agg(F.count(F.lit(1)).cast("double").alias("f_lines"), *sums)
    return orders.join(per, "tx_id", "left")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, classifier, variant, tx_id, y_true, y_pred, p0`` of simulated classifiers on the labelled test nodes."""
    nodes = tx_features(spark, sf_dir).filter("class IN (1, 2) AND time_step > 40").select("tx_id", (F.col("class") - 1).alias("y_true"))
    grid = spark.range(1, RUNS + 1).select(F.col("id").cast("int").alias("run"))
    grid = grid.select("run", F.explode(F.array(*map(F.lit, CLASSIFIERS))).alias("classifier")).select("run", "classifier", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant"))
    # every node becomes 300 rows, whatever the data, so nodes are dealt out first: small files would meet the grid in one task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = nodes.repartition(parts, "tx_id").crossJoin(F.broadcast(grid))
    u = hash_unit(F.md5(F.concat_ws("|", F.col("run").cast("string"), "classifier", "variant", "tx_id")))
    skill = F.lit(0.35) + F.lit(0.05) * (F.length("variant") % 4)
    p0 = F.when(F.col("y_true") == 0, skill + (1 - skill) * u).otherwise((1 - skill) * u)
    rows = rows.withColumn("p0", F.round(p0, 6))
    return rows.withColumn("y_pred", F.when(F.col("p0") >= 0.5, 0).otherwise(1))


# DuckDB twins, as common table expressions -----------------------------------

EDGES_SQL = """
fl AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem),
fp AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y FROM fl a JOIN fl b
       ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey),
e AS (SELECT DISTINCT CAST(CASE WHEN ox.o_orderdate <= oy.o_orderdate THEN x ELSE y END AS VARCHAR) AS src,
                      CAST(CASE WHEN ox.o_orderdate <= oy.o_orderdate THEN y ELSE x END AS VARCHAR) AS dst
      FROM fp JOIN orders ox ON ox.o_orderkey = x JOIN orders oy ON oy.o_orderkey = y),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
v AS (SELECT DISTINCT src AS id FROM u),
deg AS (SELECT src AS id, count(*) AS d FROM u GROUP BY src)"""

_LINE = ", ".join(f"{n}(l_{c}) AS f_{n}_{c}" for c in ("quantity", "extendedprice", "discount", "tax") for n in ("sum", "avg", "max"))

NODES_SQL = f"""
nl AS (SELECT CAST(l_orderkey AS VARCHAR) AS tx_id, CAST(count(*) AS DOUBLE) AS f_lines, {_LINE} FROM lineitem GROUP BY l_orderkey),
tx AS (SELECT CAST(o_orderkey AS VARCHAR) AS tx_id,
              CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 50.0) + 1 AS INTEGER) AS time_step,
              CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE -1 END AS class,
              o_totalprice AS f_totalprice, nl.* EXCLUDE (tx_id)
       FROM orders LEFT JOIN nl ON nl.tx_id = CAST(o_orderkey AS VARCHAR))"""

PRED_SQL = f"""{NODES_SQL},
pn AS (SELECT tx_id, class - 1 AS y_true FROM tx WHERE class IN (1, 2) AND time_step > 40),
pg AS (SELECT CAST(run AS INTEGER) AS run, classifier, variant FROM range(1, {RUNS + 1}) r(run),
       unnest({list(CLASSIFIERS)!r}) c(classifier), unnest({list(VARIANTS)!r}) w(variant)),
pu AS (SELECT run, classifier, variant, tx_id, y_true, 0.35::DOUBLE + 0.05::DOUBLE * (length(variant) % 4) AS skill,
              CAST(CAST('0x' || substr(md5(run || '|' || classifier || '|' || variant || '|' || tx_id), 1, 13) AS BIGINT) AS DOUBLE) / {float(16**13)!r} AS r
       FROM pn, pg),
pp AS (SELECT run, classifier, variant, tx_id, y_true,
              round(CASE WHEN y_true = 0 THEN skill + (1 - skill) * r ELSE (1 - skill) * r END, 6) AS p0 FROM pu),
pred AS (SELECT *, CASE WHEN p0 >= 0.5 THEN 0 ELSE 1 END AS y_pred FROM pp)"""
