"""Readers of feature tables, graphs, artifacts, predictions and results; paths of any file system."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions.columns import column_groups, first_column, parse_label

PARTS = tuple(f"{a}_{s}" for s in ("train", "validation", "test") for a in ("X", "y"))


def required(read, path: str) -> DataFrame:
    """Fails with the path and what to check where a table cannot be read."""
    try:
        return read(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"cannot read {path}: {error.getCondition() or error}") from error


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return required(spark.read.parquet, path)


def features_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Headerless feature table: id, time step, then numbers named ``f_2`` on by position."""
    schema = "tx_id string, time_step int, " + ", ".join(f"f_{i + 2} double" for i in range(n_features))
    return required(lambda p: spark.read.csv(p, schema=schema), path)


def classes_csv(spark: SparkSession, path: str) -> DataFrame:
    """``tx_id, class``; whatever the header says, the columns are these two."""
    raw = required(lambda p: spark.read.csv(p, header=True, schema="tx_id string, class string", enforceSchema=True), path)
    return raw.select("tx_id", parse_label(F.col("class")).alias("class"))


def labelled(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Features with their class, null where there is none."""
    return features.join(classes, "tx_id", "left")


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edge list with header; only the first two columns are read."""
    return required(lambda p: spark.read.csv(p, header=True, schema="src string, dst string", enforceSchema=True), path)


def edgelist(spark: SparkSession, path: str, undirected: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of a file of ``u v`` lines; a line of one token is an isolated node."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.col("p")[0] != "")
    e = parts.filter(F.size("p") > 1).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))
    if undirected:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return e, parts.select(F.explode(F.slice("p", 1, 2)).alias("id")).distinct()


def adjacency_list(spark: SparkSession, path: str, undirected: bool = True, checked: bool = True) -> DataFrame:
    """Edges of a file of ``node neighbour neighbour …`` lines; ``#`` lines are skipped.

    ``checked`` drops repeated edges and loops.
    """
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter((F.col("p")[0] != "") & ~F.col("p")[0].startswith("#") & (F.size("p") > 1))
    e = parts.select(F.col("p")[0].alias("src"), F.explode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("dst"))
    if undirected:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e.filter("src <> dst").distinct() if checked else e


def matrix(spark: SparkSession, dense=None, undirected: bool = True, *, cells=None) -> DataFrame:
    """Edges of a matrix: ``dense`` is its rows, ``cells`` the (row, column) pairs of its non-zero cells; one of them is given."""
    import numpy as np

    if (dense is None) == (cells is None):
        raise ValueError("either the rows of a matrix or the pairs of its non-zero cells")
    pairs = cells if dense is None else np.argwhere(np.asarray(dense))
    e = spark.createDataFrame([(str(i), str(j)) for i, j in pairs], "src string, dst string")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if undirected else e


def from_dict(spark: SparkSession, near: dict, undirected: bool = False) -> DataFrame:
    """Edges of a dictionary of neighbour lists."""
    e = spark.createDataFrame([(str(a), str(b)) for a, bs in near.items() for b in bs], "src string, dst string")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if undirected else e


def word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """``id, emb`` of a text file of vectors; the header ``n dim`` is checked against every row's width.

    The header is the first line of a file; vectors of one number have two fields as well
    and are no header.  Without a header all rows have the width of the first one.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at"))
    head = lines.filter((F.size("p") == 2) & F.col("p")[0].try_cast("int").isNotNull() & F.col("p")[1].try_cast("int").isNotNull()).orderBy("f", "at").limit(1)
    head = head.select(F.col("p")[1].cast("int").alias("dim"), F.col("at").alias("head"))
    if not head.head(1):
        head = lines.filter(F.size("p") > 1).orderBy("f", "at").limit(1).select((F.size("p") - 1).alias("dim"), F.lit(-1).cast("long").alias("head"))
    rows = lines.crossJoin(F.broadcast(head)).filter((F.col("at") != F.col("head")) & (F.size("p") > 1))  # one row
    emb = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("float"))
    wrong = F.raise_error(F.concat(F.lit("wrong width of vector "), F.col("p")[0]))
    return rows.select(F.col("p")[0].alias("id"), F.when(F.size("p") == F.col("dim") + 1, emb).otherwise(wrong).alias("emb"))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; empty where it does not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def complete(spark: SparkSession, bundle: str) -> bool:
    """Whether a bundle has features and labels of all three splits."""
    return {f"{p}.parquet" for p in PARTS} <= set(_names(spark, bundle))


def discover(spark: SparkSession, root: str, part: str = "", done: list[str] = ()) -> list[str]:
    """Complete bundles under ``root`` whose name contains ``part`` and that are not done."""
    return [n for n in _names(spark, root) if part in n and n not in done and complete(spark, f"{root}/{n}")]


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Features and labels of a bundle with ``split``; labels are joined by id."""
    out = None
    for s in ("train", "validation", "test"):
        x, y = parquet(spark, f"{path}/X_{s}.parquet"), parquet(spark, f"{path}/y_{s}.parquet")
        part = x.join(y, "tx_id").withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def model_columns(df: DataFrame) -> list[str]:
    """What models use: all columns but keys, label and split."""
    groups = column_groups(df.columns, keys=("tx_id", "time_step", "class", "label", "split"))
    return groups["base"] + groups["gi"] + groups["emb"]


def predictions(spark: SparkSession, path: str) -> DataFrame | None:
    """Predictions with the first columns that look like truth and prediction as ``y_true, y_pred``; None without."""
    df = parquet(spark, path)
    t, p = first_column(df.columns, "y_true"), first_column(df.columns, "y_pred")
    return None if t is None or p is None else df.withColumnRenamed(t, "y_true").withColumnRenamed(p, "y_pred").withColumns({c: F.col(c).cast("int") for c in ("y_true", "y_pred")})


def results(spark: SparkSession, root: str) -> DataFrame:
    """``path, name, doc`` of all JSON results below ``root``; archives and texts that are no JSON are left out."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    good = raw.filter(~F.col("path").contains("/archive/") & F.expr("try_parse_json(value)").isNotNull())
    return good.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("value").alias("doc"))


def pair_predictions(spark: SparkSession, root: str) -> DataFrame:
    """``stem, json_path, preds_path``: results with the predictions whose name begins with theirs."""
    listing = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    stem = lambda c, end: F.regexp_replace(F.element_at(F.split(c, "/"), -1), end, "")
    a = listing("*.json").select(stem(F.col("path"), r"\.json$").alias("stem"), F.col("path").alias("json_path"))
    b = listing("*testpreds.parquet").select(stem(F.col("path"), r"_*testpreds\.parquet$").alias("stem"), F.col("path").alias("preds_path"))
    return a.join(b, "stem")


def metric_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix with ``classifier`` in the first column; names trimmed, cells as numbers."""
    raw = required(lambda p: spark.read.csv(p, header=True), path)
    first, *rest = raw.columns
    return raw.select(F.trim(F.col(f"`{first}`")).alias("classifier"), *[F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in rest])
