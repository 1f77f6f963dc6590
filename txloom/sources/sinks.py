"""Writers of bundles, edge lists, walks, vectors, predictions, results and matrices."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any file system the session knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def jsonable(x):
    """Plain values for JSON; numbers that are not finite become null."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set):
        return [jsonable(v) for v in x]
    if hasattr(x, "tolist"):
        return jsonable(x.tolist())
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if isinstance(x, int | str | bool) or x is None else str(x)


def meta(spark: SparkSession, path: str, name: str, graph_hash: str, **params) -> None:
    """Sidecar of a signal: name, graph, time and parameters."""
    doc = {"name": name, "graph_hash": graph_hash, "created": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "params": params}
    write_text(spark, path, json.dumps(jsonable(doc), indent=2, sort_keys=True))


def bundle_name(tag: str, config: dict, now: datetime | None = None) -> str:
    """``<time>_<tag>_<first 8 digits of the configuration's SHA-1>``."""
    digest = hashlib.sha1(json.dumps(jsonable(config), sort_keys=True).encode()).hexdigest()[:8]
    return f"{(now or datetime.now(UTC)).strftime('%Y%m%d%H%M%S')}_{tag}_{digest}"


def bundle(df: DataFrame, path: str, config: dict) -> None:
    """Features and labels of each split and a description; numbers narrowed to float."""
    spark = df.sparkSession
    x = [c for c in df.columns if c not in ("label", "split", "class")]
    narrow = [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.select(*x).dtypes]
    for s in ("train", "validation", "test"):
        part = df.filter(F.col("split") == s)
        part.select(*narrow).write.mode("overwrite").parquet(f"{path}/X_{s}.parquet")
        part.select("tx_id", "label").write.mode("overwrite").parquet(f"{path}/y_{s}.parquet")
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    write_text(spark, f"{path}/meta.json", json.dumps(jsonable({"config": config, "rows": counts, "columns": x}), indent=2))


def edgelist(e: DataFrame, path: str) -> None:
    """Space-separated pairs without header."""
    e.select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").text(path)


def edges_csv(e: DataFrame, path: str) -> None:
    e.select(F.col("src").alias("txId1"), F.col("dst").alias("txId2")).write.mode("overwrite").csv(path, header=True)


def walks(w: DataFrame, path: str) -> None:
    """One walk a line."""
    w.select(F.array_join("walk", " ")).write.mode("overwrite").text(path)


def word2vec_text(emb: DataFrame, path: str) -> None:
    """Vectors as text with a header line of their number and width, which sorts first."""
    dim = emb.select(F.size("emb")).first()[0]
    head = emb.sparkSession.createDataFrame([(f"{emb.count()} {dim}",)], "line string")
    rows = emb.select(F.concat_ws(" ", "id", F.array_join(F.transform("emb", lambda x: x.cast("string")), " ")).alias("line"))
    head.unionByName(rows).write.mode("overwrite").text(path)


def predictions(p: DataFrame, path: str) -> None:
    """In zstd: ids that share their beginnings make most of the bytes."""
    p.select("tx_id", "y_true", "y_pred", "proba_fraud", "proba_nofraud").write.mode("overwrite").parquet(path, compression="zstd")


def result(spark: SparkSession, path: str, doc: dict) -> None:
    write_text(spark, path, json.dumps(jsonable(doc), indent=2))


def model(fitted: dict, path: str, spark: SparkSession) -> None:
    """The fitted pipeline, where there is one, with threshold, parameters, scale and all other fitted values beside it."""
    if fitted.get("pipeline") is not None:
        fitted["pipeline"].write().overwrite().save(f"{path}/pipeline")
    result(spark, f"{path}/params.json", {k: fitted[k] for k in ("model", "threshold", "params", "importance", "state")})


def matrix_csv(m: DataFrame, path: str) -> None:
    """A matrix of one row a classifier, in one file."""
    m.coalesce(1).write.mode("overwrite").csv(path, header=True)
