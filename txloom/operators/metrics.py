"""Binary metrics with class 0 as the positive class.

Inputs have ``y_true`` and ``p0`` (probability of class 0) or ``y_pred``; ``keys``
evaluates many runs in one pass.  Ranking metrics aggregate by score, so only sums
meet, and running sums are taken inside score bands first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from txloom.functions.storage import materialize

EPS = 1e-15
#: Bands of scores of a key, each merged by itself; rows whose equal scores a task combines before it sends them.
BANDS, PACK = 16, 1 << 20
RATES = ("precision", "recall", "f1", "accuracy", "balanced_accuracy")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``tp, fn, fp, tn`` for positive class 0."""
    cell = lambda t, p: F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p))
    return df.groupBy(*keys).agg(cell(0, 0).alias("tp"), cell(0, 1).alias("fn"), cell(1, 0).alias("fp"), cell(1, 1).alias("tn"))


def _rates(c: DataFrame, keys: list[str]) -> DataFrame:
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.select(
        *keys,
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def precision_recall_f1(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    return _rates(confusion(df, keys), list(keys))


def report(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of either class, a row each."""
    c = confusion(df, keys)
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    row = lambda k, t, a, b: F.struct(F.lit(k).alias("class"), _ratio(t, t + b).alias("precision"), _ratio(t, t + a).alias("recall"), _ratio(2 * t, 2 * t + a + b).alias("f1"), (t + a).alias("support"))
    return c.select(*keys, F.explode(F.array(row(0, tp, fn, fp), row(1, tn, fp, fn))).alias("r")).select(*keys, "r.*")


def log_loss(df: DataFrame, keys: list[str] = (), eps: float = EPS) -> DataFrame:
    """Mean negative log of the true class' probability, clipped to [eps, 1 - eps]."""
    return df.groupBy(*keys).agg(F.avg(_loss(eps)).alias("log_loss"))


def _loss(eps: float) -> Column:
    p = F.least(F.greatest(F.when(F.col("y_true") == 0, F.col("p0")).otherwise(1 - F.col("p0")), F.lit(eps)), F.lit(1 - eps))
    return -F.log(p)


def _packed(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows of one key and score band: sorted distinct scores with their positives and negatives, packed in bytes.

    A task combines equal scores of PACK rows at a time, so what is shuffled is about the
    scores themselves.  ``sums`` are added up by key and stand in one of its rows.  A missing score ranks last.
    """
    rows = df.select(*keys, F.coalesce(F.col("p0").cast("double"), F.lit(float("-inf"))), (F.col("y_true") == 0), (F.col("y_true") == 1), *[F.coalesce(c.cast("double"), F.lit(0.0)) for c in sums.values()])
    rows = rows.toDF(*keys, "_score", "_pos", "_neg", *sums)
    bare, many = df.select(*keys).schema, len(keys)
    out = T.StructType([*bare, T.StructField("_band", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("_p", "_n")], *[T.StructField(c, T.BinaryType()) for c in ("_s", "_sp", "_sn")], *[T.StructField(c, T.DoubleType()) for c in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, codes, held, size = to_arrow_schema(out), {}, [], 0

        def blob(x: np.ndarray, starts: np.ndarray) -> pa.Array:
            ends = (np.append(starts, len(x)) * x.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])

        def pack() -> pa.RecordBatch:
            code, score, pos, neg, *more = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((score, code))
            code, score = code[order], score[order]
            band = np.where(np.isnan(score), BANDS, np.clip(np.floor(score * BANDS), -1, BANDS)).astype(np.int32)
            new = np.append(True, (code[1:] != code[:-1]) | ~((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))))
            first = np.flatnonzero(new)
            p, n = (np.add.reduceat(x[order].astype(np.int32), first).astype(np.int32) for x in (pos, neg))
            code, score, band = code[first], score[first], band[first]
            starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (band[1:] != band[:-1])))
            own, lead = code[starts], np.append(True, np.diff(code[starts]) != 0)
            totals = [np.where(lead, np.bincount(held_code, x, len(codes))[own], 0.0) for held_code in [np.concatenate([h[0] for h in held])] for x in more]
            names = list(codes)
            columns = [pa.array([names[c][k] for c in own.tolist()], schema[k].type) for k in range(many)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(band[starts]), *[pa.array(np.add.reduceat(x, starts).astype(np.int64)) for x in (p, n)], *[blob(x, starts) for x in (score, p, n)], *map(pa.array, totals)], schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            mixed = np.zeros(len(batch), np.int64)
            for k in range(many):
                coded = batch.column(k).dictionary_encode("encode")
                mixed = np.unique(mixed, return_inverse=True)[1] * len(coded.dictionary) + coded.indices.to_numpy()
            _, at, inverse = np.unique(mixed, return_index=True, return_inverse=True)
            found = zip(*(batch.column(k).take(pa.array(at)).to_pylist() for k in range(many))) if many else [()]
            code = np.array([codes.setdefault(key, len(codes)) for key in found])[inverse]
            held.append((code, *(c.to_numpy(zero_copy_only=False) if c.null_count == 0 else c.fill_null(False).to_numpy(zero_copy_only=False) for c in batch.columns[many:])))
            size += len(batch)
            if size >= PACK:
                yield pack()
                codes, held, size = {}, [], 0
        if held:
            yield pack()

    return rows.mapInArrow(run, out)


def _merged(held: list[tuple]) -> tuple:
    """Distinct scores, ascending, with their positives and negatives."""
    score, p, n = (np.concatenate(x) for x in zip(*held))
    own, at = np.unique(score, return_inverse=True)
    return own, *(np.bincount(at, x, len(own)) for x in (p, n))


def _in_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wins and precision gained at the scores of one key and band; memory follows its distinct scores."""
    held, size, first, above = [], 0, None, (0, 0)
    for batch in batches:
        if len(batch):
            first = first or batch.slice(0, 1)
        for s, p, n, *totals in zip(*(batch.column(c).to_pylist() for c in ("_s", "_sp", "_sn", "_pa", "_na"))):
            if s is None:
                above = totals
                continue
            held.append((np.frombuffer(s), np.frombuffer(p, np.int32), np.frombuffer(n, np.int32)))
            size += len(held[-1][0])
        if size > 4 * PACK and len(held) > 1:
            held = [_merged(held)]
            size = len(held[0][0]) // 2
    _, p, n = (x[::-1] for x in _merged(held))
    above_p, above_n = (a + np.cumsum(x) for a, x in zip(above, (p, n)))
    wins = (n * (above_p - p / 2)).sum()
    gained = (p * above_p / np.maximum(above_p + above_n, 1)).sum()
    out = {"_wins": [float(wins)], "_gained": [float(gained)], "_p": [int(p.sum())], "_n": [int(n.sum())]}
    yield pa.RecordBatch.from_arrays([*(c for c, name in zip(first.columns, first.schema.names) if name.startswith("_key")), *map(pa.array, out.values())], [*(c for c in first.schema.names if c.startswith("_key")), *out])


def _above(c: str, keys: list[str]) -> Column:
    """Sum over the bands above; a key has at most BANDS + 2 of them."""
    return F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _ranked(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """``roc_auc, average_precision`` and ``sums`` of every key; the input is read once.

    The packed rows are stored: band totals come from them first, then each band is
    merged by itself with the totals above it.
    """
    plain = [f"_key{k}" for k in range(len(keys))]
    given = df.select(*[F.col(c).alias(k) for c, k in zip(keys, plain)], *[c for c in df.columns if c not in keys])
    packed = materialize(_packed(given, plain, sums), "scores")
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in plain], F.lit(True))
    bands = packed.groupBy(*plain, "_band").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    bands = bands.select(*plain, "_band", _above("_p", plain).alias("_pa"), _above("_n", plain).alias("_na"))
    rows = packed.select(*plain, "_band", "_s", "_sp", "_sn").unionByName(bands, allowMissingColumns=True)  # totals travel as a row of their band
    shape = T.StructType([*given.select(*plain).schema, *[T.StructField(c, T.DoubleType()) for c in ("_wins", "_gained")], *[T.StructField(c, T.LongType()) for c in ("_p", "_n")]])
    scored = rows.groupBy(*plain, "_band").applyInArrow(_in_band, shape)
    total = F.nullif(F.sum("_p").cast("double"), F.lit(0.0))
    out = scored.groupBy(*plain).agg((F.sum("_wins") / F.nullif(total * F.sum("_n"), F.lit(0.0))).alias("roc_auc"), (F.sum("_gained") / total).alias("average_precision"))
    if sums:
        more = packed.groupBy(*plain).agg(*[F.sum(c).alias(c) for c in sums])
        out = out.join(more, same(out, more)).select(*[out[c] for c in plain], "roc_auc", "average_precision", *sums)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, plain)], "roc_auc", "average_precision", *sums)


def roc_auc(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null with one class only."""
    return ranking(df, keys).drop("average_precision")


def ranking(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``roc_auc, average_precision`` of every key in one pass."""
    return _ranked(df, list(keys), {})


def average_precision(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sum over score groups of recall gained times precision there; null without positives."""
    return ranking(df, keys).drop("roc_auc")


def sweep(df: DataFrame, steps: int, keys: list[str] = (), ends: bool = False) -> DataFrame:
    """Confusion at every threshold k / steps: class 0 where ``p0`` is at least the threshold.

    Scores fall into ``steps`` bins in one aggregation; thresholds are running sums of
    the bins from above, so no row meets the grid.  ``ends`` includes 0 and 1.
    """
    keys = list(keys)
    k = F.floor(F.col("p0") * steps)
    k = F.when((k + 1) / F.lit(float(steps)) <= F.col("p0"), k + 1).when(k / F.lit(float(steps)) > F.col("p0"), k - 1).otherwise(k)
    k = F.least(F.greatest(k, F.lit(-1)), F.lit(steps)).cast("int")  # below all thresholds, or at least the last
    bins = df.withColumn("_k", k).groupBy(*keys, "_k").agg(F.count_if(F.col("y_true") == 0).alias("_p"), F.count_if(F.col("y_true") == 1).alias("_n"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_k")  # steps + 1 rows a key
    every = bins.select(*keys).distinct().select(*keys, grid, F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_n"))
    bins = bins.unionByName(every).groupBy(*keys, "_k").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    down, whole = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    hits = bins.select(*keys, "_k", F.sum("_p").over(down).alias("tp"), F.sum("_n").over(down).alias("fp"), F.sum("_p").over(whole).alias("_pt"), F.sum("_n").over(whole).alias("_nt"))
    hits = hits.filter(F.col("_k").between(0 if ends else 1, steps if ends else steps - 1))
    return hits.select(*keys, "tp", (F.col("_pt") - F.col("tp")).alias("fn"), "fp", (F.col("_nt") - F.col("fp")).alias("tn"), (F.col("_k") / F.lit(float(steps))).alias("threshold"))


def best_threshold(df: DataFrame, keys: list[str] = (), metric: str = "f1", steps: int = 100, ends: bool = False) -> DataFrame:
    """``threshold`` of the grid with the best ``metric``, the smallest at a tie."""
    rates = _rates(sweep(df, steps, keys, ends), [*keys, "threshold"])
    best = F.max_by(F.struct("threshold", metric), F.struct(F.round(metric, 12), -F.col("threshold"))).alias("b")
    out = rates.groupBy(*keys).agg(best) if keys else rates.agg(best)
    return out.select(*keys, "b.threshold", F.col(f"b.{metric}").alias(metric))


def all_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics of every key in one row; one pass over ``df`` for all of them."""
    cell = lambda t, p: (F.col("y_true") == t) & (F.col("y_pred") == p)
    loss = _loss(EPS)
    sums = {"tp": cell(0, 0), "fn": cell(0, 1), "fp": cell(1, 0), "tn": cell(1, 1), "_loss": loss, "_told": loss.isNotNull()}
    found = _ranked(df, list(keys), sums)
    rates = _rates(found, [*keys, "_loss", "_told", "roc_auc", "average_precision"])
    return rates.select(*keys, *RATES, (F.col("_loss") / F.nullif(F.col("_told"), F.lit(0.0))).alias("log_loss"), "roc_auc", "average_precision")
