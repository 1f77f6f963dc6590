"""Projections and predicates over names, labels and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = 0, 1


def encode_label(c: Column, mode: str = "binary") -> Column:
    """1 → 0 (positive), 2 → 1, anything else → −1; ``raw`` leaves the label as it is."""
    if mode == "raw":
        return c.cast("int")
    if mode != "binary":
        raise ValueError(f"unknown label mode {mode}")
    return F.when(c == 1, POSITIVE).when(c == 2, NEGATIVE).otherwise(-1).cast("int")


def parse_label(c: Column) -> Column:
    """Label text to a number: ``unknown`` is −1, what is no number null."""
    return F.when(c == "unknown", F.lit(-1)).otherwise(c.try_cast("int"))


def finite(c: Column) -> Column:
    """Nulls, NaN and infinities become 0."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of an edge in string order."""
    return F.least(a, b), F.greatest(a, b)


def classifier_of(name: Column) -> Column:
    """Second ``_`` part of a result name; null for names of fewer than three parts."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    return F.when(F.size(parts) >= 3, parts[1])


def variant_of(name: Column) -> Column:
    """What stands between ``base<digits>+`` and the next ``_``, if ``_random`` follows; else null."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = F.regexp_extract(stem, r"base\d+\+([^_]+)[^+]*?_random", 1)
    return F.when(found != "", found)


def edge_tag(name: Column) -> tuple[Column, Column]:
    """Edge variant and split seed of a bundle name, null where it carries none."""
    pattern = r"_edgesVar_([^_]+)_splitseed(\d+)_random"
    has = F.regexp_like(name, F.lit(pattern))
    return F.when(has, F.regexp_extract(name, pattern, 1)), F.when(has, F.regexp_extract(name, pattern, 2).cast("int"))


def base_block(name: Column, prefix: str = "base93", stops: tuple[str, ...] = ("_edgesVar_", "_random", "__bundle")) -> Column:
    """From ``prefix`` up to the first stop word that occurs, stop words tried in order; null without prefix."""
    rest = F.substring(name, F.instr(name, prefix), F.length(name))
    cuts = [F.when(F.instr(rest, s) > 0, F.substring(rest, F.lit(1), F.instr(rest, s) - 1)) for s in stops]
    return F.when(F.instr(name, prefix) > 0, F.coalesce(*cuts, rest))


def first_column(names: list[str], part: str) -> str | None:
    """First column whose lower-cased name contains ``part``."""
    return next((n for n in names if part in n.lower()), None)


def column_groups(names: list[str], gi: str = "gi_", emb: str = "emb_", keys: tuple[str, ...] = ("tx_id", "time_step", "class")) -> dict[str, list[str]]:
    """Columns by prefix: indicators, embeddings, and the rest without keys as base."""
    out: dict[str, list[str]] = {"base": [], "gi": [], "emb": []}
    for n in names:
        if n not in keys:
            out["gi" if n.startswith(gi) else "emb" if n.startswith(emb) else "base"].append(n)
    return out


def with_id(df: DataFrame, aliases: tuple[str, ...] = ("tx_id", "txId", "txid", "node", "id")) -> DataFrame:
    """``df`` with a string column ``tx_id`` taken from the first alias it has."""
    found = next((a for a in aliases if a in df.columns), None)
    if found is None:
        raise ValueError(f"none of {aliases} in {df.columns}")
    return df.withColumnRenamed(found, "tx_id").withColumn("tx_id", F.col("tx_id").cast("string"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is null or zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def rename_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Values replaced by a dictionary; others stay."""
    chain = reduce(lambda w, kv: w.when(F.col(column) == kv[0], kv[1]), mapping.items(), F.when(F.lit(False), ""))
    return df.withColumn(column, F.coalesce(chain, F.col(column)))


def nan_counts(df: DataFrame) -> DataFrame:
    """``column, n`` of null or NaN values of every column."""
    tests = [F.count_if(F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False))).alias(c) for c, t in df.dtypes]
    counts = df.agg(*tests)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.column", "p.n")


def slice_columns(df: DataFrame, start: int, stop: int, keys: tuple[str, ...] = ("tx_id", "time_step", "class")) -> DataFrame:
    """The key columns and those at positions ``start`` to ``stop - 1`` of the table."""
    some = df.columns[start:stop]
    return df.select(*[k for k in keys if k in df.columns and k not in some], *some)


def valid_mask(split: Column, label: Column, part: str) -> Column:
    """Whether a row is in the part and has class 0 or 1."""
    return F.coalesce((split == part) & label.isin(0, 1), F.lit(False))
