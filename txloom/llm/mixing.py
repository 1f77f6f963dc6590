"""Mixing sources to target weights, with DataFrame functions only.

Source shares of tokens are raised to an exponent between 0 (uniform) and 1
(proportional) and normalised.  The exponent is found by bisection, several
levels a pass, so that the mixture reaches an entropy and no source is repeated
more than a limit.  The weights are then realised exactly over a token budget:
every source deals its documents in fresh hash permutations, epoch after epoch,
and the stream is cut into blocks that each hold every source in its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom.llm.common import document_rows, identified, materialize, shadowed

#: Normalised entropy of the mixture, most epochs of one source, tokens a block, seed.
ENTROPY = 0.95
REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
SEED = 42
#: Bisection levels done in one pass over the source table, and passes.
LEVELS, PASSES = 4, 8
#: Documents whose running token count one task computes; by default about the square root of a source's.
RUN_ROWS: int | None = None
WORD = r"[^\x20\x09-\x0D]+"


def source_table(tokens: DataFrame) -> DataFrame:
    """``mix_key, docs, total`` of ``tokens(mix_key, tokens)``; sources without tokens have no share."""
    return tokens.groupBy("mix_key").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("total")).filter("total > 0")


def solve_exponent(sources: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None) -> tuple[float, int]:
    """The exponent in [0, 1], rounded to 6 digits, and the token budget.

    Largest exponent whose mixture has at least ``entropy`` times the entropy of the
    uniform one; raised, where ``repeats`` asks for it, to the smallest one that shows
    no source more than ``repeats`` times.  Both functions of the exponent are
    monotone.  Each pass is one aggregate row; the source table stays distributed.
    """
    total, most, n = sources.agg(F.sum("total"), F.max("total"), F.count(F.lit(1))).first()
    if not n:
        return 1.0, 0
    budget = total if budget is None else budget
    x = sources.select(F.log(F.col("total") / F.lit(float(most))).alias("x"))

    def bisect(meets) -> tuple[float, float]:
        """Bounds of where ``meets`` turns from true (low) to false (high)."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS)]
            row = x.agg(F.min("x"), *[f for a in points for f in (F.sum(F.exp(F.lit(a) * F.col("x"))), F.sum(F.col("x") * F.exp(F.lit(a) * F.col("x"))))]).first()
            true = sum(meets(a, row[1 + 2 * k], row[2 + 2 * k], row[0]) for k, a in enumerate(points))
            edges = [low, *points, high]
            low, high = edges[true], edges[true + 1]
        return low, high

    exponent = 1.0
    if entropy is not None:
        exponent = round(bisect(lambda a, z, s, _: math.log(z) - a * s / z >= entropy * math.log(n))[0], 6)
    else:
        exponent = 0.0
    if repeats is not None:
        too_often = lambda a, z, _, least: budget / most * math.exp((a - 1) * least) / z > repeats
        exponent = max(exponent, math.ceil(bisect(too_often)[1] * 1e6 - 1e-3) / 1e6 if bisect_needed(x, too_often) else 0.0)
    return exponent, int(budget)


def bisect_needed(x: DataFrame, too_often) -> bool:
    """Whether the uniform mixture already repeats some source too often."""
    n, least = x.agg(F.count(F.lit(1)), F.min("x")).first()
    return too_often(0.0, float(n), 0.0, least)


def permutation(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """The mixture as rows ``doc_id, source, epoch, tokens, weight, exponent, block, slot``.

    A document appears once an epoch; ``block`` and ``slot`` give its place in the
    stream.  The last epoch of a source ends with the document that fills its part of
    the budget.  Null sources form a source of their own; null texts have no tokens;
    sources without a token get no weight; repeated rows count as often as they occur;
    an empty table gives no rows.  ``budget`` defaults to the tokens there are.  A unique
    column ``row_col`` is passed on as ``row`` and settles ties.
    """
    more = {"row": row_col} if row_col else {}
    rows = document_rows(docs, id_col, source_col, text_col, *more.values()).toDF("doc_id", "source", "text", *more)
    tokens = rows.select(
        "doc_id", "source", *more,
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))).alias("mix_key"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("tokens"),
    )
    return deal(materialize(tokens, "mix-tokens"), entropy, repeats, budget, block_tokens, seed)


def deal(tokens: DataFrame, entropy: float | None, repeats: float | None, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """:func:`mix` on a stored table ``doc_id, source, mix_key, tokens`` and perhaps ``row``."""
    more = [c for c in tokens.columns if c == "row"]
    sources = materialize(source_table(tokens), "mix-sources")
    exponent, budget = solve_exponent(sources, entropy, repeats, budget)
    blocks = max(1, -(-budget // block_tokens))
    powers = sources.withColumn("power", F.pow(F.col("total").cast("double"), F.lit(exponent)))
    norm = powers.agg(F.sum("power")).first()[0] or 1.0
    plan = powers.select(
        "mix_key", "docs", "total",
        F.round(F.col("power") / F.lit(norm), 9).alias("weight"),
    ).withColumn("quota", F.round(F.col("weight") * F.lit(float(budget))).cast("long")).filter("quota > 0")
    runs = F.sqrt("docs") if RUN_ROWS is None else F.col("docs") / F.lit(float(RUN_ROWS))
    plan = plan.withColumn("epochs", F.ceil(F.col("quota") / F.col("total")).cast("int")).withColumn(
        "digits", F.greatest(F.lit(1), F.ceil(F.log(runs) / F.lit(math.log(16)))).cast("int")
    )
    dealt = tokens.join(plan, "mix_key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    dealt = dealt.withColumn("card", permutation(seed, F.col("epoch"), F.col("doc_id"))).withColumn("run", F.expr("substring(card, 1, digits)"))
    sums = dealt.groupBy("mix_key", "epoch", "run").agg(F.sum("tokens").alias("run_tokens"))
    starts = sums.select("mix_key", "epoch", "run", (F.sum("run_tokens").over(Window.partitionBy("mix_key", "epoch").orderBy("run")) - F.col("run_tokens")).alias("run_start"))
    within = Window.partitionBy("mix_key", "epoch", "run").orderBy("card", "tokens", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["mix_key", "epoch", "run"])
    placed = placed.withColumn("at", F.col("epoch") * F.col("total") + F.col("run_start") + F.col("ahead")).filter(F.col("at") < F.col("quota"))
    placed = placed.withColumn("block", F.floor(F.col("at") / F.col("quota") * F.lit(float(blocks))).cast("long"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("card", "mix_key", "tokens", *more))
    return placed.select("doc_id", "source", F.col("epoch"), "tokens", "weight", F.lit(exponent).alias("exponent"), "block", slot.cast("long").alias("slot"), *more)


def mix_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mixture shows it.

    Where ids are null or shared, rows are told apart by a number stored with them, so
    they are dealt and shown row by row.
    """
    frame, at, back = shadowed(docs)
    columns = {f"{c}_col": at(parameters.pop(f"{c}_col", name)) for c, name in (("text", "text"), ("id", "doc_id"), ("source", "source"))}
    numbered = identified(frame, columns["id_col"])
    shown = mix(numbered, **parameters, **columns, row_col="row").select("row")
    return back(numbered.join(shown, "row"))


ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
s AS (SELECT k, CAST(sum(tokens) AS BIGINT) AS total FROM t GROUP BY k HAVING sum(tokens) > 0),
b AS (SELECT CAST(sum(total) AS BIGINT) AS budget, count(*) AS n, max(total) AS most FROM s),
x AS (SELECT ln(CAST(total AS DOUBLE) / most) AS x FROM s, b),
xs AS (SELECT list(x) AS xs, min(x) AS least FROM x),
bis(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
           ln(list_sum(list_transform(xs, lambda e: exp((lo + hi) / 2 * e)))) - (lo + hi) / 2
             * list_sum(list_transform(xs, lambda e: e * exp((lo + hi) / 2 * e)))
             / list_sum(list_transform(xs, lambda e: exp((lo + hi) / 2 * e))) >= {ENTROPY} * ln(n) AS ok
    FROM bis, xs, b WHERE i < {LEVELS * PASSES})),
rep(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN bad THEN mid ELSE lo END, CASE WHEN bad THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
           CAST(budget AS DOUBLE) / most * exp(((lo + hi) / 2 - 1) * least)
             / list_sum(list_transform(xs, lambda e: exp((lo + hi) / 2 * e))) > {REPEATS} AS bad
    FROM rep, xs, b WHERE i < {LEVELS * PASSES})),
a AS (SELECT greatest((SELECT round(max(lo), 6) FROM bis WHERE i = {LEVELS * PASSES}),
                      (SELECT CASE WHEN max(lo) > 0 THEN ceil(max(hi) * 1e6 - 1e-3) / 1e6 ELSE 0 END FROM rep WHERE i = {LEVELS * PASSES})) AS exponent),
w AS (SELECT k, total, round(pow(total, exponent) / sum(pow(total, exponent)) OVER (), 9) AS weight, exponent FROM s, a),
q AS (SELECT *, CAST(round(weight * budget) AS BIGINT) AS quota,
             greatest(1, CAST(ceil(CAST(budget AS DOUBLE) / {BLOCK_TOKENS}) AS BIGINT)) AS blocks FROM w, b),
e AS (SELECT t.*, total, weight, exponent, quota, blocks, CAST(epoch AS INTEGER) AS epoch,
             md5('{SEED}|' || epoch || '|' || doc_id) AS card
      FROM t JOIN q USING (k), range(0, 64) r(epoch) WHERE epoch < ceil(CAST(quota AS DOUBLE) / total)),
p AS (SELECT *, epoch * total + coalesce(CAST(sum(tokens) OVER (PARTITION BY k, epoch ORDER BY card, tokens
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS place FROM e),
f AS (SELECT *, CAST(floor(CAST(place AS DOUBLE) / quota * blocks) AS BIGINT) AS block FROM p WHERE place < quota)
SELECT doc_id, source, epoch, tokens, weight, exponent, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY card, k, tokens) AS BIGINT) AS slot
FROM f
"""
