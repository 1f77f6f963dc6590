"""Toxicity: a logistic classifier regularised by counterfactual pairs.

For every labelled text that names an identity group, counterfactuals swap the terms
for others of the same kind and leave them out; training adds a penalty on the squared
differences of the scores, so that naming a group does not move the score.

Words are ranked on the executors by how strongly their presence separates the
labels; only the counts of the chosen words in a bounded sample of labelled rows
reach the driver, where the weights are fitted.  Scoring is a map over all rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, materialize, shadowed

#: Labelled rows that the classifier is fitted on at most (taken by hash of the id).
MAX_TRAIN_ROWS = 20_000
#: Words of the model, and least labelled texts a word must occur in.
VOCABULARY, MIN_TEXTS = 512, 5
THRESHOLD = 0.3
#: Weights of the counterfactual and the quadratic penalty.
COUNTERFACTUAL, RIDGE = 10.0, 1e-4
#: Occurrences of one word that count.
MOST = 4
#: Words that a task counts before it sends their counts on.
COUNTED_WORDS = 50_000

#: Identity terms by kind; a term is swapped for the next one of its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("mexican", "american", "chinese", "german", "french", "arab"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)
_NEXT = {a.encode(): b.encode() for kind in IDENTITIES for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}

#: ASCII letters are lower-cased, other ASCII characters part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 or c == 39 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def counterfactuals(words: list[bytes]) -> list[list[bytes]]:
    """The words with every identity term swapped, and without them; nothing where no term stands."""
    other = [_NEXT.get(w, w) for w in words]
    return [] if other == words else [other, [w for w in words if w not in _NEXT]]


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


#: Lengths in bytes of the word beginnings that are features beside the words: inflected and compounded forms share them.
BEGINNINGS = (4, 5, 6)


def features_of(words: list[bytes]) -> list[bytes]:
    """The words, and the beginnings (marked ``*``) of longer ones."""
    return words + [w[:n] + b"*" for n in BEGINNINGS for w in words if len(w) > n]


@dataclass
class Model:
    """Weights by feature and a bias."""

    weights: dict[bytes, float]
    bias: float

    def __post_init__(self) -> None:
        self.heads = {w.rstrip(b"*")[: BEGINNINGS[0]] for w in self.weights}

    def score(self, text: bytes) -> float:
        weights, heads, cut = self.weights, self.heads, BEGINNINGS[0]
        some = features_of([w for w in words_of(text) if w[:cut] in heads])  # others have no feature of the model
        hits = Counter([w for w in some if w in weights])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(weights[w] * feature(n) for w, n in hits.items())))))


def feature(n: int) -> float:
    return math.log1p(min(n, MOST))


def choose_words(labelled: DataFrame, size: int = VOCABULARY, least: int = MIN_TEXTS) -> list[bytes]:
    """Words and beginnings whose presence separates the labels best (chi-square over ``labelled(data, label)``).

    Counting is a two-sided map-side combined aggregation over all given rows; the
    top ``size`` words come to the driver, and every identity term that occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], ["word", "clean", "toxic"])

        for batch in batches:
            for data, label in zip(batch.column(0), batch.column(1), strict=True):
                toxic = label.as_py()
                for w in set(features_of(list(set(words_of(data.as_py()))))):
                    counts.setdefault(w, [0, 0])[toxic] += 1
                if len(counts) > COUNTED_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    totals = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return []
    words = labelled.select("data", "label").mapInArrow(run, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    a, b, n = F.col("t").cast("double"), F.col("c").cast("double"), float(clean + toxic)
    cross = a * F.lit(float(clean)) - b * F.lit(float(toxic))
    gain = F.lit(n) * cross * cross / (F.lit(float(clean) * toxic) * (a + b) * F.greatest(F.lit(n) - a - b, F.lit(1.0)))
    top = words.filter((F.col("c") + F.col("t")) >= least).withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(size)
    names = words.filter(F.col("word").isin([F.lit(w) for w in _NEXT]))
    return sorted({bytes(r["word"]) for r in top.select("word").union(names.select("word")).collect()})


def count_words(labelled: DataFrame, words: list[bytes]) -> list:
    """Per labelled row the chosen words' places and counts, for the text and for each counterfactual."""
    place = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), *[pa.list_(pa.list_(pa.int32()))] * 2]
        for batch in batches:
            columns: list[list] = [[], []]
            for data in batch.column(0):
                found = words_of(data.as_py())
                hits = [Counter([place[w] for w in features_of(some) if w in place]) for some in (found, *counterfactuals(found))]
                columns[0].append([list(h) for h in hits])
                columns[1].append([[min(n, MOST) for n in h.values()] for h in hits])
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(kinds[0]), *arrays], ["label", "places", "counts"])

    return labelled.select("data", "label").mapInArrow(run, "label int, places array<array<int>>, counts array<array<int>>").collect()  # at most max_rows rows


def fit(rows: list, words: list[bytes], counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = 25) -> Model:
    """Minimises logistic loss + ridge + ``counterfactual`` × mean squared score change by damped Gauss-Newton steps.

    ``rows`` have ``label`` and, first for the text and then for each counterfactual,
    ``places`` and ``counts`` of the words.
    """
    y = np.array([r["label"] for r in rows], np.float64)
    if not len(words) or not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model({}, math.log(rate / (1 - rate)))

    def dense(cells: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """A row a text, the last column constant."""
        x = np.zeros((len(cells), len(words) + 1), np.float32)
        x[:, -1] = 1
        for k, (places, counts) in enumerate(cells):
            x[k, places] = np.log1p(counts)
        return x

    x = dense([(r["places"][0], r["counts"][0]) for r in rows])
    pairs = [(k, v) for k, r in enumerate(rows) for v in range(1, len(r["places"]))]
    own = np.array([k for k, _ in pairs], np.int64)
    c = dense([(rows[k]["places"][v], rows[k]["counts"][v]) for k, v in pairs])
    penalty = np.full(len(words) + 1, ridge)
    penalty[-1] = 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def loss(w: np.ndarray) -> float:
        p = np.clip(sigmoid(x @ w), 1e-12, 1 - 1e-12)
        gap = p[own] - sigmoid(c @ w)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + penalty @ (w * w) / 2 + counterfactual * (np.mean(gap * gap) if len(gap) else 0))

    w = np.zeros(len(words) + 1)
    w[-1] = math.log(y.mean() / (1 - y.mean()))
    best = loss(w)
    for _ in range(steps):
        p, q = sigmoid(x @ w), sigmoid(c @ w)
        root = np.sqrt(p * (1 - p) / len(y)).astype(np.float32)[:, None]
        slope = x.T @ ((p - y) / len(y)).astype(np.float32) + penalty * w
        curve = (x * root).T @ (x * root) + np.diag(penalty + 1e-8)
        if len(own):
            turn = (p * (1 - p)).astype(np.float32)[own, None] * x[own] - (q * (1 - q)).astype(np.float32)[:, None] * c
            weight = 2 * counterfactual / len(own)
            slope = slope + weight * (turn.T @ (p[own] - q).astype(np.float32))
            curve = curve + weight * (turn.T @ turn)
        step, scale = np.linalg.solve(curve, slope), 1.0
        while scale > 1e-4 and (new := loss(w - scale * step)) > best:
            scale /= 2
        if scale <= 1e-4:
            break
        w, gain, best = w - scale * step, best - new, new
        if gain < 1e-9:
            break
    return Model({k: float(v) for k, v in zip(words, w, strict=False)}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, counterfactual: float = COUNTERFACTUAL, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", keep_out: bool = True) -> Model:
    """Fits on labelled rows that are not held out (``keep_out``), at most ``max_rows`` of them.

    Rows without id, without label or with a label other than 0 and 1 are not used; of
    documents that share an id that with the least text is used.
    """
    given = document_rows(labels, id_col, label_col).toDF("doc_id", "label").filter("doc_id IS NOT NULL AND label IN (0, 1)")
    if keep_out:
        given = given.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    given = given.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = document_rows(docs, id_col, text_col).toDF("doc_id", "text")
    labelled = texts.join(F.broadcast(given), "doc_id").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"), "label")
    labelled = materialize(labelled, "labelled")
    if labelled.count() > given.count():  # of rows that share an id one teaches
        labelled = labelled.groupBy("doc_id", "label").agg(F.min("data").alias("data"))
    # at most max_rows rows
    words = choose_words(labelled)
    return fit(count_words(labelled, words), words, counterfactual)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; null and empty texts get the bias' score."""
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(c.as_py()) for c in batch.column(1)], pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, out)
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Trains on ``labels`` and scores every document; an empty table gives no rows.

    Without usable labels of both kinds every score is the smoothed share of toxic
    ones.  Repeated labels of an id count once, the larger one.
    """
    return score(docs, train(docs, labels, **parameters))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    frame, at, back = shadowed(docs)
    column = frame.columns.index(at(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score((c.as_py() or "").encode("utf-8", "surrogatepass")) < threshold for c in batch.column(column)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return back(frame.mapInArrow(run, frame.schema))
