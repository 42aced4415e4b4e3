"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on the presence of telling words. For labelled texts that name a group
of people, the group's term is swapped for another of its family and for none, and the
change of the score's logit is penalised, so a mention of a group in itself moves no score.

Words are chosen by their log-odds between toxic and other labelled texts: all those that chance
would not explain. The fit keeps texts and counterfactuals as lists of words, so its memory grows
with the words of the sample.
Labels of a bounded sample are learned from: ``per_label`` rows a label in expectation.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import crc32_text, materialize

WORD = re.compile(r"[^\W\d_]+")
#: Families of identity terms; a term is swapped for the next of its family.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "arab", "chinese", "indian"),
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("female", "male"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
)
SWAP = {w: f[(i + 1) % len(f)] for f in IDENTITY_TERMS for i, w in enumerate(f)}
#: A word must stand in so many toxic texts.
LEAST_TEXTS = 3
#: Words that chance alone would choose, in expectation; sets the z value that is asked for.
CHANCE_WORDS = 0.5


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(words: Iterable[str]) -> set[str]:
    """The words with every identity term replaced by the next of its family."""
    return {SWAP.get(w, w) for w in words}


class Model:
    """Weights by word and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.bias + sum(sorted(w[x] for x in words_of(text) if x in w))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


class Sparse:
    """A matrix of which each row is a list of ``(column, value)``; its products with vectors."""

    def __init__(self, rows: Iterable[list[tuple[int, float]]], columns: int):
        at, column, value = array("q"), array("q"), array("d")
        n = 0
        for n, row in enumerate(rows, 1):
            for c, v in row:
                at.append(n - 1)
                column.append(c)
                value.append(v)
        self.shape = n, columns
        self.at, self.column, self.value = np.array(at, np.int64), np.array(column, np.int64), np.array(value)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * v[self.column], self.shape[0])

    def back(self, u: np.ndarray, power: int = 1) -> np.ndarray:
        """The transposed matrix, its values raised to ``power``, times a vector."""
        return np.bincount(self.column, self.value**power * u[self.at], self.shape[1])


def solve(times: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Conjugate gradients for a positive definite matrix, scaled by its diagonal."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    p, rz = z.copy(), r @ z
    enough = 1e-20 * rz
    for _ in range(rounds):
        if rz <= enough:
            break
        q = times(p)
        a = rz / (p @ q)
        x += a * p
        r -= a * q
        z = r / diagonal
        p, rz = z + (r @ z) / rz * p, r @ z
    return x


def fit(
    rows: list[tuple[Iterable[str], int, float]], words: list[str], penalty: float = 10.0, l2: float = 0.02, rounds: int = 30
) -> Model:
    """Newton's method on ``(words, label, weight)`` rows.

    Minimises the log-loss plus ``l2`` |w|^2 / 2 plus, for each row that names a group and both
    its counterfactuals, ``penalty`` times half the squared change of its logit. Matrices are
    never formed: each step is found by conjugate gradients over the rows' words.
    """
    vocabulary = sorted({*words, *(w for ws, *_ in rows for w in ws if w in SWAP)})
    vocabulary = sorted({*vocabulary, *(SWAP[w] for w in vocabulary if w in SWAP)})
    place = {w: i for i, w in enumerate(vocabulary)}
    if not rows or len({y for _, y, _ in rows}) < 2:
        mean = (sum(y * c for _, y, c in rows) + 0.5) / (sum(c for *_, c in rows) + 10.0)
        return Model({}, math.log(mean / (1 - mean)))

    # equal rows are one row with their weights together
    merged: dict[tuple, float] = defaultdict(float)
    for ws, y, c in rows:
        merged[tuple(sorted(w for w in ws if w in place)), y] += c
    rows = [(ws, y, c) for (ws, y), c in sorted(merged.items())]
    size = len(vocabulary) + 1
    x = Sparse(([*((place[w], 1.0) for w in ws), (size - 1, 1.0)] for ws, *_ in rows), size)
    y = np.array([y for _, y, _ in rows], float)
    c = np.array([c for *_, c in rows])
    named = [(set(ws), other, n) for ws, _, n in rows if swapped(ws) != set(ws) for other in (swapped(ws), set(ws) - SWAP.keys())]
    diff = Sparse(([*((place[w], 1.0) for w in ws - other), *((place[w], -1.0) for w in other - ws)] for ws, other, _ in named), size)
    pulled = penalty * np.array([n for *_, n in named], float)
    ridge = np.append(np.full(len(vocabulary), l2), 1e-6)
    pull = lambda v: diff.back(pulled * diff.times(v)) + ridge * v
    fixed = diff.back(pulled, 2) + ridge
    w = np.zeros(size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        grad = x.back(c * (p - y)) + pull(w)
        curve = c * np.maximum(p * (1 - p), 1e-6)
        step = solve(lambda v, curve=curve: x.back(curve * x.times(v)) + pull(v), x.back(curve, 2) + fixed, grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Model({v: float(w[i]) for v, i in place.items() if w[i] != 0}, float(w[-1]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learned: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(crc32_text(F.col(id_col)), F.lit(5)) == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, per_label: int = 10_000, penalty: float = 10.0, seed: int = 9,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit on labelled texts that are not held out.

    A document labelled more than once counts as toxic if any label says so; null labels and
    null ids are left out. Without labels the model gives every text the same low score.
    """
    spark = docs.sparkSession
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max((F.col(label_col) != 0).cast("int")).alias("y"))
        .filter(~held_out("doc_id"))
    )
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not counts:
        return Model({}, -4.0)
    cut = F.when(F.col("y") == 1, min(1.0, per_label / counts.get(1, 1))).otherwise(min(1.0, per_label / counts.get(0, 1)))
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(share < cut)
    # about 2 * per_label rows of 12 bytes, whatever the corpus
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [sorted(words_of(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.string()))], names=["y", "words"])

    rows = materialize(d.select("text", "y").mapInArrow(extract, "y int, words array<string>"), "toxic-sample")
    size = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return fit([(set(), 1, float(toxic)), (set(), 0, float(other))][: 2 if toxic and other else 0], [])
    each = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (other - b + 0.5))
    error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (toxic - a + 0.5) + 1 / (other - b + 0.5))
    each = materialize(each.filter(a >= LEAST_TEXTS).select("word", (odds / error).alias("z")), "toxic-words")
    least = NormalDist().inv_cdf(1 - min(0.5, CHANCE_WORDS / max(1, each.count())))
    words = sorted(r[0] for r in each.filter(F.col("z") >= least).select("word").collect())
    names = sorted({*words, *SWAP})
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def known_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [sorted(shared.value[w] for w in ws.as_py() if w in shared.value) for ws in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "w"])

    # places in the list of names, a few bytes each
    sample = rows.select("y", "words").mapInArrow(known_words, "y int, w array<int>").groupBy("y", "w").agg(F.count(F.lit(1)).alias("n")).toArrow()
    # both labels weigh the same together, so 0.5 is as far from either
    weight = {1: min(1.0, other / toxic), 0: min(1.0, toxic / other)}
    texts = zip(sample["w"], sample["y"].to_pylist(), sample["n"].to_pylist(), strict=True)
    return fit([(tuple(names[i] for i in w.as_py()), y, n * weight[y]) for w, y, n in texts], words, penalty)


def score_column(spark: object, model: Model, text: Column) -> Column:
    """The score of a text column: 0 to 1; null as the empty text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score(text)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row, from its whole text.

    Null and empty texts get the score of no words. Repeated rows stay. Other columns are
    ignored. No rows: no rows.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scored = d.select("doc_id", score_column(d.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
