"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal, elastic net), then calibrated by
a temperature on rows kept out of the fit. Document frequencies cover all rows that may be
learned from; the weights are fitted on a bounded sample, in expectation ``per_lang`` rows a
language and ``most_rows`` in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import crc32_text

#: Hashed n-gram features.
DIM = 1 << 14
#: Code points whose n-grams are counted at once.
CHUNK = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the first plane: itself lower-cased if a letter, else a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _shown(points: np.ndarray) -> np.ndarray:
    """Letters of code points lower-cased, anything else a space."""
    high = points > 0xFFFF
    c = _letters()[np.where(high, 32, points)]
    if high.any():
        c = c.copy()
        c[high] = [x if chr(x).isalpha() else 32 for x in points[high].tolist()]
    return c


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of a whole text's letters; None without letters.

    The text stands between spaces; whatever is no letter is a space, and spaces that follow a
    space are left out. It is read in chunks; an n-gram counts in the chunk that holds its end.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    total = np.zeros(DIM, np.int64)
    before = np.zeros(0, np.uint32)
    any_letter = False
    for at in range(0, len(points), CHUNK):
        c = _shown(points[at : at + CHUNK])
        any_letter |= bool((c != 32).any())
        c = np.concatenate([[32] if at == 0 else [], c, [32] if at + CHUNK >= len(points) else []]).astype(np.uint32)
        keep = c != 32
        keep[1:] |= c[:-1] != 32
        keep[0] |= not len(before) or before[-1] != 32
        fresh = c[keep]
        c = np.concatenate([before, fresh]).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        for n, g in enumerate((c, two, three)):
            g = g[max(0, len(g) - len(fresh)) :]
            h = (g + np.uint32(n + 1)) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(18), minlength=DIM)
        before = c[-2:]
    return total if any_letter else None


@dataclass
class Model:
    """``weights`` by feature and language, IDF and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, x / max(np.linalg.norm(x), 1e-12)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.features(counts)
        return softmax((x @ self.weights[at] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net for multinomial logistic regression: weights and bias."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zz) * l1 - zz
        return np.where(np.abs(zz) <= l1, 0.0, shrunk / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, DIM), np.append(x, 0.1)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:DIM], 0.1 * w[DIM]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least negative log-likelihood."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 10, 120)
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _share(seed: int, *cols: str) -> Column:
    """A number in [0, 1) fixed by the row."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def train(
    docs: DataFrame, usable: Column, per_lang: int = 1500, most_rows: int = 30_000, seed: int = 5,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model | None:
    """Fit on the rows where ``usable`` holds and the language is not null; None if there are none with letters.

    The sample goes by a hash of id and text, and rows of the sample with the same n-grams count
    once, so repeated rows do not swell it.
    """
    import pyarrow as pa

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), usable.alias("usable"))
    d = d.filter(F.col("usable") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(DIM + 1, np.int64), 0
        for b in batches:
            for x in b.column(0):
                c = ngram_counts(x.as_py())
                if c is not None:
                    df[:DIM] += c > 0
                    df[DIM] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["i", "n"])

    df = np.zeros(DIM + 1)
    for i, n in d.select("text").mapInArrow(frequencies, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[i] = n
    if not df[DIM]:
        return None
    counts = {r[0]: r[1] for r in d.groupBy("lang").count().collect()}
    each = min(per_lang, most_rows / len(counts))
    cut = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    sample = d.filter(_share(seed, "doc_id", "text") < cut[F.col("lang")])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(x.as_py(), ngram_counts(t.as_py())) for t, x in zip(b.column(0), b.column(1), strict=True)]
            got = [(x, np.flatnonzero(c), c) for x, c in got if c is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for x, *_ in got], pa.string()),
                    pa.array([at.astype("<u2").tobytes() for _, at, _ in got], pa.binary()),
                    pa.array([c[at].astype("<u4").tobytes() for _, at, c in got], pa.binary()),
                    pa.array([int(c.sum()) for *_, c in got], pa.int64()),
                ],
                names=["lang", "at", "counts", "size"],
            )

    rows = sample.select("text", "lang").mapInArrow(extract, "lang string, at binary, counts binary, size bigint").distinct().collect()
    rows.sort(key=lambda r: (r["lang"], r["size"], bytes(r["at"]), bytes(r["counts"])))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    y = np.array([langs.index(r["lang"]) for r in rows])
    model = Model(langs, np.log((df[DIM] + 1) / (df[:DIM] + 1)) + 1, np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    x = []
    for r in rows:
        c = np.zeros(DIM)
        c[np.frombuffer(bytes(r["at"]), "<u2")] = np.frombuffer(bytes(r["counts"]), "<u4")
        x.append(model.features(c))
    kept = np.random.default_rng(seed).random(len(x)) < 0.2
    fit = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(x))
    model.weights, model.bias = ftrl([x[i] for i in fit], y[fit], len(langs))
    out = np.flatnonzero(kept)
    model.temperature = temperature(np.array([v @ model.weights[at] + model.bias for at, v in (x[i] for i in out)]), y[out])
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, from its whole text.

    Null texts and texts without a letter: ``und`` with score 0, as all rows if there is no
    model. Repeated rows stay. Other columns are ignored. No rows: no rows.
    """
    import pyarrow as pa

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = [], []
            for t in b.column(1):
                c = ngram_counts(t.as_py()) if m else None
                p = None if c is None else m.probabilities(c)
                langs.append(UNKNOWN if p is None else m.langs[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves 2 modulo 4; a null id is not learned from either."""
    return F.coalesce(F.pmod(crc32_text(F.col(id_col)), F.lit(4)) == 2, F.lit(True))
