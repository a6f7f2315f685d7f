"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, each run of other characters than letters becomes one blank, and all
n-grams of one to three characters are hashed to ``DIMENSIONS`` features.  A feature's value is
its share of the text's n-grams times its inverse document frequency, which counts all training
rows.  Weights are fitted by follow-the-regularised-leader with an elastic net, so most stay zero,
and the scores are calibrated by a temperature on a part of the sample that wasn't fitted.

Fitting takes about ``sample`` rows of each language, and no more than ``MOST_ROWS`` in all, by
hash of their ids; it runs in one task of that bounded size.  Rows of one id are taken together or not
at all.  Only the ``MOST_ROWS // 20`` = 1,000 languages with most rows are learned, so that each has 20
rows at least; texts of others are given one of these.  Scoring is over whole texts.

Null texts and texts without a letter are ``und`` with score 0 and aren't trained on, nor are
rows with a null language or id.  Without any training row all texts are ``und``.  Ties go to
the language that sorts first.  Repeated rows count one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE, MOST_ROWS = 500, 20_000
#: Elastic net, step size, and what feature values are scaled by before fitting.
L1, L2, ALPHA, BETA, SCALE, EPOCHS = 0.5, 1.0, 0.5, 1.0, 50.0, 6
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Features of all n-grams of a text, and whether it has a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    alpha = letters()[codes]
    if not alpha.any():
        return np.zeros(0, np.int64), False
    blank = ~alpha
    keep = alpha | (blank & np.concatenate([[False], alpha[:-1]]))
    codes = np.concatenate([[32], np.where(blank, 32, codes)[keep], [32]]).astype(np.uint32)
    out = []
    for n in ORDERS:
        value = np.full(len(codes) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            value = (value ^ codes[k:len(codes) - n + 1 + k]) * MULTIPLIERS[k]
            value ^= value >> np.uint32(15)
        out.append(value % np.uint32(DIMENSIONS))
    return np.concatenate(out).astype(np.int64), True


@dataclass
class Model:
    """Weights by feature and language, with the inverse document frequencies multiplied in."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        return np.array([w[features].sum() for w in self.weights]) / len(features) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found, any_letter = grams(text or "")
        if not any_letter or not self.languages:
            return "und", 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found, any_letter = grams(text.as_py() or "")
                if any_letter:
                    total += np.bincount(found, minlength=DIMENSIONS) > 0
                    rows += 1
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *where], pa.int32()), pa.array([rows, *total[where]], pa.int64())],
            ["feature", "n"])

    found = texts.mapInArrow(counted, "feature int, n long").groupBy("feature").agg(
        F.sum("n").alias("n")).toPandas().astype("int64").set_index("feature")["n"]
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    real = found[found.index >= 0]
    out[real.index.to_numpy()] = real.to_numpy()
    return out, int(found.get(-1, 0))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int):
    """Per-coordinate follow-the-regularised-leader over (features, values), several passes."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / (
            (BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.arange(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in order:
            at, x = rows[k]
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y[k]] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the held-out labels likeliest."""
    if not len(y):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit(docs: DataFrame, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows for which ``allowed``, a condition on the column ``id``, holds."""
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                        F.col(lang_col).alias("lang"))
            .where(F.col("id").isNotNull() & F.col("lang").isNotNull()
                   & F.col("text").isNotNull()).where(allowed))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MOST_ROWS // 20).collect()}
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS)), np.zeros(0))
    languages = sorted(sizes)
    each = min(sample, MOST_ROWS // len(languages))
    share = F.create_map(*[F.lit(v) for lang in languages
                           for v in (lang, min(1.0, each / sizes[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
                        < share[F.col("lang")])
    df, total = document_frequencies(rows.select("text"))
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1.0, 0.0)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"id": [], "text": [], "lang": []}), *batches])
        pdf = pdf.sort_values(["id", "text"], ignore_index=True)
        points, y = [], []
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            found, any_letter = grams(text)
            if any_letter:
                at, count = np.unique(found, return_counts=True)
                value = SCALE * count / len(found) * idf[at]
                points.append((np.append(at, DIMENSIONS), np.append(value, 1.0)))
                y.append(languages.index(lang))
        y = np.array(y, dtype=np.int64)
        held = np.arange(len(points)) % 5 == 0
        if not points:
            return
        w = ftrl([p for p, h in zip(points, held, strict=True) if not h], y[~held],
                 len(languages))
        logits = np.array([x @ w[at] for (at, x), h in zip(points, held, strict=True) if h])
        logits = logits.reshape(-1, len(languages))
        full = (w[:-1] * (SCALE * idf)[:, None]).T
        yield pd.DataFrame({
            "lang": range(len(languages)), "bias": w[-1], "t": temperature(logits, y[held]),
            "weights": [row.astype("<f4").tobytes() for row in full]})

    found = sorted(chosen.repartition(1).mapInPandas(
        train, "lang int, bias double, t double, weights binary").collect())
    return Model(languages, np.array([np.frombuffer(r.weights, "<f4") for r in found]),
                 np.array([r.bias for r in found]), found[0].t) if found \
        else Model([], np.zeros((0, DIMENSIONS)), np.zeros(0))


def predict(text: Column, model: Model) -> Column:
    """Struct of the language and its calibrated probability."""

    @F.arrow_udf("lang string, score double")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return named(text)
