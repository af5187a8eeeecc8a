"""Per-document text measures as built-in column expressions, and small regressions on bounded labelled samples."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SYMBOLS = "#$%&*|!@^~<>{}[]\\=+_"
#: Labelled rows used for a fit at most; chosen by the hash of their identifiers.
SAMPLE_ROWS = 20_000


def learnable(id_col: str) -> Column:
    """Rows that a fit may learn from: the rest, where crc32 of the identifier is divisible by 5, is held out."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 != 0


#: Measures that classifiers use; one more, the number of words, follows them.
MEASURES = 10


def measures(text: Column, also=None) -> Column:
    """An array of ``MEASURES`` shape measures of a text and its number of words; null counts as empty.

    Letters of a kind are counted by the length of the text without them; one translation marks three kinds at once.
    With ``also``, a function of the array of words, a struct of the array ``m`` and its result ``also``.
    """
    text = F.coalesce(text, F.lit(""))
    kinds = (SYMBOLS, string.ascii_uppercase, string.digits)
    marked = F.translate(text, "".join(kinds), "".join(chr(i + 1) * len(k) for i, k in enumerate(kinds)))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(of: Column, letter: str) -> Column:
        return (F.octet_length(of) - F.octet_length(F.replace(of, F.lit(letter), F.lit("")))) / chars

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("double")
        some = F.greatest(n, F.lit(1.0))
        variety = F.size(F.array_distinct(w)) / some
        rest = [share(text, "\n"), share(text, "|"), share(text, "!"), variety, chars / some, F.log1p(some), variety * F.log1p(some), n]
        m = F.concat(let(marked, lambda x: F.array(*[share(x, chr(i + 1)) for i in range(3)])), F.array(*rest))
        return m if also is None else F.struct(m.alias("m"), also(w).alias("also"))

    return let(F.array_remove(F.split(text, r"\s+"), ""), of_words)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` labelled rows to learn from: (id, text, labels). Conflicting repeats of a label keep the largest, of repeated documents the text that sorts first is taken."""
    mine = F.col(f"`{id_col}`")
    chosen = (
        labels.where(learnable(id_col))
        .groupBy(mine.alias("id"))
        .agg(*[F.max(f"`{c}`").alias(c) for c in label_cols])
        .dropna()
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    found = docs.select(mine.alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in label_cols])


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), x.std(axis=0) + 1e-9


def expand(x: np.ndarray) -> np.ndarray:
    """Clipped measures, their squares and a constant."""
    z = np.clip(x, -8, 8)
    return np.column_stack([z, z * z, np.ones(len(z))])


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (features, classes) of a ridge multinomial regression by Newton steps."""
    n, d = x.shape
    w, target = np.zeros((d, classes)), np.eye(classes)[y]
    for _ in range(steps):
        e = np.exp((s := x @ w) - s.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        g = (x.T @ (p - target) + ridge * w).T.ravel()
        h = np.zeros((classes * d, classes * d))
        for i in range(classes):
            for j in range(classes):
                h[i * d : i * d + d, j * d : j * d + d] = (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
        step = np.linalg.solve(h + ridge * np.eye(classes * d), g).reshape(classes, d).T
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear_columns(values: list[Column], mean: np.ndarray, sd: np.ndarray, weights: np.ndarray) -> list[Column]:
    """The scores of ``expand``-ed measures as column expressions, one per column of ``weights``."""
    z = [F.greatest(F.least((v - float(m)) / float(s), F.lit(8.0)), F.lit(-8.0)) for v, m, s in zip(values, mean, sd, strict=True)]
    terms = z + [c * c for c in z]
    out = []
    for k in range(weights.shape[1]):
        score = F.lit(float(weights[-1, k]))
        for t, w in zip(terms, weights[:-1, k], strict=True):
            score = score + t * float(w)
        out.append(score)
    return out
