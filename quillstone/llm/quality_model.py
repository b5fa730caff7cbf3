"""Quality classifier: regularised quadratic discriminant analysis over statistics of whole texts.

Each class is a normal distribution over transformed statistics of its documents. Covariances are shrunk towards that of both
classes and towards a sphere; scores are differences of log densities, from distances in coordinates that the classes'
cached Cholesky factors give.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import cut, drop_cut, free_name

#: Statistics in their order; all are transformed so that neither counts nor shares have long tails.
STATISTICS = (
    "words", "word_length", "word_length_spread", "long_words", "distinct_words", "commonest_word", "stuttered_words", "capitals", "capital_starts", "digits",
    "symbols", "marks", "bare_words", "symbol_ends", "line_length", "repeated_lines", "sentence_ends", "non_ascii", "letter_entropy",
)
#: Statistics are kept as multiples of 1 / GRID up to MOST, so that their sums and products are whole numbers, equal in any order of rows.
GRID, MOST = 1 << 12, 1 << 5
#: Shrinkage towards both classes' covariance, and towards a sphere; both are chosen by the log loss over folds of the training rows.
POOLED, SPHERE = (0.0, 0.1, 0.3, 0.6), (0.001, 0.01, 0.1)
FOLDS = 5

_BYTES = np.arange(256)
_KIND = np.zeros((256, 7), np.int64)  # capitals, small letters, digits, sentence marks, other ASCII marks, ! and ?, non-ASCII bytes
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b"!?")):
    _KIND[np.isin(_BYTES, np.frombuffer(_set, np.uint8)), _i] = 1
_KIND[128:, 6] = 1
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_SAYS = _KIND[:, [0, 1, 2, 6]].any(1)


def _share(part: float, whole: float) -> float:
    """The log odds of a share, with half a case added to either side."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[int]:
    """The transformed statistics of a whole text as multiples of 1 / GRID; null is as the empty text. No language is told apart."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: only \x20 and \x09-\x0D split
    n = len(words)
    at = np.frombuffer(raw, np.uint8)
    counts = np.bincount(at, minlength=256)
    upper, lower, digits, stops, symbols, bangs, high = (counts @ _KIND).tolist()
    letters, solid = upper + lower, int(counts.sum() - counts[[9, 10, 11, 12, 13, 32]].sum())
    inside = np.concatenate([[False], ~_SPACE[at], [False]])
    first, past = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    lengths = past - first
    forms = Counter(words)
    stutter, starts, long = sum(map(operator.eq, words, words[1:])), int(_KIND[at[first], 0].sum()), int((lengths > 12).sum())
    ends = int(_KIND[at[past - 1], 4:6].sum())
    bare = n - int(np.logical_or.reduceat(_SAYS[at], first).sum()) if n else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[(counts > 0) & (np.arange(256) > 32)] / max(1, solid)
    values = (
        math.log1p(n), math.log1p(float(lengths.mean()) if n else 0.0), math.log1p(float(lengths.std()) if n else 0.0), _share(long, n), math.log1p(len(forms)) - math.log1p(n),
        _share(max(forms.values(), default=0), n), _share(stutter, n), _share(upper, letters), _share(starts, n), _share(digits, solid),
        _share(symbols, solid), _share(bangs, solid), _share(bare, n), _share(ends, n), math.log1p(n / max(1, len(lines))), _share(len(lines) - len(set(lines)), len(lines)),
        _share(stops, n), _share(high, solid), float(-(p * np.log(p)).sum()),
    )
    return [round(max(-MOST, min(MOST, v)) * GRID) for v in values]


@dataclass
class Model:
    """Per class the mean, the inverse of the covariance's Cholesky factor and half its log determinant; slope and offset of the score."""

    means: np.ndarray
    inverse: np.ndarray
    half_log_det: np.ndarray
    log_prior: float
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, with the classes' shares, per dimension."""
        halves = [0.5 * (((x - m) @ f.T) ** 2).sum(1) + d for m, f, d in zip(self.means, self.inverse, self.half_log_det, strict=True)]
        return (halves[0] - halves[1] + self.log_prior) / x.shape[1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float, sphere: float) -> Model:
    """The model from each class's number of rows, sums and sums of products of statistics.

    A class's covariance is mixed with that of both classes (`pooled`) and then with a sphere of its mean variance (`sphere`).
    """
    means = sums / counts[:, None]
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    both, d = scatter.sum(0) / counts.sum(), sums.shape[1]
    inverse, half = [], []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / counts[k] + pooled * both
        own = (1 - sphere) * own + (sphere * np.trace(own) / d + 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(own)
        inverse.append(np.linalg.inv(factor))
        half.append(float(np.log(np.diag(factor)).sum()))
    return Model(means, np.array(inverse), np.array(half), math.log(counts[1] / counts[0]))


def calibrated(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset that give the least weighted log loss of labels y by a logistic function of z, and that loss a row."""
    scale = max(1e-9, float(np.sqrt(np.average(z * z, weights=w))))
    x, b = np.stack([z / scale, np.ones_like(z)], 1), np.zeros(2)
    loss = lambda b: float((w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + 1e-3 * b @ b)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (w * (y - q)) - 2e-3 * b)
        while loss(b + step) > loss(b) and np.abs(step).max() > 1e-9:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1]), loss(b) / float(w.sum())


def measured(docs: DataFrame, text: str = "text", out: str = "x") -> DataFrame:
    """docs without their text, with `out`, the statistics as whole numbers."""
    keep = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(*keep).schema.add(out, T.ArrayType(T.IntegerType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], x], names=[*keep, out])

    return docs.select(*keep, text).mapInArrow(run, schema)


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y, fold) of every labelled document whose CRC-32 of doc_id mod 3 isn't 1; rows: (doc_id, x), as measured() gives them.

    Statistics are joined to labels, so texts aren't moved. A document with several labels is of class 1 if all say so; null labels don't count. Documents with equal statistics and label
    are one row, so exact copies count once. Folds go by the hash of the statistics, so they fall into one fold.
    """
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = rows.select("doc_id", "x").join(own, "doc_id").select("x", "y").dropDuplicates(["x", "y"])
    return known.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int"))


def moments(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By (fold, class): the number of rows, the sums and the sums of products of statistics, summed exactly in tasks and by Spark.

    What comes to the driver has a fixed size: FOLDS x 2 x (1 + d + d * d) numbers.
    """
    d = len(STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list[int]] = {}
        for pdf in batches:
            for (fold, y), part in pdf.groupby(["fold", "y"])["x"]:
                x = np.stack(part.to_list()).astype(np.int64)
                new = [len(x), *x.sum(0).tolist(), *(x.T @ x).ravel().tolist()]
                total[fold, y] = [a + b for a, b in zip(total[fold, y], new, strict=True)] if (fold, y) in total else new
        rows = [(fold, y, i, v) for (fold, y), vs in total.items() for i, v in enumerate(vs)]
        yield pd.DataFrame(rows, columns=["fold", "y", "i", "v"])

    out = np.zeros((FOLDS, 2, 1 + d + d * d))
    for r in sample.select("fold", "y", "x").mapInPandas(run, "fold int, y int, i int, v long").groupBy("fold", "y", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r["fold"], min(1, max(0, r["y"])), r["i"]] += float(r["v"])
    return out[:, :, 0], out[:, :, 1 : 1 + d] / GRID, out[:, :, 1 + d :].reshape(FOLDS, 2, d, d) / GRID**2


#: Bins into which the folds' scores are counted for the choice of shrinkage.
BINS = 2001


def fit(rows: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all training rows among rows (doc_id, x), or None if a class has fewer than two rows; equal for equal rows, however they are dealt.

    For each choice of shrinkage every fold's rows are scored by the model of the other folds; what Spark counts are histograms
    of these scores by class, of BINS bins. The choice with the least log loss after calibration is fitted on all rows.
    """
    sample = cut(training_rows(rows, labels), "quality-rows")
    n, sums, products = moments(sample)
    if n.sum(0).min() < 2:
        drop_cut(sample)
        return None
    choices = [(p, s) for p in POOLED for s in SPHERE]
    folded = [f for f in range(FOLDS) if (n.sum(0) - n[f]).min() >= 2]
    models = {f: [discriminant(n.sum(0) - n[f], sums.sum(0) - sums[f], products.sum(0) - products[f], p, s) for p, s in choices] for f in folded}
    # log odds beyond +-25 a dimension are as sure as can be
    edges = np.linspace(-25, 25, BINS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (fold, y), part in pdf.groupby(["fold", "y"])["x"]:
                x = np.stack(part.to_list()) / GRID
                for c, model in enumerate(models.get(fold, [])):
                    bins, counts = np.unique(np.clip(np.rint((model.difference(x) + 25) * (BINS - 1) / 50), 0, BINS - 1).astype(int), return_counts=True)
                    out += [(c, y, int(b), int(k)) for b, k in zip(bins, counts, strict=True)]
            yield pd.DataFrame(out, columns=["c", "y", "b", "k"])

    counts = np.zeros((len(choices), 2, BINS))
    for r in sample.mapInPandas(run, "c int, y int, b int, k long").groupBy("c", "y", "b").agg(F.sum("k").alias("k")).collect():
        counts[r["c"], min(1, max(0, r["y"])), r["b"]] = r["k"]
    drop_cut(sample)
    z, y = np.tile(edges, 2), np.repeat([0.0, 1.0], BINS)
    # both classes weigh alike in the calibration, so that 0.5 is where they are equally likely
    weigh = [np.concatenate([c[k] / max(1.0, c[k].sum()) * c.sum() / 2 for k in (0, 1)]) for c in counts]
    fits = [calibrated(z, y, w) if w.sum() else (len(STATISTICS), 0.0, math.inf) for w in weigh]
    best = min(range(len(choices)), key=lambda c: (fits[c][2], c))
    model = discriminant(n.sum(0), sums.sum(0), products.sum(0), *choices[best])
    model.slope, model.offset = fits[best][:2]
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`: the probability that a document is good, from its whole text; without a model 0.5.

    Null and empty texts are scored as texts without words. Every row and column is kept; a column already named `out` is replaced.
    """
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(text)], float).reshape(-1, len(STATISTICS)) / GRID
            yield pa.RecordBatch.from_arrays([*batch.columns, scores(x, model)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)]))


def scores(x: np.ndarray, model: Model | None) -> pa.Array:
    return pa.array(model.probability(x) if model else np.full(len(x), 0.5), pa.float64())


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least the threshold, with their own columns."""
    out = free_name(docs, "quality_")
    rows = cut(measured(docs.select("doc_id", "text")), "statistics")
    kept = score(docs, fit(rows, labels), out=out).where(F.col(out) >= threshold).drop(out)
    drop_cut(rows)
    return kept


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a row with a null doc_id isn't held out.

    Texts are read once: their statistics are written, joined to labels for the fit, and scored.
    """
    rows = cut(measured(docs.select("doc_id", "text")), "statistics")
    model = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) / GRID
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores(x, model)], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType(), False)]))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
