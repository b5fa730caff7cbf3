"""The discriminant against textbook formulas, held-out accuracy, and rows of every kind."""

import math
import zlib

import numpy as np
import pytest
from helpers import FOLDER, TEXTS, docs_of, empty, needs_tables
from pyspark.sql import functions as F

from quillstone.llm import quality_model as Q


def labelled(spark, n=240):
    rng = np.random.default_rng(3)
    words = lambda k: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(k))
    texts = [(words(60) + ".\n" + words(30)).capitalize() if i % 3 else " ".join(f"{w.upper()}!!" for w in words(50).split()) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)] + [(0, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, texts


def test_densities_are_those_of_the_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + k for k in (0, 1)]
    n, s, p = np.array([200, 200]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x])
    pooled, sphere = 0.3, 0.1
    covs = [np.cov(a.T, bias=True) for a in x]
    mixed = [(1 - pooled) * c + pooled * (covs[0] + covs[1]) / 2 for c in covs]
    mixed = [(1 - sphere) * c + (sphere * np.trace(c) / 4 + 1e-6) * np.eye(4) for c in mixed]
    at = rng.normal(size=(50, 4))
    logs = []
    for a, c in zip(x, mixed, strict=True):
        d = at - a.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c)))
    got = Q.discriminant(n.astype(float), s, p, pooled, sphere).difference(at)
    assert np.allclose(got, (logs[1] - logs[0]) / 4)


def test_moments_are_exact_and_fit_doesn_t_depend_on_partitions(spark):
    docs, labels, texts = labelled(spark)
    sample = Q.training_rows(Q.measured(docs), labels)
    own = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1]
    n, s, p = Q.moments(sample)
    kinds = {(tuple(Q.statistics(texts[i])), int(i % 3 > 0)) for i in own}
    assert n.sum() == len(kinds)
    for y in (0, 1):
        x = np.array([k for k, c in kinds if c == y])
        assert (s.sum(0)[y] * Q.GRID == x.sum(0)).all() and (p.sum(0)[y] * Q.GRID**2 == x.T @ x).all()
    scores = [{r["doc_id"]: r["score"] for r in Q.op12(docs.repartition(k), labels.repartition(k)).collect()} for k in (1, 5)]
    assert scores[0] == scores[1]
    assert np.mean([(scores[0][i] >= 0.5) == (i % 3 > 0) for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97


def test_statistics_by_hand():
    named = lambda t: dict(zip(Q.STATISTICS, np.array(Q.statistics(t)) / Q.GRID, strict=True))
    x = named("One two two. A!! | ## é9 \n\nOne two")
    near = lambda a, b: abs(a - b) <= 0.5 / Q.GRID + 1e-9
    share = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5))
    assert near(x["words"], math.log1p(9)) and near(x["stuttered_words"], share(0, 9)) and near(x["commonest_word"], share(2, 9))
    assert near(x["capital_starts"], share(3, 9)) and near(x["bare_words"], share(2, 9)) and near(x["symbol_ends"], share(3, 9))
    assert near(x["digits"], share(1, 25)) and near(x["capitals"], share(3, 16)) and near(x["non_ascii"], share(2, 25)) and near(x["repeated_lines"], share(0, 2))
    assert near(x["distinct_words"], math.log1p(7) - math.log1p(9)) and near(named("a a a b")["stuttered_words"], share(2, 4))
    assert Q.statistics(None) == Q.statistics("") and Q.statistics(" \n ")[0] == 0
    assert len(Q.statistics("x" * 3_000_000)) == len(Q.STATISTICS) and max(map(abs, Q.statistics("word " * 500_000))) <= Q.MOST * Q.GRID


def test_rows_of_every_kind(spark):
    docs, labels, _ = labelled(spark)
    model = Q.fit(Q.measured(docs), labels)
    odd = docs_of(spark, [*TEXTS, "long " * 400_000])
    got = Q.score(odd.withColumn("score", F.lit("old")), model)
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and {c for c in got.columns} == {*odd.columns, "score"}
    assert Q.op12(empty(spark), labels).count() == 0
    assert {r["score"] for r in Q.op12(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert {r["score"] for r in Q.op12(docs, labels.where("false")).collect()} == {0.5}
    held = {r["doc_id"]: r["held_out"] for r in Q.op12(odd, labels).collect()}
    assert held[None] is False and all(held[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in held if i is not None)
    assert Q.keep_good(docs, labels).columns == docs.columns and 0 < Q.keep_good(docs, labels).count() < docs.count()


@needs_tables
@pytest.mark.parametrize("folder", [FOLDER.replace("0.001", "0.01")])
def test_held_out_accuracy(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.op12(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    right = rows.predicted == rows.quality
    assert right.mean() > 0.96 and right[rows.quality == 1].mean() > 0.97 and right[rows.quality == 0].mean() > 0.9
