"""Stemmed search and the vector index against brute force."""

import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions.stemming import lexeme, stem
from quillstone.operators import cover_density as C
from quillstone.operators import vector_index as V

WORDS = (
    "caresses caress flies fli dies die ties tie cries cri gas gas gaps gap kiwis kiwi agreed agre feed feed hopping hop hoping hope luxuriated luxuri rapped rap bee bee "
    "cry cri by by say say consigned consign consistency consist consolatory consolatori consolingly consol conspicuously conspicu knackeries knackeri knightly knight "
    "generously generous general general communication communic arsenal arsenal revival reviv relational relat conditional condit rationalization ration operators oper "
    "happiness happi hopefulness hope usefully use apologies apolog analogy analog probably probabl vileness vile national nation electricity electr adjustable adjust "
    "replacement replac adoption adopt controlling control rolled roll rate rate cease ceas succeed succeed proceeds proceed sky sky skies sky dying die youth youth "
    "boyish boyish enjoyed enjoy suppliers supplier regulatory regulatori companies compani cybersecurity cybersecur obligations oblig formally formal formative format a1 a1 10ks 10ks"
).split()


def test_stems():
    assert {w: stem(w) for w in WORDS[::2]} == dict(zip(WORDS[::2], WORDS[1::2], strict=True))
    assert lexeme("there") is None and lexeme("") == ""


def brute_covers(tokens, wanted):
    """(covers, density) by trying every interval."""
    own = [lexeme(t) for t in tokens]
    whole = [(a, b) for a in range(len(own)) for b in range(a, len(own)) if wanted <= set(own[a : b + 1])]
    least = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    return len(least), sum(0.1 / (1 + sum(x not in wanted for x in own[a : b + 1])) for a, b in least)


def test_covers_against_every_interval(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = "risk risks supplier suppliers the of revenue growing grows grew note".split()
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(60)] + [None, "", "Risk-SUPPLIER; risk", "é " * 50 + "risk"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "risk supplier"), (2, "the revenue grows"), (3, "of the"), (4, "absent risks"), (5, "risk")], "query_id int, query string")
    asked = C.query_lexemes(queries)
    want = {q: {lexeme(t) for t in text.split()} - {None} for q, text in ((1, "risk supplier"), (2, "revenue grows"), (4, "absent risks"), (5, "risk"))}
    assert {(r[0], r[1]) for r in asked.collect()} == {(q, x) for q, xs in want.items() for x in xs}
    tokens = {i: C._TOKEN.findall((t or "").lower()) for i, t in enumerate(texts)}
    path = str(tmp_path / "index")
    C.write_index(docs, "id", "text", path, files=3)
    for index in (C.wanted_positions(docs, "id", "text", asked), C.read_index(spark, path, asked), C.positions(docs, "id", "text")):
        for every in (False, True):
            got = {(r["query_id"], r["id"]): (r["covers"], round(r["density"], 9)) for r in C.cover_density(asked, index, "id", every).collect()}
            exact = {}
            for q, i in itertools.product(want, tokens):
                n, density = brute_covers(tokens[i], want[q]) if every else (sum(lexeme(t) in want[q] for t in tokens[i]),) * 2
                if n:
                    exact[q, i] = (n, round(density if every else 0.1 * density, 9))
            assert got == exact
    read = C.read_index(spark, path, asked.where("query_id = 5"))
    assert re.search(r"PartitionFilters: \[[^\]]*folder", read._jdf.queryExecution().toString())
    assert C.cover_density(asked, C.positions(docs.where("false"), "id", "text"), "id").count() == 0


def vectors(seed, n, groups):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 24)) * 3
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, 24))


def exact_rows(x, keep, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for q in asked:
        s = u @ u[q]
        out += [(int(q), int(i)) for i in sorted(np.flatnonzero(keep), key=lambda i: (-s[i], i))[:k]]
    return out


@pytest.mark.parametrize("groups", [1, 40])
def test_recall_of_probed_cells(spark, tmp_path, groups):
    x = vectors(groups, 3000, groups)
    odd = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 2), (9004, [None] + [1.0] * 23, 3)]
    rows = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)] + odd, "id long, v array<double>, label int").repartition(6)
    index = V.build(rows, "id", "v", str(tmp_path / "ivf"), selectivity=0.2)
    again = V.load(spark, index.path)
    assert (again.centroids == index.centroids).all() and again.probes == index.probes
    assert index.rows(spark).count() == 3000 and 1 <= index.probes <= index.filtered_probes <= len(index.centroids)
    if groups > 1:
        assert index.probes < len(index.centroids) / 3  # vectors with structure are found in few cells
    queries = rows.where("id % 100 = 0 or id > 9000").select(F.col("id").alias("query_id"), F.col("v").alias("query_vec"))
    asked = range(0, 3000, 100)
    for where, keep in ((None, np.ones(3000, bool)), (F.col("label") == 2, np.arange(3000) % 5 == 2)):
        found = V.search(index, queries, "id", "v", 10, where)
        got = found.collect()
        exact = spark.createDataFrame(exact_rows(x, keep, asked, 10), "query_id long, id long")
        rates = [r["recall"] for r in V.recall_of(found, exact, "id").collect()]
        assert np.mean(rates) >= 0.9 and len(rates) == 30
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert all(keep[r["id"]] and abs(r["score"] - u[r["query_id"]] @ u[r["id"]]) < 1e-12 for r in got)
        assert {(r["query_id"], r["rank"]) for r in got} <= {(q, k) for q in asked for k in range(1, 11)} and len(got) > 270


def test_every_cell_is_exact_and_small_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 16)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 4)
    x = np.repeat(vectors(3, 90, 3), 2, axis=0)  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    x = np.array([r["v"] for r in rows.orderBy("id").collect()])
    index = V.build(rows, "id", "v", str(tmp_path / "ivf"), cells=5)
    queries = rows.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vec"))
    got = [(r["query_id"], r["id"]) for r in V.search(index, queries, "id", "v", 6, probes=5).orderBy("query_id", "rank").collect()]
    assert got == exact_rows(x, np.ones(180, bool), range(0, 180, 7), 6)
    one = V.build(rows.limit(1), "id", "v", str(tmp_path / "one"))
    assert V.search(one, queries, "id", "v", 3).count() == queries.count()
    with pytest.raises(ValueError):
        V.build(rows.where("false"), "id", "v", str(tmp_path / "none"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_recall_on_the_given_vectors(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = sorted((r["vec_id"], r["embedding"]) for r in rows.collect())
    assert [i for i, _ in data] == list(range(len(data)))
    x = np.array([v for _, v in data], float)
    index = V.build(rows, "vec_id", "embedding", str(tmp_path / "ivf"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = spark.createDataFrame(exact_rows(x, np.ones(len(x), bool), range(0, len(x), 100), 10), "query_id long, vec_id long")
    assert V.recall_of(V.search(index, queries, "vec_id", "embedding", 10), exact, "vec_id").agg(F.avg("recall")).first()[0] >= 0.9
