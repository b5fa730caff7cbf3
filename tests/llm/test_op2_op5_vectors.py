"""Exact links and nearest neighbours against brute force."""

import numpy as np
import pytest

from quillstone.llm import ann, components, cover_tree


def vectors_of(spark, n=300, d=16):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d))
    x[50:90] = x[50] + 0.05 * rng.standard_normal((40, d))
    x[100:104] = 3 * x[100]
    x[100] = x[101]
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] + [1.0] * (d - 1), 0), (n + 3, [None] + [1.0] * (d - 1), 0), (n + 4, [], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), x.astype(np.float64)


def brute_links(x):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = y @ y.T >= cover_tree.COSINE
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("block", [None, 60, 3])
def test_cover_tree_is_exact(spark, block):
    df, x = vectors_of(spark)
    hit = brute_links(x)
    label = components.min_labels(*np.nonzero(hit), len(x))
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(df, block=block).collect()}
    assert len(got) == len(x) + 5
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (hit[i].sum(), label[i], label[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(len(x), len(x) + 5))


@pytest.mark.parametrize("block", [None, 24])
def test_cover_tree_links_within_each_dimension(spark, block):
    """Dimensions 16 and 9 near equal, few vectors of 3, one of 5 twice; against brute force."""
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(d) for d in [16, 9] * 150 + [3] * 12 + [5]]
    for i in range(40, 80):
        x[i] = (x[40] if len(x[i]) == 16 else x[41]) + 0.05 * rng.standard_normal(len(x[i]))
    for i in range(302, 306):
        x[i] = x[301] * (i - 300) + 0.01
    x = [v.astype(np.float32) for v in [*x, x[-1]]]
    hit = np.array([[a is not b and len(a) == len(b) and float(a.astype(float) @ b.astype(float)) >= cover_tree.COSINE * float(np.linalg.norm(a.astype(float)) * np.linalg.norm(b.astype(float))) for b in x] for a in x])
    np.fill_diagonal(hit, False)
    hit[-1, -2] = hit[-2, -1] = True
    label = components.min_labels(*np.nonzero(hit), len(x))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, block=block).collect()}
    assert got == {i: (hit[i].sum(), label[i]) for i in range(len(x))}
    assert min(hit[i].sum() for i in (40, 41, 301)) >= 3


def test_cover_tree_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert cover_tree.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (5, 3, 3)] + [(None, [1.0, 2.0])], schema)
    assert {(r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(same).collect()} == {(3, 3)}
    paths = cover_tree.build_paths(np.eye(4, dtype=np.float32))
    assert (np.sort(paths, axis=0) == np.arange(4)[:, None]).all()


def test_nets_are_nested_covers():
    x = np.random.default_rng(4).standard_normal((700, 3))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    paths = cover_tree.build_paths(x)
    above = np.zeros(len(x), int)
    for level, radius in enumerate(cover_tree.RADII):
        nodes, own = np.unique(paths[:, level]), paths[:, level]
        assert (np.linalg.norm(x - x[own], axis=1) <= radius + 1e-3).all() and (own[nodes] == nodes).all()
        assert (above[own] == above).all()  # a node's rows share their coarser node, and the node is one of them
        apart = cover_tree.distances(x[nodes], x[nodes])
        same = above[nodes][:, None] == above[nodes]
        assert apart[same & ~np.eye(len(nodes), dtype=bool)].min(initial=2) > radius - 1e-3
        above = own


def test_ann_recall_and_scores(spark):
    df, x = vectors_of(spark, 400)
    got = ann.op5(df).toPandas()
    hits, want = 0, 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, x[mine.vec_id] @ x[q], rtol=0, atol=1e-12)
        hits, want = hits + len(set(mine.vec_id) & set(best.tolist())), want + 20
    assert hits / want >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in ann.op5(few).orderBy("rank").collect()] == [(1, 2.0), (2, 2.0)]
    assert ann.op5(few.limit(0)).count() == 0


def test_ann_dimensions_and_repeats(spark):
    """Three dimensions at once, rows that repeat, ids that repeat with other vectors; against brute force over rows."""
    rng = np.random.default_rng(12)
    dims = [16, 9, 70] * 80
    rows = [(i % 230, [float(v) for v in rng.standard_normal(d).astype(np.float32)]) for i, d in enumerate(dims)]
    rows += rows[:40] + [(None, rows[0][1]), (20, None), (40, [0.0] * 16), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and any(v)]
    want, found = 0, 0
    got = ann.op5(df).toPandas()
    assert got.groupby("query_row")["rank"].apply(lambda r: sorted(r) == list(range(1, len(r) + 1))).all()
    mine = sorted(tuple(g.sort_values("rank").vec_id.tolist()) for _, g in got.groupby("query_row"))
    best = []
    for n, (i, v) in enumerate(ok):
        if i % 20 == 0:
            near = sorted((-float(np.einsum("ij,j->i", w[None], v)[0]), j) for m, (j, w) in enumerate(ok) if m != n and len(w) == len(v))[:20]
            best.append(tuple(j for _, j in near))
    assert len(mine) == len(best)
    for b in best:
        want, found = want + len(set(b)), found + max(len(set(b) & set(m)) for m in mine)
    assert found / want >= 0.95
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    rankings = ann.op5(twice).toPandas().sort_values("rank").groupby("query_row").vec_id.apply(list).tolist()
    assert rankings == [[1, 20, 2], [1, 20, 2]]


def test_packed_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for d in (5, 64, 100):
        y, q = rng.standard_normal((50, d)), rng.standard_normal((7, d))
        code = np.zeros((50, -(-d // 64) * 8), np.uint8)
        code[:, : -(-d // 8)] = np.packbits(y > 0, axis=1)
        bits, low, step = ann.planes(q)
        near = low[:, None] + step[:, None] * np.rint((q - low[:, None]) / step[:, None])  # the query as its planes have it
        got = ann.signed_products(code.view(np.uint64), (bits, low, step), near.sum(1))
        assert np.allclose(got, near @ np.sign(y).T)
