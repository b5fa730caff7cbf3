"""Connected components against union-find."""

import numpy as np

from quillstone.llm import components


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 500)] + [(-5, -9), (7, 7)]
    df = spark.createDataFrame([*e, (None, 1)], "a long, b long")
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    sizes: dict[int, int] = {}
    for r in want.values():
        sizes[r] = sizes.get(r, 0) + 1
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {x: r for x, r in want.items() if sizes[r] > 1}
    assert components.connected_components(df.limit(0)).count() == 0
