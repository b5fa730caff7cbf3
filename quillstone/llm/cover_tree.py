"""Embedding near-duplicates by dual traversal of cover trees: exact threshold pairs under cosine similarity.

Vectors are put on the unit sphere, where cosine c is Euclidean distance sqrt(2 - 2 c). The tree has two parts. Above, the
vectors of a dimension are dealt to pivots, and cells that are still too large to pivots of their own, so that its depth grows
with the table; each node has a covering radius. Rows travel down this tree and are copied only to the cells in which a
link is possible. Below, the rows of a block have nested nets with halving radii. Pairs of nodes are dropped when their centres are
further apart than their covering radii and the threshold, and accepted whole when they are so near that every pair inside
is linked; what remains is compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import cut, drop_cut
from quillstone.llm.components import connected_components, star_forest

#: Least cosine of a link; radii of the nested nets of a block; bytes of a block's vectors in single precision.
COSINE, RADII, BLOCK_BYTES = 0.95, (0.8, 0.4, 0.2, 0.1, 0.05), 4 << 20
#: Most pivots of a node; vectors sampled for each pivot; levels above the blocks (cells that are too large after the last are dealt by hash).
FANOUT, SAMPLED, MAX_LEVELS = 64, 32, 4
CHUNK = 1 << 18
NET_BATCH = 256


def reach(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def slack(d: int) -> float:
    """What bounds allow for single precision: a dot product of unit vectors errs by up to about d / 2^24, a distance by the root of four times that."""
    return math.sqrt(4 * (d + 8) / (1 << 24))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of a and of b, on the unit sphere."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return x, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: every prefix is a net whose radius only falls."""
    at, near = [0], distances(x, x[:1])[:, 0]
    while len(at) < min(count, len(x)):
        far = int(np.argmax(near))
        if near[far] <= 0:
            break
        at.append(far)
        near = np.minimum(near, distances(x, x[far : far + 1])[:, 0])
    return x[at]


class Upper:
    """The tree above the blocks of one dimension: split[node] = (pivots, first child); children are numbered in a row."""

    def __init__(self, root: int):
        self.root, self.split, self.radius = root, {}, {}

    def descend(self, x: np.ndarray) -> tuple[list[list[int]], list[list[float]]]:
        """For each row the nodes on its way down, the nearest pivot's each time, and its distances from them."""
        node = np.full(len(x), self.root)
        paths, away = [[self.root] for _ in x], [[2.0] for _ in x]
        todo = np.arange(len(x))
        while len(todo := todo[np.isin(node[todo], list(self.split))]):
            for n in np.unique(node[todo]).tolist():
                rows = todo[node[todo] == n]
                pivots, first = self.split[n]
                d = distances(x[rows], pivots)
                best = d.argmin(1)
                for r, k, a in zip(rows.tolist(), best.tolist(), d[np.arange(len(rows)), best].tolist(), strict=True):
                    paths[r].append(first + k)
                    away[r].append(a)
                node[rows] = first + best
        return paths, away

    def reachable(self, x: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves whose rows can be within `far` of each row.

        A child is out of reach if its covering radius ends before, or if the plane between its pivot and the nearest pivot is
        too far: its rows are on the other side of that plane.
        """
        extra, out_r, out_n = slack(x.shape[1]), [], []
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if n not in self.split:
                out_r.append(rows)
                out_n.append(np.full(len(rows), n))
                continue
            pivots, first = self.split[n]
            d = distances(x[rows], pivots)
            best = d.argmin(1)
            radii = np.array([self.radius.get(first + k, -9.0) for k in range(len(pivots))])
            apart = distances(pivots, pivots)[best]
            near = (d <= radii + far + extra) & (d**2 - d.min(1)[:, None] ** 2 <= 2 * (apart + extra) * (far + extra) + 2 * extra**2)
            todo += [(first + k, rows[near[:, k]]) for k in range(len(pivots)) if near[:, k].any()]
        return np.concatenate(out_r), np.concatenate(out_n)


def cover(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row the row of its node: nodes are more than `radius` apart, and each row is within it of its node. The first row is a node."""
    own = np.full(len(x), -1)
    least = np.float32(1 - radius**2 / 2)
    free = np.arange(len(x))
    while len(free):
        some = free[:NET_BATCH]
        near = x[some] @ x[free].T >= least
        for k, i in enumerate(some.tolist()):
            if own[i] < 0:
                mine = free[near[k]]
                own[mine[own[mine] < 0]] = i
                own[i] = i
        free = free[own[free] < 0]
    return own


def build_paths(x: np.ndarray, radii: tuple[float, ...] = RADII) -> np.ndarray:
    """(rows, levels): the node of each row at each level, coarsest first. A node is a node of every finer level, too."""
    paths = np.tile(np.arange(len(x), dtype=np.int32)[:, None], (1, len(radii)))
    cells = [np.arange(len(x))]
    for level, radius in enumerate(radii):
        finer = []
        for cell in cells:
            own = cover(x[cell], radius)
            paths[cell, level] = cell[own]
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    head = own[group[0]]
                    finer.append(cell[np.concatenate([[head], group[group != head]])])
        cells = finer
    return paths


class Tree:
    """Nodes of the rows at hand, level by level: centre, covering radius, members in consecutive positions of `order`."""

    def __init__(self, x: np.ndarray, paths: np.ndarray):
        self.order = np.lexsort(paths.T[::-1])
        self.levels = []
        for level in range(paths.shape[1] + 1):
            if level < paths.shape[1]:
                p = paths[self.order, : level + 1]
                first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(1)])) if len(p) else np.zeros(0, np.int64)
            else:
                first = np.arange(len(x))
            end = np.append(first[1:], len(x))
            centre = x[self.order[first]]
            of = np.repeat(np.arange(len(first)), end - first)
            away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[self.order], centre[of])))
            radius = np.zeros(len(first), np.float32)
            np.maximum.at(radius, of, np.where((end - first)[of] > 1, away, 0))
            self.levels.append((first, end, centre, radius))

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end child, at the next level, of each node."""
        first, end = self.levels[level][:2]
        below = self.levels[level + 1][0]
        return np.searchsorted(below, first), np.searchsorted(below, end)


def _expand(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the ranges [a0, a1) x [b0, b1), about CHUNK at a time."""
    counts = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = counts[at:to]
        of = np.repeat(np.arange(at, to), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        width = (b1 - b0)[of]
        yield a0[of] + k // width, b0[of] + k % width
        at = to


def traverse(xa: np.ndarray, ua: np.ndarray, pa: np.ndarray, xb: np.ndarray, ub: np.ndarray, pb: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows that are linked: (rows of a in tree order, from, to of b in tree order) as whole blocks or as pairs.

    Yields (a_from, a_to, b_from, b_to) over the trees' orders; every pair inside is a link. With `same`, pairs come in
    both directions and a row may meet itself.
    """
    ta, tb, far = Tree(ua, pa), Tree(ub, pb), reach(cosine)
    na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    ca, ra, cb, rb = *ta.levels[0][2:], *tb.levels[0][2:]
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []
    extra = slack(ua.shape[1])
    single = rb == 0
    for part in (np.flatnonzero(single), np.flatnonzero(~single)):  # most nodes of scattered vectors have no radius, and a narrow bound
        widest = rb[part].max(initial=0)
        for at in range(0, len(ca) if len(part) else 0, 512):
            bound = np.minimum(2, ra[at : at + 512] + widest + far + extra)
            near = ca[at : at + 512] @ cb[part].T >= (1 - bound**2 / 2 - extra**2)[:, None].astype(np.float32)
            i, j = np.divmod(np.flatnonzero(near), len(part))  # far faster than a search in two dimensions
            i, j = i + at, part[j]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", ca[i], cb[j])))
            keep = d <= ra[i] + rb[j] + far + extra
            if keep.any():
                todo.append((0, i[keep], j[keep]))
    last = len(ta.levels) - 1
    while todo:
        level, i, j = todo.pop()
        (fa, ea, ca, ra), (fb, eb, cb, rb) = ta.levels[level], tb.levels[level]
        if level == last:
            oa, ob = ta.order[i], tb.order[j]
            cos = np.einsum("ij,ij->i", xa[oa], xb[ob]) / (na[oa] * nb[ob])
            hit = cos >= cosine
            if hit.any():
                yield i[hit], i[hit] + 1, j[hit], j[hit] + 1
            continue
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", ca[i], cb[j])))
        whole = d + ra[i] + rb[j] <= far - extra
        if whole.any():
            yield fa[i[whole]], ea[i[whole]], fb[j[whole]], eb[j[whole]]
        keep = ~whole & (d <= ra[i] + rb[j] + far + extra)
        i, j = i[keep], j[keep]
        (a0, a1), (b0, b1) = ta.children(level), tb.children(level)
        for k, m in _expand(a0[i], a1[i], b0[j], b1[j]):
            ca2, ra2 = ta.levels[level + 1][2:]
            cb2, rb2 = tb.levels[level + 1][2:]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", ca2[k], cb2[m])))
            near = d <= ra2[k] + rb2[m] + far + extra
            if near.any():
                todo.append((level + 1, k[near], m[near]))


def _link_group(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = int(pdf["code"].iat[0])
        first, second = code >> 32, code & 0xFFFFFFFF
        a, b = pdf[pdf["block"] == first], pdf[pdf["block"] == second]
        none = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(a) or not len(b):
            return none
        same = first == second
        (xa, ua), pa = unit(a["vec"]), np.stack(a["path"].to_list())
        (xb, ub), pb = ((xa, ua), pa) if same else (unit(b["vec"]), np.stack(b["path"].to_list()))
        oa, ob = np.lexsort(pa.T[::-1]), np.lexsort(pb.T[::-1])
        wa, wb = a["copies"].to_numpy(np.int64)[oa], b["copies"].to_numpy(np.int64)[ob]
        ida, idb = a["node"].to_numpy(np.int64)[oa], b["node"].to_numpy(np.int64)[ob]
        sum_a, sum_b = (np.concatenate([[0], np.cumsum(w)]) for w in (wa, wb))
        add_a, add_b = np.zeros(len(oa) + 1, np.int64), np.zeros(len(ob) + 1, np.int64)  # differences of link counts along the order
        ends = []
        for a0, a1, b0, b1 in traverse(xa, ua, pa, xb, ub, pb, same, cosine):
            to_a, to_b = sum_b[b1] - sum_b[b0], sum_a[a1] - sum_a[a0]
            np.add.at(add_a, a0, to_a)
            np.add.at(add_a, a1, -to_a)
            if not same:
                np.add.at(add_b, b0, to_b)
                np.add.at(add_b, b1, -to_b)
            n = a1 - a0  # a forest of the block: its rows of a to its first of b, its rows of b to its first of a
            of = np.repeat(np.arange(len(n)), n)
            ends.append((ida[a0[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)], idb[b0[of]]))
            n = b1 - b0
            of = np.repeat(np.arange(len(n)), n)
            ends.append((idb[b0[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)], ida[a0[of]]))
            if sum(len(e[0]) for e in ends) > 1 << 20:
                ends = [star_forest(*(np.concatenate(e) for e in zip(*ends, strict=True)))]
        if not ends:
            return none
        node, other = star_forest(*(np.concatenate(e) for e in zip(*ends, strict=True)))
        links_a = np.cumsum(add_a[:-1]) - (wa if same else 0)  # a row meets itself in its own block
        out = [pd.DataFrame({"node": ida, "links": links_a})]
        if not same:
            out.append(pd.DataFrame({"node": idb, "links": np.cumsum(add_b[:-1])}))
        counts = pd.concat(out)
        return pd.concat([counts[counts["links"] > 0].assign(other=pd.NA), pd.DataFrame({"node": node, "links": 0, "other": other})]).astype({"other": "Int64"})

    return run


def block_rows(d: int, block: int | None = None) -> int:
    return block or max(256, BLOCK_BYTES // (4 * d))


def _split(tree: Upper, sizes: dict[int, int], sample: dict[int, list[list[float]]], rows: int, free: int) -> int:
    """Give the nodes with a sample pivots of their own, one for each block's rows; the next free number."""
    for n, vectors in sorted(sample.items()):
        pivots = choose_pivots(unit(pd.Series(vectors))[1], min(FANOUT, math.ceil(sizes[n] / rows)))
        if len(pivots) > 1:
            tree.split[n] = (pivots, free)
            free += len(pivots)
    return free


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec: str = "embedding", key: str = "vec_id", block: int | None = None) -> DataFrame:
    """key, n_links, component_id, kept for every row of vectors.

    Equal vectors are one class before pairs are sought, whatever their number. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing and are their own component. Vectors of different dimensions don't link;
    those of each dimension are compared with each other. Every row is a vector of its own, so repeated rows link with each other. A row with a null key is compared but
    doesn't name a component that has others. No rows give no rows. The tree above the blocks, its sample (SAMPLED vectors for each
    cell, from which pivots are chosen; they decide how much is pruned, never what is linked) and its statistics are the driver's: a
    few vectors and numbers for every block of rows. `block` sets the rows of a block, for tests.
    """
    spark = vectors.sparkSession
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    good = F.coalesce(F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("key"), F.when(good, F.col(vec)).alias("vec")).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    classes = cut(rows.where("vec is not null").groupBy("vec").agg(F.min("key").alias("first"), F.count("*").alias("copies"), F.min("node").alias("node")), "classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()}
    trees = {d: Upper(i) for i, d in enumerate(sorted(sizes))}
    # a class that is alone in its dimension has nothing to be compared with
    of_d = classes.join(F.broadcast(spark.createDataFrame([(d,) for d in sizes], "d_ int")), F.size("vec") == F.col("d_"), "left_semi").select("vec", "node", "copies")
    free, far = len(trees), reach(cosine)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby(pdf["vec"].map(len)):
                paths, away = trees[d].descend(unit(part["vec"])[1])
                yield part.assign(path=paths, away=away)

    dealt_schema = T.StructType([*of_d.schema.fields, T.StructField("path", T.ArrayType(T.LongType())), T.StructField("away", T.ArrayType(T.DoubleType()))])
    dealt = cut(of_d.mapInPandas(deal, dealt_schema), "cells") if sizes else of_d.withColumns({"path": F.array().cast("array<bigint>"), "away": F.array().cast("array<double>")})
    for level in range(MAX_LEVELS + 1):
        at = dealt.select(F.size("vec").alias("d"), F.explode(F.arrays_zip("path", "away")).alias("p"))
        stats = at.groupBy("d", F.col("p.path").alias("cell")).agg(F.count("*").alias("n"), F.max("p.away").alias("r")).collect()  # a row for each node
        for r in stats:
            trees[r["d"]].radius[r["cell"]] = r["r"]
        count = {r["cell"]: r["n"] for r in stats}
        large = [(r["cell"], min(1.0, SAMPLED * min(FANOUT, math.ceil(r["n"] / block_rows(r["d"], block))) / r["n"])) for r in stats if r["cell"] not in trees[r["d"]].split and r["n"] > 1.5 * block_rows(r["d"], block)]
        if not large or level == MAX_LEVELS:
            break
        hashed = F.xxhash64(F.lit(7 + level), F.col("vec"))
        drawn = dealt.withColumn("cell", F.element_at("path", -1)).join(F.broadcast(spark.createDataFrame(large, "cell long, part double")), "cell")
        drawn = drawn.where(F.pmod(hashed, F.lit(1 << 20)) < F.ceil(F.col("part") * (1 << 20))).select("cell", "vec").orderBy("cell", hashed, "vec").collect()
        sample: dict[int, dict[int, list]] = {}
        for r in drawn:
            sample.setdefault(len(r["vec"]), {}).setdefault(r["cell"], []).append(r["vec"])
        before = free
        for d, of_cell in sorted(sample.items()):
            free = _split(trees[d], count, of_cell, block_rows(d, block), free)
        if free == before:
            break
        drop_cut(dealt)
        dealt = cut(of_d.mapInPandas(deal, dealt_schema), "cells")
    # leaves that are still too large have several blocks, to which their rows are dealt by hash
    leaves = {r["cell"]: math.ceil(r["n"] / (1.5 * block_rows(r["d"], block))) for r in stats if r["cell"] not in trees[r["d"]].split}
    salts, base = np.zeros(free, np.int64), np.zeros(free, np.int64)
    for cell, n in leaves.items():
        salts[cell] = n
    base = np.cumsum(salts) - salts

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The block of each row, and the pairs of blocks in which it can have links."""
        for pdf in batches:
            for d, part in pdf.groupby(pdf["vec"].map(len)):
                cell = np.array([p[-1] for p in part["path"]])
                salt = (part["node"].to_numpy().view(np.uint64) // np.uint64(7) % salts[cell].astype(np.uint64)).astype(np.int64)
                own = base[cell] + salt
                row, leaf = trees[d].reachable(unit(part["vec"])[1], far)
                n = salts[leaf]
                row, partner = np.repeat(row, n), np.repeat(base[leaf], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                code = np.minimum(partner, own[row]) << 32 | np.maximum(partner, own[row])
                order = np.argsort(row, kind="stable")
                codes = np.split(code[order], np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                yield pd.DataFrame({"vec": part["vec"], "node": part["node"], "copies": part["copies"], "block": own, "codes": codes})

    kind = of_d.schema["vec"].dataType
    routed_schema = T.StructType([T.StructField("vec", kind), T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("block", T.LongType()), T.StructField("codes", T.ArrayType(T.LongType()))])
    routed = dealt.mapInPandas(route, routed_schema)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(path=list(build_paths(unit(pdf["vec"])[1])))

    grown = routed.groupBy("block").applyInPandas(grow, T.StructType([*routed_schema.fields, T.StructField("path", T.ArrayType(T.IntegerType()))]))
    met = grown.select("vec", "node", "copies", "block", "path", F.explode("codes").alias("code"))
    found = cut(met.groupBy("code").applyInPandas(_link_group(cosine), "node long, links long, other long"), "found")
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    member = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = classes.select("node", "first", "copies").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "component").join(counts, "node", "left").select(F.col("node").alias("node_"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.drop("vec").join(named, rows.node == named.node_, "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def op2(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
