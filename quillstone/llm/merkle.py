"""Merkle manifests of datasets: a digest of every row, of runs of digests up to one root, and each row's proof.

Levels are built bottom-up, each a table in the shared folder. Proofs are pushed top-down: a level's runs are joined to their
parents, and every child puts its siblings before the proof that its parent inherited.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import crc32_sql, cut, drop_cut

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIDES = "array<struct<left: binary, right: binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256, as 32 bytes, of digests that are written as lowercase hex text one after another."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))).cast("binary"), 256))


def row_digest(values: dict[str, Column]) -> Column:
    """SHA-256, as 32 bytes, of the values in turn: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def joined(hashes: Column) -> Column:
    """The digests of an array of structs with `hash` one after another."""
    return F.aggregate(hashes, F.lit(b""), lambda acc, x: F.concat(acc, x["hash"]))


def placed(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """rows with `pos`, from 0 by `order` within `tree`, and `n`, the tree's number of rows; the tree may hold any share of all rows.

    Rows are range-sorted and written; a row's place is that in its file plus the tree's rows in files before, which are
    counted by file. So no task holds a tree.
    """
    written = cut(rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order), "merkle-sorted")
    hidden = written.metadataColumn("_metadata")
    part = F.regexp_extract(hidden["file_path"], r"part-(\d+)[^/]*$", 1).cast("int")
    at = written.select("*", part.alias("part_"), hidden["row_index"].alias("row_"))
    per = at.groupBy(tree, "part_").agg(F.min("row_").alias("first_"), F.count("*").alias("count_"))
    before = F.coalesce(F.sum("count_").over(Window.partitionBy(tree).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"before_": before, "n": F.sum("count_").over(Window.partitionBy(tree))})
    return at.join(per, [tree, "part_"]).withColumn("pos", F.col("before_") + F.col("row_") - F.col("first_")).drop("part_", "row_", "first_", "count_", "before_")


@dataclass
class Levels:
    """Level by level the runs (tree, pos, n, children, hash): `children` are a run's nodes in order, n their tree's number of them.

    `leaves` are the nodes (tree, pos, n, hash, more) that the runs of the first level hold, `roots` are (tree, hash).
    """

    leaves: DataFrame
    runs: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def build(leaves: DataFrame, fanout: int = FANOUT) -> Levels:
    """Join every `fanout` consecutive nodes of a tree into one, while any tree has several: log(n) levels, each written.

    leaves: (tree, pos, n, hash) and any columns that stay with a leaf. A tree of one leaf is its own root. No leaves: no levels.
    """
    out, nodes = Levels(leaves), leaves
    widest = leaves.agg(F.max("n")).first()[0] or 0
    roots = leaves.where("n = 1").select("tree", "hash")
    while widest > 1:
        child = F.struct("pos", "hash", *[c for c in nodes.columns if c not in ("tree", "pos", "n", "hash")])
        up = F.floor(F.col("pos") / fanout).cast("long").alias("up")
        runs = nodes.where("n > 1").groupBy("tree", up, "n").agg(F.sort_array(F.collect_list(child)).alias("children"))  # `fanout` nodes at most
        runs = cut(runs.select("tree", F.col("up").alias("pos"), "n", "children", digest(joined(F.col("children"))).alias("hash")), f"merkle-{len(out.runs)}")
        out.runs.append(runs)
        nodes = runs.select("tree", "pos", F.ceil(F.col("n") / fanout).cast("long").alias("n"), "hash")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "hash"))
        widest = -(-widest // fanout)
    out.roots = roots
    return out


def proofs(levels: Levels, above: DataFrame) -> DataFrame:
    """The leaves with `path`: for each level from theirs upwards the digests on the left and on the right, in one value each.

    above: (tree, path, ...), what a tree's root inherits; other columns are handed on. From the top down, runs meet their
    parents' paths, which are an eighth as many as the paths they make.
    """
    more = [F.col(c) for c in above.columns if c not in ("tree", "path")]
    paths = None
    for i in range(len(levels.runs) - 1, -1, -1):
        runs = levels.runs[i]
        whole = runs.where(F.col("n") <= FANOUT).select("tree", "pos").join(above, "tree").select("tree", "pos", "path", *more)
        paths = whole if paths is None else paths.select("tree", "pos", "path", *more).unionByName(whole)
        met = runs.select("tree", "pos", "children").join(paths, ["tree", "pos"]).select("tree", "children", "path", *more, F.posexplode("children").alias("i_", "child_"))
        side = F.struct(joined(F.slice("children", 1, F.col("i_"))).alias("left"), joined(F.slice("children", F.col("i_") + 2, FANOUT)).alias("right"))
        paths = met.select("tree", "child_.*", F.concat(F.array(side), "path").alias("path"), *more)
    alone = levels.leaves.where("n = 1").drop("n").join(above, "tree")
    return alone if paths is None else paths.unionByName(alone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda acc, side: digest(side["left"], acc, side["right"]))


def proof(path: Column) -> Column:
    """A path's digests one after another, in hex."""
    return F.lower(F.hex(F.aggregate(path, F.lit(b""), lambda acc, side: F.concat(acc, side["left"], side["right"]))))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id") -> DataFrame:
    """(order, leaf, changed_leaf, subroot, root, path) for each row; digests are 32 bytes.

    A leaf is the digest of the row's fields. Rows of a `tree` value stand by `order` (null first), ties by leaf, so repeated rows are
    leaves of their own; the roots of the trees stand by value, null first and UTF-8 bytewise, and are joined alike. No rows give
    no rows. changed: other values of fields, whose digest is changed_leaf, to be checked against the manifest. Other columns don't count.
    """
    values = {f: F.col(f) for f in fields}
    other = row_digest(values | changed) if changed else F.lit(None).cast("binary")
    named = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-")).alias("tree")
    made = cut(docs.select(F.col(order).alias("order"), named, row_digest(values).alias("hash"), other.alias("changed_leaf")), "merkle-leaves")
    leaves = build(placed(made, "tree", [F.asc_nulls_first("order"), F.asc("hash")]))
    roots = leaves.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    top = build(placed(roots, "tree", [F.asc("of")]))
    root = top.roots.first()
    start = docs.sparkSession.createDataFrame([("", [])], f"tree string, path {SIDES}")
    above = proofs(top, start).select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot"))
    drop_cut(made)
    rows = proofs(leaves, above)
    return rows.select(F.col("order").alias(order), F.col("hash").alias("leaf"), "changed_leaf", "subroot", F.lit(bytes(root["hash"]) if root else None).cast("binary").alias("root"), "path")


def op13(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; texts of ids whose CRC-32 three divides are lower-cased after the manifest."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = manifest(docs, {"text": F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))})
    said = lambda c: F.lower(F.hex(c))
    folded = fold(F.col("changed_leaf"), F.col("path"))
    out = rows.select("doc_id", said("leaf").alias("leaf"), said("subroot").alias("subroot"), said("root").alias("root"), F.sha2(proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"), said(folded).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 7, top_levels: int = 3) -> str:
    """DuckDB SQL for trees of up to 8 ** levels rows and 8 ** top_levels trees: one table a level."""
    said = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(said(text if f == "text" else f) for f in FIELDS) + ")"
    lower = f"CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    ctes = [
        f"hashed AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS h, {leaf(f'({lower})')} AS changed FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed)",
        "a0 AS (SELECT tree, pos, n, h FROM leaves)",
    ]
    for name, count in (("a", levels), ("t", top_levels)):
        for k in range(count):
            ctes.append(f"{name}{k + 1} AS (SELECT tree, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // {FANOUT}, n)")
            ctes.append(f"{name}s{k} AS (SELECT x.tree, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.pos // {FANOUT} = y.pos // {FANOUT} WHERE x.n > 1 GROUP BY x.tree, x.pos)")
        if name == "a":
            ctes.append("subroots AS (" + " UNION ALL ".join(f"SELECT tree, h FROM a{k} WHERE n = 1" for k in range(levels + 1)) + ")")
            ctes.append("t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h, tree AS of FROM subroots)")
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM t{k} WHERE n = 1" for k in range(top_levels + 1)) + ")")
    ctes.append("f0 AS (SELECT l.doc_id, l.tree, l.pos, l.h AS leaf, l.changed AS folded, '' AS proof, t0.h AS subroot, t0.pos AS tpos FROM leaves l JOIN t0 ON l.tree = t0.of)")
    steps = [("a", k) for k in range(levels)] + [("t", k) for k in range(top_levels)]
    for i, (name, k) in enumerate(steps):
        on = f"s.tree = f.tree AND s.pos = f.pos // {FANOUT**k}" if name == "a" else f"s.pos = f.tpos // {FANOUT**k}"
        ctes.append(f"f{i + 1} AS (SELECT f.doc_id, f.tree, f.pos, f.leaf, f.subroot, f.tpos, CASE WHEN s.l IS NULL THEN f.folded ELSE sha256(s.l || f.folded || s.r) END AS folded, f.proof || coalesce(s.l || s.r, '') AS proof FROM f{i} f LEFT JOIN {name}s{k} s ON {on})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{len(steps)}, root"
