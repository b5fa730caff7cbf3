"""Manifest and proofs against a recursion in plain Python."""

import hashlib
import random
import zlib

import pytest
from helpers import DOC, FOLDER, TEXTS, docs_of, empty, needs_tables
from pyspark.sql import functions as F

from quillstone.llm import merkle

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, siblings of each node as (left, right) by level)."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
    root, above = tree([sha("".join(r)) for r in runs])
    return root, [[("".join(r[:i]), "".join(r[i + 1 :])), *above[k]] for k, r in enumerate(runs) for i in range(len(r))]


def brute(rows):
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        lower = text.translate({c: c + 32 for c in range(65, 91)}) if text is not None else None
        mine = leaf(doc_id, source, lang, n_chars, text)
        changed = leaf(doc_id, source, lang, n_chars, lower) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else mine
        by.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), mine, changed))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[1] for x in sorted(by[k])]) for k in langs}
    root, top = tree([trees[k][0] for k in langs])
    out = []
    for i, k in enumerate(langs):
        for ((known, doc_id), mine, changed), path in zip(sorted(by[k]), trees[k][1], strict=True):
            path = path + top[i]
            folded = changed
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((doc_id if known else None, mine, trees[k][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], DOC).repartition(parts)
    out = merkle.op13(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in out.collect()]
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize(("n", "langs", "parts"), [(700, 3, 7), (65, 1, 1), (90, 80, 4), (64, 1, 5)])
def test_manifest_against_recursion(spark, n, langs, parts):
    rng = random.Random(n)
    name = lambda: rng.choice([None, "", "é"] + [f"l{i}" for i in range(langs)]) if langs > 1 else "en"
    rows = [(rng.randrange(n), rng.choice([None, "", "Aa Bb", "all small", f"É X {i}"]), name(), rng.choice([None, "s"]), rng.choice([None, -3, 10**12])) for i in range(n)]
    rows += rows[:9] + [(None, "NULL id", "l0", None, None)] * 3
    got = check(spark, rows, parts)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_edge_tables(spark):
    check(spark, [(3, "Lone", None, "s", 4)])
    check(spark, [(i, t, "en", "s", i) for i, t in enumerate([*TEXTS, "X" * 2_000_000])])
    assert merkle.op13(empty(spark)).count() == 0
    rows = merkle.op13(docs_of(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS) + 2 and len({r["root"] for r in rows}) == 1


def test_hot_tree_and_rows_dealt_otherwise(spark):
    """One tree holds all but a few rows; the manifest doesn't depend on partitions."""
    rows = [(i * 7 % 1009, f"Text {i % 5}", "en" if i % 50 else "fr", "s", i % 3) for i in range(1500)]
    one = {r["root"] for parts in (1, 4, 13) for r in merkle.op13(spark.createDataFrame([(*r, 1, "s") for r in rows], DOC).repartition(parts)).select("root").distinct().collect()}
    assert len(one) == 1 and one == {brute(rows)[0][3]}


def test_other_fields_and_a_forged_proof(spark):
    df = spark.createDataFrame([(f"k{i}", i, "A") for i in range(20)], "name string, v int, part string")
    rows = merkle.manifest(df, fields=("name", "v"), tree="part", order="name")
    forged = rows.withColumn("path", F.transform("path", lambda s: F.struct(s["right"].alias("left"), s["left"].alias("right"))))
    good = lambda d: d.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count()
    assert good(rows) == 20 and good(forged) == 0


@needs_tables
def test_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = duckdb.sql(merkle.oracle_sql()).fetchall()
    got = merkle.op13(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
