"""Fingerprints, meetings and components against brute force."""

import re

import numpy as np
import xxhash
from helpers import TEXTS, docs_of, empty

from quillstone.llm import components, simhash


def brute_fingerprint(text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark):
    base = [" ".join(f"W{(i * 7 + j * j) % 97}" for j in range(120)) for i in range(6)]
    texts = TEXTS + base + [b + " extra" for b in base] + [b.replace("W3 ", "Q3 ", 1) for b in base] + base[:2]
    fps = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: r for r in simhash.op7(docs_of(spark, texts)).where("doc_id is not null").collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    kept = simhash.keep_one(docs_of(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label))  # the row without an id has a null text, like an empty one of an id
    assert simhash.op7(empty(spark)).count() == 0


def test_meetings_find_every_pair(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    near = {centre}
    for k in (1, 2, 3, 4):
        for _ in range(15):
            f = centre
            for b in rng.choice(64, k, replace=False):
                f ^= 1 << int(b)
            near.add(f)
    fps = [simhash.signed(f) for f in near] + [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 200)]
    for radius in (1, 2, 3):
        want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
        df = spark.createDataFrame([(f,) for f in fps], "fp long")
        rows = simhash.variants(df, radius).orderBy("variant").toPandas()
        met = [(int(a), int(b)) for x in simhash.colliding(rows.variant.to_numpy(), rows.fp.to_numpy(), radius) for a, b in zip(*x, strict=True)]
        assert {(min(p), max(p)) for p in met} == want
        a, b = (np.array(x) for x in zip(*want, strict=True))
        got = simhash.links(df, radius).toPandas()
        merge = lambda a, b: sorted(zip(*components.star_forest(np.array(a), np.array(b)), strict=True))
        assert merge(got.a, got.b) == merge(a, b) and len(got) <= len(fps) * 4
    assert simhash.fingerprint("A b C") == brute_fingerprint("a B c")


def test_one_row_of_each_group_stays_whatever_ids_and_partitions(spark):
    """Ids on several texts, null ids, repeated rows, near copies: rows are judged by their own groups."""
    rng = np.random.default_rng(4)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(8)]
    near = [p + " tail" for p in prose]
    rows = [(5, prose[0]), (5, prose[1]), (3, prose[1]), (7, prose[2]), (None, prose[3]), (None, prose[3]), (None, prose[4]), (9, prose[4]), (5, near[0]), (1, near[2])]
    rows += [(11, prose[5]), (11, prose[5]), (11, prose[6]), (None, None), (12, ""), (None, near[7]), (None, prose[7])]
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for k, (i, _) in zip(label, rows, strict=True):
        least[k] = min(least.get(k, (2, 0)), (i is None, i or 0))
    results = []
    for parts in (1, 2, 3, 11):
        docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, hash_ string, fp int").repartition(parts)
        out = simhash.keep_one(docs)
        assert out.columns == docs.columns
        results.append(sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()))
        at = {(str(i), str(t)): k for (i, t), k in zip(rows, label, strict=True)}
        assert sorted(at[r] for r in results[-1]) == sorted(set(label))
        assert all(r[0] == (str(least[at[r]][1]) if not least[at[r]][0] else "None") for r in results[-1])
    assert all(r == results[0] for r in results)
