"""The trie's nodes against plain dictionaries of prefixes."""

import hashlib
import random
import re
import zlib

from quillstone.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth int, owner string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            content = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, content, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in own.items()}
    full = {}
    for c, said in own.items():
        h, stem = zlib.crc32(str(c).encode()) % 4, c - c % 20
        full[c] = tuple(own.get(stem, [])[:h] + said[h:])
    members = {}
    for c, said in full.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    out = {}
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        ends = ",".join(map(str, sorted(c for c in cs if full[c] == p)))
        out[min(cs), len(p)] = (
            min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in under), len(leaf), sum((len(members[q]) - 1) * words[q] for q in under),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS).repartition(parts)
    out = prefix_trie.op11(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = out.collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    return {(r[0], r[1]): tuple(r[2:]) for r in got}


def made(seed):
    """Conversations that copy each other's beginnings, with ties, nulls, absent stems, repeats and a long one."""
    rng, rows, said = random.Random(seed), [], {}
    for c in rng.sample(range(0, 400), 60):
        n = rng.choice((0, 1, 2, 3, 5, 9))
        own = [(rng.choice(("user", None, "")), rng.choice(("hi there", "", None, f"words {rng.randrange(5)} of it", "ü x\ty"))) for _ in range(n)]
        if said and rng.random() < 0.7:
            source = rng.choice(list(said.values()))
            cut = rng.randrange(len(source) + 1)
            own = source[:cut] + (own if rng.random() < 0.6 else [])
        said[c] = own
        rows += [(c, t if rng.random() < 0.9 else None, role, text) for t, (role, text) in enumerate(own)]
    return rows + rows[:4] + [(None, 1, "user", "no conversation"), (7, None, None, None)]


def test_trie_against_brute_force(spark):
    for seed, parts in ((1, 1), (2, 7)):
        rows = made(seed)
        assert found(spark, rows, parts) == brute(rows)


def test_copies_one_owner_and_chains_of_chains(spark):
    same = [(c, t, "user", f"turn {t} of all") for c in range(0, 200, 20) for t in range(6)]  # stems keep their own turns
    nested = [(1000 + 20 * i, t, "user", f"step {t}" if t <= 9 - i else f"end of {i} at {t}") for i in range(10) for t in range(12)]
    long = [(2000, t, "a", "w " * (t % 3)) for t in range(700)] + [(2020, t, "a", "w " * (t % 3) if t < 650 else "z") for t in range(700)]
    rows = same + nested + long
    assert found(spark, rows) == brute(rows)


def test_long_conversations_are_many_windows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = made(3)
    assert found(spark, rows) == brute(rows)


def test_one_conversation_and_none(spark):
    assert found(spark, [(40, 0, "user", "hello world")]) == brute([(40, 0, "user", "hello world")])
    assert found(spark, [(3, 0, "u", "a b")]) == brute([(3, 0, "u", "a b")])
    assert prefix_trie.op11(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.op11(spark.createDataFrame([(None, 1, "u", "x", 1, "y")], TURNS)).count() == 0
    huge = "word " * 300_000
    assert found(spark, [(40, 0, "u", huge), (60, 0, "u", huge)])[40, 0][4] == 300_000
