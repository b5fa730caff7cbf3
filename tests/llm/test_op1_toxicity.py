"""The grammar against brute force, held-out accuracy, and independence of partitions."""

import zlib

import numpy as np
import pytest
from helpers import docs_of, empty, needs_tables

from quillstone.llm import toxicity


def brute_clause(s, words):
    """Every rule of the grammar read off the words, without an automaton."""
    kinds, i = [], 0
    ends = {}
    for p, k in toxicity.PHRASES.items():
        p = p.split()
        for at in range(len(words) - len(p) + 1):
            if words[at : at + len(p)] == p:
                ends[at + len(p) - 1] = k
    base = []
    for i, w in enumerate(words):
        kind = next((k for k, ws in (("insult", toxicity.INSULTS), ("harm", toxicity.HARMS)) for x in ws if w.startswith(x)), None) or toxicity.kinds_of_words().get(w, "other")
        kinds.append((ends[i], toxicity.PHRASE) if i in ends else (kind, toxicity.SEED if kind in ("insult", "harm") else 1.0))
    base = [k for k, _ in kinds]
    before = lambda i, k, n: k in base[max(0, i - n) : i]
    total, quoted, said = 0.0, False, False
    for i, (k, w) in enumerate(kinds):
        if k == "quote":
            quoted, said = not quoted, False
        said = (said or k == "report") and not quoted
        if k not in ("insult", "threat", "harm"):
            continue
        w *= toxicity.INTENSIFIED if k == "insult" and before(i, "intensifier", toxicity.INTENSIFIER_SPAN) else 1
        w *= (toxicity.INTENDED if before(i, "intention", toxicity.INTENTION_SPAN) else toxicity.UNINTENDED) if k == "harm" else 1
        w *= toxicity.NEGATED if before(i, "negation", toxicity.NEGATION_SPAN) else 1
        w *= toxicity.REPORTED if quoted or said else 1
        w *= toxicity.AIMED if "target" in base[max(0, i - toxicity.TARGET_SPAN) : i + toxicity.TARGET_SPAN + 1] else 1
        total += w
    return total


def test_grammar_against_brute_force():
    s = toxicity.Scorer({w: (k, toxicity.SEED) for k, ws in (("insult", toxicity.INSULTS), ("harm", toxicity.HARMS)) for w in ws})
    rng = np.random.default_rng(6)
    words = ["idiots", "stupid", "kill", "hurting", "you", "they", "not", "never", "said", '"', "will", "such", "word", "thing", "a", "piece", "of", "shit", "crap", "burn", "in", "hell", "go", "to", "drop", "dead"]
    for _ in range(4000):
        clause = [words[i] for i in rng.integers(0, len(words), rng.integers(1, 14))]
        assert s.clause(clause) == pytest.approx(brute_clause(s, clause)), clause
    assert s.features("nothing here") is None and s.features("") is None
    one = lambda t: s.clause(toxicity._WORD.findall(t.lower()))
    assert one("you are a total idiot") > one("an idiot spoke") > one("somebody said idiot") > one("he is not an idiot he") > 0
    assert one("I will kill you") > 4 * one("I kill time") > 0


def test_toxicity_does_not_depend_on_partitions(spark):
    """Near copies with different words: whichever copy stood for the others changed what was learned."""
    rng = np.random.default_rng(9)
    filler = [f"w{i:03d}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        base = " ".join(filler[j] for j in np.random.default_rng(i // 4).integers(0, 300, 30))
        toxic = (i // 4) % 3 == 0
        rows.append((i, f"{base} {'zorgling you. grumbit will smash you' if toxic else 'calm words'} {filler[rng.integers(300)]}"))
        labels.append((i, 0, int(toxic)))
    docs, said = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    score = lambda n: {r["doc_id"]: r["score"] for r in toxicity.op1(docs.repartition(n), said).collect()}
    assert score(3) == score(11)
    model = toxicity.fit(docs, said)
    assert any("zorgling".startswith(x) and k == "insult" for x, (k, _) in model.stems.items()) and ("smash", "harm") in {(x, k) for x, (k, _) in model.stems.items()} | {("smash", k) for x, (k, _) in model.stems.items() if "smash".startswith(x)}


@needs_tables
def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op1(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.predicted == 1) == (out.toxic == 1)).mean() > 0.97
    assert out.score[out.toxic == 1].mean() > 0.7 and out.score[out.toxic == 0].mean() < 0.1


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.op1(docs_of(spark, ["you idiot, you moron, pathetic scum", "fine words", None]), labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = {r["doc_id"]: r["held_out"] for r in out}
    assert held[0] == (zlib.crc32(b"0") % 5 == 0) and held[1] == (zlib.crc32(b"1") % 5 == 0) and held[None] is False
    assert toxicity.op1(empty(spark), labels).count() == 0
    kept = toxicity.drop_toxic(docs_of(spark, ["you idiot, you moron, pathetic scum", "fine words"]), labels.limit(0))
    assert kept.columns == empty(spark).columns and {r["doc_id"] for r in kept.collect()} == {1, None}


def test_training_rows_are_bounded_where_an_id_stands_on_many_rows(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"again {k}") for k in range(500)] + [(ids[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 1)], "doc_id long, toxic int")
    got = [toxicity.training_rows(docs.repartition(k), labels, 10).collect() for k in (1, 5)]
    assert len(got[0]) == 10 and sorted(got[0]) == sorted(got[1])
    every = toxicity.training_rows(docs, labels).collect()
    assert len(every) == len(ids) and (ids[0], 1) in {(ids[0], r["toxic"]) for r in every if r["text"] == f"text {ids[0]}" or r["text"].startswith("again")}
