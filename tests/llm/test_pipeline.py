"""The registered queries and the pipeline."""

import math

import numpy as np
import pandas as pd
from helpers import FOLDER, needs_tables
from pyspark.sql import functions as F

from quillstone.llm import mixing, simhash


@needs_tables
def test_queries_and_oracles(spark):
    import duckdb

    from quillstone.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, run in queries.QUERIES.items():
        df = run(spark, FOLDER).toPandas()
        assert len(df) > 0, name
        if name in queries.ORACLES:
            want = con.sql(queries.ORACLES[name]).df()
            plain = lambda d: sorted(tuple("" if v is None or pd.isna(v) else str(float(v)) if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
            assert plain(df) == plain(want), name


@needs_tables
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, FOLDER)
    assert clean.columns == docs.columns
    kept = clean.join(labels.where("toxic = 0"), "doc_id").count() / docs.join(labels.where("toxic = 0"), "doc_id").count()
    assert kept > 0.97
    one = stages["simhash"](spark, docs, FOLDER)
    assert one.columns == docs.columns and one.count() == simhash.op7(docs).select("component_id").distinct().count()
    assert stages["secrets"](spark, docs, FOLDER).count() == docs.count() and stages["mixing"](spark, docs, FOLDER).columns == docs.columns
    out = corpus_pipeline.run(spark, FOLDER)
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    assert used.n.max() <= 1024 and math.isclose(out.count(), out.dropDuplicates(["sequence_id", "offset"]).count())


def test_pipeline_packs_in_the_order_of_the_curriculum(spark, tmp_path):
    """Falling, rising and flat sources: their words by quarter of the packed sequence, and each document's place in the mix."""
    import corpus_pipeline

    from quillstone.llm import packing
    from quillstone.llm.common import cut

    rng = np.random.default_rng(31)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 9999, rng.integers(5, 400))), "en", "abc"[i % 3], 1) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    mixed = cut(stages["mixing"](spark, docs, ""))
    out = stages["packing"](spark, mixed, "").toPandas().sort_values(["sequence_id", "offset"])
    first = out.groupby("sequence_id").position.min()
    assert first.is_monotonic_increasing and (out.groupby("sequence_id").position.max() - first).max() < packing.LEAST_RANGE
    order = [r["doc_id"] for r in mixing.training_order(docs).collect()]
    of_position = out.drop_duplicates("position").set_index("position").doc_id
    assert [of_position[i] for i in range(len(order))] == order
    source = out.doc_id.map(lambda i: "abc"[i % 3])
    quarter = np.minimum(3, 4 * (out.length.cumsum() - out.length) // out.length.sum())
    words = out.length.groupby([source, quarter]).sum().unstack()
    assert words.loc["a", 0] > 1.5 * words.loc["a", 3] and words.loc["b", 3] > 1.5 * words.loc["b", 0] and 0.6 < words.loc["c", 0] / words.loc["c", 3] < 1.6


def one_row_of_each_group(rows):
    """What one row of each group of near-duplicates leaves, by all pairs of fingerprints."""
    fps = [simhash.fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= simhash.RADIUS:
                    label[i] = label[j] = min(label[i], label[j])
    best = {}
    for k, r in zip(label, rows, strict=True):
        best[k] = min(best.get(k, ((2,), None)), ((r[0] is None, r[0] or 0), r[1]))
    return sorted((str(None if named[0] else named[1]), text) for named, text in best.values())


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Few documents through every stage: which stay, what they hold, how often they are taken, and every id of every piece."""
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    secret = "password = Zx9Qw8Er7Ty6"
    texts = [" ".join(f"word{i}_{j}" for j in range(40)) for i in range(6)]
    texts += [texts[0], "you idiot, you pathetic moron and worthless scum. you are a stupid loser", f"{texts[1]} {secret}", ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    # Ids on several rows, and rows without one: each is judged with its own text.
    other = [" ".join(f"other{i}_{j}" for j in range(30)) for i in range(3)]
    rows += [(5, other[0], "en", "b", 1), (0, other[0], "en", "b", 1), (4, texts[3], "en", "a", 1), (None, other[1], "en", "a", 1), (None, other[1], "en", "a", 1), (9, "", "en", "b", 0)]
    kept_twice = one_row_of_each_group(rows)
    stage = corpus_pipeline.STAGES[1][1]
    frame = lambda k: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(k)
    for k in (1, 3, 11):
        got = sorted((str(r["doc_id"]), r["text"]) for r in stage(spark, frame(k), "").collect())
        assert got == kept_twice
    rows = rows[: len(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = {i: t for i, t in enumerate(texts) if i not in (6, 7)}
    kept[8] = texts[8].replace("Zx9Qw8Er7Ty6", "[ASSIGN REMOVED]")
    sizes = {i: len(t.split()) for i, t in kept.items()}
    mix = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in kept.items()], "doc_id long, text string, source string")).collect()}
    times = {i: int((mix[i] + sizes[i] / 2) // sizes[i]) for i in kept if mix[i]}
    assert out.groupby("doc_id").position.nunique().to_dict() == {i: n for i, n in times.items() if n}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out.itertuples():
        ids = [*t.encode(kept[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
