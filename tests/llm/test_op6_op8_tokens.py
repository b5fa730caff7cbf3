"""Token ids against the tokenizers library, sections and packing against brute force."""

import zlib

import numpy as np
import pytest
from helpers import TEXTS, docs_of, empty
from pyspark.sql import functions as F

from quillstone.llm import packing, token_counts, tokens


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = ["", None, " a b", "a  b", "end ", "x\n\ny z", "a  b", "tab\t x", "é ü ", "don't we'll  stop", "a" * 5000, "　 wide", *TEXTS]


def test_encoder_equals_tokenizers():
    import pyarrow as pa

    ids, at = tokens.Encoder().encode_batch(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == reference_ids(ODD)


def test_encoder_takes_runs_of_any_length():
    """Two million spaces, line feeds and letters, alone, at the start, in the middle and at the end, and runs near the length at which they are cut."""
    import pyarrow as pa

    n = 2_000_000
    runs = [" " * n, "\n" * n, "a" * n, " \n\t" * (n // 3)]
    texts = [*runs, *[f"{r}x y" for r in runs[:2]], *[f"x{r}" for r in runs[:2]], *[f"a b{r}c d" for r in runs], f"{runs[0]}<|endoftext|>{runs[1]} q"]
    rng = np.random.default_rng(1)
    parts = [lambda: " " * int(rng.integers(990, 1100)), lambda: "\n" * int(rng.integers(1, 1300)), lambda: "ab", lambda: "'s", lambda: "é", lambda: "1", lambda: "\t ", lambda: "\u3000" * 1000, lambda: "\x1c" * 1000, lambda: "<|endoftext|>"]
    texts += ["".join(parts[i]() for i in rng.integers(0, len(parts), 10)) for _ in range(40)]
    encoder = tokens.Encoder()
    for some in (texts[:13], texts[13:], texts[13:20]):
        ids, at = encoder.encode_batch(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == reference_ids(some)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_brute_force(spark, rule):
    """Byte by byte: which section each token's bytes are in, from the library's ids alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*TEXTS, "a\n\n\nb\nc", "\n", "x\n" * 50, "é\nü\n\n🙂\n \n  y", "w " * 2000 + "\n" + " " * 1500 + "\n\nend"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = tokens.Encoder().byte_lengths
    rows = token_counts.section_tokens(docs_of(spark, texts), rule=rule).where("doc_id > 0").toPandas()
    for i, text in enumerate(texts):
        if not i:
            continue
        lines = [line + "\n" for line in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        lines = lines[: max(1, len(lines) - (lines[-1] == ""))]
        of_byte = [k for k, line in enumerate(lines) for _ in line.encode()]
        want, crossing, at = [0] * len(lines), [0] * len(lines), 0
        for token in t.encode(text, add_special_tokens=False).ids:
            own = of_byte[at : at + int(sizes[token])]
            at += int(sizes[token])
            most = max(sorted(set(own)), key=own.count)
            want[{"first": own[0], "last": own[-1], "most": most}[rule]] += 1
            crossing[own[0]] += own[0] != own[-1]
        g = rows[rows.doc_id == i].sort_values("section")
        ends = np.cumsum([len(line) for line in lines]).tolist()
        assert g.tokens.tolist() == want and g.crossing.tolist() == crossing and g.end.tolist() == ends and g.start.tolist() == [0, *ends[:-1]]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_add_up(spark, rule):
    df = docs_of(spark, TEXTS)
    rows = token_counts.section_tokens(df, rule=rule).where("doc_id is not null").toPandas()
    for i, ids in enumerate(reference_ids(TEXTS)):
        g = rows[rows.doc_id == i]
        times = 2 if i == 0 else 1
        assert g.tokens.sum() == times * len(ids) and g.end.max() == len(TEXTS[i]) and g.start.min() == 0
    assert token_counts.op6(empty(spark)).count() == 0


def test_attribution_rules():
    starts, ends = np.array([0, 4]), np.array([3, 8])  # the second token has one byte in section 0 and four in section 1
    assert token_counts.attribute(starts, ends, "first").tolist() == [2, 0]
    assert token_counts.attribute(starts, ends, "last").tolist() == [1, 1] and token_counts.attribute(starts, ends, "most").tolist() == [1, 1]


def test_packing_is_gapless_and_complete(spark):
    texts = [*TEXTS, *["w " * n for n in range(1, 600, 7)], "long " * 5000]
    df = docs_of(spark, texts)
    out = packing.pack_documents(df).toPandas()
    want = {i: [*ids, 0] for i, ids in enumerate(reference_ids(texts))}
    for i, ids in want.items():
        for _, g in out[out.doc_id == i].groupby("position"):
            g = g.sort_values("start")
            assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == ids and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
    digests = packing.op8(df).toPandas()
    key = ["position", "start"]
    assert digests.sort_values(key).ids_crc32.tolist() == [zlib.crc32(b) for b in out.sort_values(key).ids]
    for i, ids in want.items():
        g = out[out.doc_id == i]
        assert g.length.sum() == len(ids) * (2 if i == 0 else 1) and (g.doc_tokens == len(ids)).all()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.WINDOW
    assert packing.op8(df).select(F.sum("ids_crc32")).first()[0] == sum(zlib.crc32(b) for b in out.ids)
    whole = packing.sequences(packing.pack_documents(df)).toPandas()
    assert (whole.ids.map(len) == 4 * whole.padded).all() and whole.used.sum() == out.length.sum()
    assert packing.op8(empty(spark)).count() == 0


def test_rests_take_slots_in_order():
    rng = np.random.default_rng(8)
    for n in (1, 2, 700):
        length, position = rng.integers(1, packing.WINDOW, n), rng.permutation(10 * n)[:n]
        sequence, offset = packing.pack_rests(length, position)
        for s in np.unique(sequence):
            at = np.flatnonzero(sequence == s)
            at = at[np.argsort(position[at])]
            assert offset[at].tolist() == [0, *np.cumsum(length[at])[:-1]] and length[at].sum() <= packing.WINDOW and s == position[at[0]] * packing.SPREAD + packing.SPREAD - 1
        assert len(np.unique(sequence)) <= length.sum() / packing.WINDOW * 1.05 + 2


def test_nnls_is_optimal():
    rng = np.random.default_rng(3)
    a, b = rng.random((20, 40)), rng.random(20) * 5
    x = packing.nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g > -1e-6).all() and abs(g[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_uses_every_piece():
    counts = np.random.default_rng(4).integers(0, 500, 128)
    used = np.zeros(128, int)
    for uses, times in packing.plan(counts):
        assert sum(u * n for u, n in uses.items()) <= 128 and times > 0
        for u, n in uses.items():
            used[u - 1] += n * times
    assert (used == counts).all()
