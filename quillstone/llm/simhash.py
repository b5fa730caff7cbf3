"""SimHash near-duplicates: fingerprints that differ in few bits, found by meeting in the middle of Hamming balls.

Every fingerprint emits all words within half the radius of it, but for one block of bits at a time; words are shuffled,
and fingerprints that meet at a word are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import cut, free_name
from quillstone.llm.components import STAR, connected_components, star_forest

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints have BLOCKS blocks. Two that differ in up to RADIUS bits differ in one less at most without some block.
BLOCKS, BLOCK_BITS = 4, 16
#: Links that a task gathers before it contracts them.
MOST_LINKS = 1 << 20


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not w:
        return 0
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        hashes = [h(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    counts, total = np.zeros(64, np.int64), len(hashes)
    for at in range(0, total, 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", words: int = SHINGLE_WORDS) -> DataFrame:
    """docs without their text, with the fingerprint as a signed long (null text: as the empty text)."""
    keep = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(*keep).schema.add(out, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps)], names=[*keep, out])

    return docs.select(*keep, text).mapInArrow(run, schema)


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def variants(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(variant, fp): for each block, fp without it (its bits hold the block's number) and all words within half the radius of that."""
    if radius not in (1, 2, 3):
        raise ValueError("radius is 1, 2 or 3: without some block two fingerprints differ in two bits at most then")
    words = []
    for block in range(BLOCKS):
        own = ((1 << BLOCK_BITS) - 1) << BLOCK_BITS * block
        flips = [0] + [1 << i for i in range(64) if not own >> i & 1] * (radius > 1)
        words += [F.col("fp").bitwiseAND(F.lit(signed(~own & (1 << 64) - 1))).bitwiseXOR(F.lit(signed(block << BLOCK_BITS * block ^ x))) for x in flips]
    return fps.select(F.explode(F.array(*words)).alias("variant"), "fp")


def colliding(variant: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of fingerprints that meet at a variant and differ in 1 to `radius` bits; rows are sorted by variant."""
    first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]])) if len(variant) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(variant)))
    many = np.repeat(size > 1, size)
    after = (np.repeat(first + size, size) - np.arange(len(variant)))[many]
    fp, k = fp[many], 1
    at = np.flatnonzero(after > k)
    while len(at):
        apart = np.bitwise_count((fp[at] ^ fp[at + k]).view(np.uint64))
        hit = at[(apart > 0) & (apart <= radius)]
        yield fp[hit], fp[hit + k]
        k += 1
        at = at[after[at] > k]


def _meet(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, f, found, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for pdf in chain(batches, [None]):
            if pdf is not None:
                v, f = np.concatenate([v, pdf["variant"].to_numpy("int64")]), np.concatenate([f, pdf["fp"].to_numpy("int64")])
            done = len(v) if pdf is None else int(np.searchsorted(v, v[-1])) if len(v) else 0  # the last variant may go on
            for a, b in colliding(v[:done], f[:done], radius):
                found.append((a, b))
                size += len(a)
                if size > MOST_LINKS:
                    found = [star_forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                    size = len(found[0][0])
            v, f = v[done:], f[done:]
        if found:
            a, b = star_forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pd.DataFrame({"a": a, "b": b})

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a forest over the distinct fingerprints `fp` that connects what pairs within `radius` bits connect.

    If two words differ in up to 3 bits, some block holds one of them at least, and the rest differs in at most 2. There
    the two balls of half the radius share a word: all variants of all fingerprints are shuffled and sorted, those that meet
    at a variant are compared on all 64 bits, and a task sends on what connects its links, never its pairs. At a variant
    meet 49 * 2^16 fingerprints at most, and by chance almost none.
    """
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row becomes 196: few small partitions would be few long tasks
    met = variants(fps.repartition(tasks, F.xxhash64("fp")), radius).repartition("variant").sortWithinPartitions("variant")
    return met.mapInPandas(_meet(radius), STAR)


def _groups(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (fp, ...), one a fingerprint, with `group`: the smallest fingerprint that links reach from it."""
    member = connected_components(links(nodes.select("fp"), radius))
    return nodes.join(member, nodes.fp == member.node, "left").withColumn("group", F.coalesce("component", "fp")).drop("node", "component")


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    Rows with equal fingerprints are one node, counted and given its smallest doc_id before any pair is sought.
    Rows with a null doc_id are compared too; they don't name a component unless it has no other rows.
    No rows give no rows; repeated rows stay.
    """
    rows = cut(with_fingerprint(docs.select("doc_id", text), text), "fingerprints")
    groups = _groups(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), radius)
    smallest = groups.groupBy("group").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "group").select(F.col("fp").alias("fp_"), "component_id")
    return rows.join(named, rows.fp == named.fp_).drop("fp_")


def keep_one(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, null last, then with the smallest hash of its columns. Columns stay.

    A row is known by two hashes of all its columns, so ids may stand on several rows: each is kept or goes with its own
    group. Of rows that are equal in all columns one stays. Each group's first row is found by hashes alone; then texts are
    shuffled once, by the key of both the join and the choice.
    """
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    one, two = free_name(docs, "hash_"), free_name(docs, "other_hash_")
    keyed = docs.withColumns({one: F.xxhash64(*hashed), two: F.hash(*hashed)})
    rows = cut(with_fingerprint(keyed.select(F.col(one).alias("one"), F.col(two).alias("two"), "doc_id", F.col(text).alias("text"))), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "one", "two")
    groups = _groups(rows.groupBy("fp").agg(F.min(order).alias("first")), radius)
    first = groups.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.one").alias(one), F.col("first.two").alias(two))
    return keyed.join(first, [one, two], "left_semi").dropDuplicates([one, two]).select(*docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
