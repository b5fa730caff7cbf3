"""Conversation prefix tries: which conversations begin alike, and what encoding each shared beginning once would save.

Each prefix of a conversation has a digest, and the smallest conversation with that digest owns the prefix. A conversation owns
all of its prefixes from some depth on, which a binary search finds by joins against the digests' minima, for all
conversations at once. What a conversation owns is a chain of nodes; chains hang at nodes of other chains and are summed bottom-up.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import crc32_sql, cut, drop_cut, remove, shared_dir
from quillstone.llm.mixing import word_count

#: Conversations of one stem share its beginning: that of the conversation whose number is the last multiple of STEM, up to HEADS - 1 turns.
STEM, HEADS = 20, 4
#: Positions that one window adds up; a longer conversation is many windows.
BLOCK = 4096


def running_sums(df: DataFrame, key: str, block: Column, order: list[Column], values: list[str]) -> DataFrame:
    """df with every column of `values` replaced by its sum up to and including the row, within the key, by (block, *order).

    A key may hold any share of all rows: sums by (key, block) are aggregated before they are shuffled, and a window holds
    one block of one key. `block` must not be null and must be a prefix of the order; rows that tie are added in any order.
    """
    rows = df.withColumn("block_", block)
    sums = rows.groupBy(key, "block_").agg(*[F.sum(v).alias(f"{v}_") for v in values])
    w = Window.partitionBy(key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    side = sums.select(key, "block_", *[F.coalesce(F.sum(f"{v}_").over(w), F.lit(0)).alias(f"{v}_") for v in values])
    local = Window.partitionBy(key, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(side, [key, "block_"]).withColumns({v: F.col(f"{v}_") + F.sum(v).over(local) for v in values}).drop("block_", *[f"{v}_" for v in values])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, content, words): a conversation's turns from 0 by `turn`, null first; texts are replaced by a digest and their number of words.

    Turns with the same number are ordered by their digest, and repeated rows are turns of their own. A null role or text
    is the empty one. Rows without conv_id belong to no conversation and go.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = F.sha2(F.concat(F.octet_length(said("role")).cast("string"), F.lit(":"), said("role"), said("text")).cast("binary"), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), content.alias("content"), word_count(F.col("text")).alias("words"), F.lit(1).cast("long").alias("i")
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long")
    return running_sums(rows, "conv", block, [F.asc_nulls_first("turn"), F.asc("content")], ["i"]).withColumn("i", F.col("i") - 1).drop("turn")


def rebuilt(said: DataFrame, stem: int = STEM, heads: int = HEADS) -> DataFrame:
    """(conv, depth, content, words): the turns of each rebuilt conversation, from depth 1, and a row of depth 0 for each conversation.

    With h the CRC-32 of the decimal number modulo `heads`: the first h turns of the conversation conv - conv % stem (all
    if fewer, none if it is absent), then the conversation's own turns after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    ids = said.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % stem).alias("stem_"), h.alias("h"))
    first = said.where(F.col("i") < heads - 1).select(F.col("conv").alias("stem_"), "i", "content", "words")
    head = ids.join(first, "stem_").where("i < h").select("conv", (F.col("i") + 1).alias("depth"), "content", "words")
    stems = first.groupBy("stem_").agg(F.count("*").alias("n_"))
    own = said.where(F.col("i") >= h).withColumn("stem_", F.col("conv") - F.col("conv") % stem).join(stems, "stem_", "left")
    own = own.select("conv", (F.least(h, F.coalesce("n_", F.lit(0))) + F.col("i") - h + 1).alias("depth"), "content", "words")
    top = ids.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("words"))
    return head.unionByName(own).unionByName(top)


def prefixes(turns_: DataFrame) -> DataFrame:
    """(conv, depth, digest, words, total): the digest of each prefix, the words of its last turn and of all its turns.

    Turns are hashed with their depth, and a prefix's digest is that of the sums of its turns' hashes: such sums can be
    made block by block, so no conversation has to be read in one task.
    """
    turn = F.sha2(F.concat_ws(":", F.col("depth"), F.col("content")).cast("binary"), 256)
    lane = lambda at: F.when(F.col("depth") > 0, F.conv(F.substring(turn, at, 16), 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    rows = turns_.select("conv", "depth", "words", F.col("words").alias("total"), lane(1).alias("a"), lane(17).alias("b"))
    rows = running_sums(rows, "conv", F.floor(F.col("depth") / BLOCK).cast("long"), [F.asc("depth")], ["total", "a", "b"])
    digest = F.unhex(F.md5(F.concat_ws(":", F.col("depth"), F.col("a"), F.col("b")).cast("binary")))
    return rows.select("conv", "depth", digest.alias("digest"), "words", F.col("total").cast("long").alias("total"))


class _Bucketed:
    """A table in the shared folder, bucketed by keys, so that joins on them move the other side alone. Used with `with`."""

    def __init__(self, df: DataFrame, *keys: str):
        self.spark, self.name = df.sparkSession, f"trie_{uuid.uuid4().hex}"
        self.path, buckets = f"{shared_dir(self.spark)}/{self.name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path).saveAsTable(self.name)

    def __enter__(self) -> DataFrame:
        return self.spark.table(self.name)

    def __exit__(self, *_):
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def owned_depths(known: DataFrame, least: int) -> DataFrame:
    """(conv, len, first, owner): the depth from which a conversation owns its prefixes (len + 1: none), and the owner of the one before.

    known: (conv, depth, digest) bucketed by (conv, depth), least: the smallest conversation, which owns all of its prefixes
    (first 0, no owner). Minima are kept for digests that stand twice; a prefix without one is owned. In each round every conversation that is
    still open asks for one depth: its digest comes from `known`, which isn't moved, and the minimum by a join that a hot digest
    doesn't hold up, as AQE can split that side.
    """
    minima = cut(known.where("depth > 0").groupBy("depth", "digest").agg(F.min("conv").alias("least"), F.count("*").alias("n")).where("n > 1").select("depth", "digest", "least"), "minima")
    start = known.groupBy("conv").agg(F.max("depth").alias("len"))
    state = start.select("conv", "len", F.lit(0).cast("long").alias("low"), F.lit(least).cast("long").alias("owner"), (F.col("len") + 1).alias("high"))
    state = cut(state.where(F.col("conv") != least), "trie-state")
    widest = state.agg(F.max("high")).first()[0] or 0  # a round halves what is open
    while widest > 1:
        widest = (widest + 1) // 2
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
        asked = state.where("high - low > 1").withColumn("depth", mid).join(known.select("conv", "depth", "digest"), ["conv", "depth"])
        met = asked.join(minima, ["depth", "digest"], "left").withColumn("own", F.coalesce(F.col("least") == F.col("conv"), F.lit(True)))
        low, owner, high = F.when(F.col("own"), F.col("low")).otherwise(F.col("depth")), F.when(F.col("own"), F.col("owner")).otherwise(F.col("least")), F.when(F.col("own"), F.col("depth")).otherwise(F.col("high"))
        old, state = state, cut(met.select("conv", "len", low.alias("low"), owner.alias("owner"), high.alias("high")).unionByName(state.where("high - low <= 1")), "trie-state")
        drop_cut(old)
    drop_cut(minima)
    found = state.select("conv", "len", F.col("high").alias("first"), "owner")
    return found.unionByName(start.where(F.col("conv") == least).select("conv", "len", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("owner")))


def chain_totals(chains: DataFrame, values: list[str]) -> DataFrame:
    """(conv, values): each chain's own values plus those of all chains below it.

    chains: (conv, parent, values). In round k a chain's sums reach the ancestor 2^k above it, so a tree of height h takes
    log2(h) rounds; sums are aggregated before they are shuffled, whatever hangs at one chain.
    """
    up, sums = cut(chains.select("conv", F.col("parent").alias("above")), "chains-up"), cut(chains.select("conv", *values), "chains-sums")
    while up.where("above is not null").limit(1).count():
        risen = up.where("above is not null").join(sums, "conv").groupBy(F.col("above").alias("conv")).agg(*[F.sum(v).alias(f"{v}_") for v in values])
        summed = sums.join(risen, "conv", "left").select("conv", *[(F.col(v) + F.coalesce(f"{v}_", F.lit(0))).cast("long").alias(v) for v in values])
        higher = up.join(up.select(F.col("conv").alias("above"), F.col("above").alias("above_")), "above", "left").select("conv", F.col("above_").alias("above"))
        olds, sums, up = (up, sums), cut(summed, "chains-sums"), cut(higher, "chains-up")
        for old in olds:
            drop_cut(old)
    drop_cut(up)
    return sums


def ends_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined.

    This hash is sequential by its definition: ids of one node are streamed in order through one task that holds the hash's state alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for k, ids in pdf.groupby(["owner", "depth"], sort=False)["conv"]:
                said = ",".join(map(str, ids.tolist())).encode()
                if k == key:
                    state.update(b"," + said)
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(said)
            yield pd.DataFrame(out, columns=["owner", "depth", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["owner", "depth", "ends_sha256"])

    return ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv").mapInPandas(run, "owner long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, stem: int = STEM, heads: int = HEADS) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, from the textless root on.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table has no
    nodes. Ties of turns, repeated rows and nulls: see turns(). Columns other than conv_id, turn, role and text don't matter.
    """
    said = cut(turns(conversations), "turns")
    least = said.agg(F.min("conv")).first()[0]
    if least is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    with _Bucketed(prefixes(rebuilt(said, stem, heads)), "conv", "depth") as known:
        drop_cut(said)
        chains = cut(owned_depths(known, least), "chains")
        # Every conversation ends at one node: its own last one, or the one of the conversation whose copy it is.
        alone = F.col("first") <= F.col("len")
        ends = chains.select(F.when(alone, F.col("conv")).otherwise(F.col("owner")).alias("owner"), F.col("len").alias("depth"), "conv")
        attached = chains.where(alone & F.col("owner").isNotNull()).select("conv", F.col("owner").alias("parent"), (F.col("first") - 1).alias("depth"))
        nodes = known.join(chains.where(alone).select("conv", "len", "first", "owner"), "conv").where("depth >= first").select("conv", "depth", "words", "total", "len", "first", "owner")
        ending = ends.groupBy(F.col("owner").alias("conv"), "depth").agg(F.count("*").alias("n"))
        hanging = attached.groupBy(F.col("parent").alias("conv"), "depth").agg(F.count("*").alias("hung"))
        nodes = nodes.join(ending, ["conv", "depth"], "left").join(hanging, ["conv", "depth"], "left")
        nodes = nodes.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).withColumn("hung", F.coalesce("hung", F.lit(0)).cast("long"))
        nodes = nodes.withColumn("n_children", F.col("hung") + (F.col("depth") < F.col("len")).cast("long")).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        nodes = cut(nodes.withColumn("ended", F.col("n") * F.col("total")), "nodes")
    values = ["n", "ended", "leaves", "below"]
    nodes = nodes.withColumn("below", F.col("words"))
    own = nodes.groupBy("conv").agg(*[F.sum(v).alias(v) for v in values])
    totals = chain_totals(own.join(attached.select("conv", "parent"), "conv", "left"), values)
    hung = attached.join(totals, "conv").groupBy(F.col("parent").alias("conv"), "depth").agg(*[F.sum(v).cast("long").alias(f"{v}_hung") for v in values])
    rows = nodes.join(hung, ["conv", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"{v}_hung", F.lit(0)) for v in values}).drop(*[f"{v}_hung" for v in values])
    rows = running_sums(rows, "conv", -F.floor(F.col("depth") / BLOCK).cast("long"), [F.desc("depth")], values)
    # A node's words are counted by each end below it: the ends' totals less the totals above the node; one copy of each node's words stays.
    saved = F.col("ended") - F.col("n") * (F.col("total") - F.col("words")) - F.col("below")
    rows = rows.join(ends_digests(ends).withColumnRenamed("owner", "conv"), ["conv", "depth"], "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("first"), F.col("owner")).otherwise(F.col("conv"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"), F.col("n").cast("long").alias("n_convs"), "n_children", F.col("leaves").cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def op11(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node."""
    return trie(conversations)


ORACLE_SQL = rf"""
WITH said AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv, conv - conv % {STEM} AS stem, {crc32_sql("conv::VARCHAR")} % {HEADS} AS h FROM (SELECT DISTINCT conv FROM said)
), parts AS (
  SELECT ids.conv, 0 AS part, i, role, text FROM ids JOIN said ON said.conv = ids.stem WHERE i < h
  UNION ALL SELECT ids.conv, 1, i, role, text FROM ids JOIN said ON said.conv = ids.conv WHERE i >= h
), placed AS (
  SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY part, i) AS depth, role, text FROM parts
), rows AS (
  SELECT conv, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), ',') OVER (PARTITION BY conv ORDER BY depth)) AS prefix FROM placed
  UNION ALL SELECT conv, 0, 0, '' FROM ids
), nodes AS (
  SELECT depth, prefix, min(conv) AS conv, count(*) AS n, any_value(words) AS words FROM rows GROUP BY depth, prefix
), members AS (
  SELECT r.conv, n.depth, n.conv AS owner FROM rows r JOIN nodes n USING (depth, prefix)
), lengths AS (
  SELECT conv, max(depth) AS len FROM rows GROUP BY conv
), parents AS (
  SELECT n.conv, n.depth, n.n, n.words, m.owner AS parent FROM nodes n LEFT JOIN members m ON m.conv = n.conv AND m.depth = n.depth - 1
), children AS (
  SELECT parent AS conv, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL
), whole AS (
  SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM parents p LEFT JOIN children c USING (conv, depth)
), under AS (
  SELECT m.owner AS conv, m.depth, sum((w.n - 1) * w.words)::BIGINT AS saved, count(*) FILTER (w.n_children = 0) AS n_leaves
  FROM whole w JOIN members m ON m.conv = w.conv AND m.depth <= w.depth GROUP BY ALL
), ends AS (
  SELECT m.owner AS conv, m.depth, sha256(string_agg(m.conv::VARCHAR, ',' ORDER BY m.conv)) AS ends FROM lengths l JOIN members m ON m.conv = l.conv AND m.depth = l.len GROUP BY ALL
)
SELECT conv AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM whole JOIN under USING (conv, depth) LEFT JOIN ends USING (conv, depth)
"""
