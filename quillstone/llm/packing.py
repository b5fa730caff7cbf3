"""Packing tokenised documents into fixed windows by non-negative least squares over length combinations.

Documents are cut into whole windows and a rest. Whole windows are sequences as they stand. The rests are packed range by range of
positions, so that sequences keep the documents' order: lengths, rounded up to units, make a small histogram; shallow
combinations of lengths that fill a window exactly are enumerated, and how often each is used is solved against the histogram
by non-negative least squares and rounded down; what is left over is packed greedily, still on the histogram. Pieces
then take the slots of their length by rank. A document has one rest at most, so a range is bounded by its number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import cut, file_ranks
from quillstone.llm.tokens import Encoder, chunks

WINDOW, UNITS, DEPTH, END_ID = 1024, 128, 3, 0
#: Documents of a range whose rests are packed together: a 64th of all, but within these bounds.
RANGES, LEAST_RANGE, MOST_RANGE = 64, 512, 16384
#: Sequence ids that belong to one position: its whole windows come first, the last is that of the sequence whose first rest is its.
SPREAD = 1 << 24

PIECE_FIELDS = "start long, length long, doc_tokens long, ids binary"


def tokenize_pieces(docs: DataFrame, window: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, start, length, doc_tokens, ids: each document's token ids, then id 0, cut every `window` ids.

    ids is binary: little-endian unsigned 32-bit. A null text is empty; an empty text is one piece with id 0 alone.
    Whole texts are encoded, a bounded number of bytes at a time.
    """
    keep = tuple(c for c in keep if c not in ("start", "length", "doc_tokens", "ids"))
    schema = docs.select(*keep).schema
    for f in ("start", "length", "doc_tokens"):
        schema = schema.add(f, "long", False)
    schema = schema.add("ids", "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for whole in batches:
            for batch in chunks(whole, text):
                ids, bounds = encoder.encode_batch(batch.column(text))
                sizes = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], END_ID).astype("<u4")
                ends = np.cumsum(sizes)
                pieces = -(-sizes // window)
                row = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, sizes[row] - start)
                cuts = np.concatenate([[0], np.cumsum(length)]) * 4
                assert not len(ends) or cuts[-1] == ends[-1] * 4
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                kept = [batch.column(c).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(start), pa.array(length), pa.array(sizes[row]), binary], names=[*keep, "start", "length", "doc_tokens", "ids"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by the active-set method of Lawson and Hanson on the normal equations."""
    gram, at_b, n = a.T @ a, a.T @ b, a.shape[1]
    gram[np.diag_indices(n)] += 1e-9  # combinations may depend on each other
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(at_b).max(initial=0))
    for _ in range(rounds or 3 * a.shape[0]):
        slope = at_b - gram @ x
        slope[passive] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.solve(gram[np.ix_(at, at)], at_b[at])
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = at[s <= 0]
            old = x[low]
            step = (old / np.maximum(old - s[s <= 0], 1e-300)).min()
            x[at] += step * (s - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


@cache
def combinations(units: int = UNITS, depth: int = DEPTH) -> np.ndarray:
    """A column for each way to fill `units` exactly with at most `depth` lengths; row u - 1 counts length u."""
    found = [(units,)] + [(i, units - i) for i in range(1, units // 2 + 1)]
    for n in range(3, depth + 1):
        found += [(*c, units - sum(c)) for c in combinations_with_replacement(range(1, units), n - 1) if units - sum(c) >= c[-1]]
    out = np.zeros((units, len(found)))
    for k, c in enumerate(found):
        for u in c:
            out[u - 1, k] += 1
    return out


def plan(counts: np.ndarray, units: int = UNITS, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """[(uses by length in units, repeats)] that use up counts (of lengths 1..units); every entry fits a window."""
    left, out = counts.astype(np.int64).copy(), []
    ways = combinations(units, depth)
    share = nnls(ways, left.astype(float))
    for k in np.argsort(-share, kind="stable"):
        uses = {int(u) + 1: int(ways[u, k]) for u in np.flatnonzero(ways[:, k])}
        times = min(int(share[k] + 1e-6), *(int(left[u - 1]) // n for u, n in uses.items()))
        if times > 0:
            out.append((uses, times))
            for u, n in uses.items():
                left[u - 1] -= n * times
    while left.any():  # greedily: the longest left, then the longest that still fits; each step uses some length up
        room, uses = units, {}
        while room:
            fit = [u for u in range(min(room, units), 0, -1) if left[u - 1] > uses.get(u, 0)]
            if not fit:
                break
            uses[fit[0]] = uses.get(fit[0], 0) + 1
            room -= fit[0]
        times = min(int(left[u - 1]) // n for u, n in uses.items())
        out.append((uses, times))
        for u, n in uses.items():
            left[u - 1] -= n * times
    return out


def slots(planned: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(unit length, first rank, end rank, first sequence, uses a sequence): which ranks of a length go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for uses, times in planned:
        for u, n in uses.items():
            at = used.get(u, 0)
            out.append((u, at, at + n * times, sequence, n))
            used[u] = at + n * times
        sequence += times
    return out


def pack_rests(length: np.ndarray, position: np.ndarray, window: int = WINDOW, units: int = UNITS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, offset) of the rests of one range: lengths under the window, and their documents' positions, all different.

    Of the pieces of a length those with smaller positions take the slots that come first; in a sequence, pieces stand by position.
    """
    unit = -(-length // (window // units))
    order = np.lexsort((position, unit))
    counts = np.bincount(unit - 1, minlength=units)
    rank = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    table = np.array(sorted(slots(plan(counts, units, depth))), np.int64)
    most = len(unit) + 1
    at = np.searchsorted(table[:, 0] * most + table[:, 1], unit[order] * most + rank, "right") - 1
    local = np.empty(len(unit), np.int64)
    local[order] = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
    order = np.lexsort((position, local))
    first = np.flatnonzero(np.concatenate([[True], np.diff(local[order]) > 0]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    before = np.cumsum(length[order]) - length[order]
    sequence, offset = np.empty(len(unit), np.int64), np.empty(len(unit), np.int64)
    sequence[order] = position[order][first][of] * SPREAD + SPREAD - 1
    offset[order] = before - before[first][of]
    return sequence, offset


def pack_pieces(pieces: DataFrame, documents: int, window: int = WINDOW, units: int = UNITS, depth: int = DEPTH) -> DataFrame:
    """pieces with sequence_id and offset; ordered by sequence_id, sequences follow the documents' positions.

    pieces has position (a number of its document under `documents`, which no other document has), start, length (1 to
    `window`; all of a document's pieces but the last have `window`), and any other columns, and should be cheap to read twice.
    Whole windows move nowhere; the rests are shuffled once, by range. No rows give no rows. Equal documents have
    positions of their own. Columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    size = min(MOST_RANGE, max(LEAST_RANGE, documents // RANGES))

    def pack(rests: pa.Table) -> pa.Table:
        sequence, offset = pack_rests(rests["length"].to_numpy(), rests["position"].to_numpy(), window, units, depth)
        return rests.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    whole = pieces.where(F.col("length") == window)
    whole = whole.withColumn("sequence_id", F.col("position") * SPREAD + F.expr(f"start div {window}")).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < window).groupBy(F.expr(f"position div {size}"))
    return whole.unionByName(rests.applyInArrow(pack, schema))


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, position, start, length, doc_tokens, ids, sequence_id, offset for every piece of every document."""
    ranked, documents = file_ranks(docs, "position")
    return pack_pieces(cut(tokenize_pieces(ranked, window, keep=("doc_id", "position")), "pieces"), documents, window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, used, padded, ids): a row for each sequence, its pieces' ids in order as binary.

    A sequence is padded with pad_id to the window, except where its length is a power of two.
    """
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"))
    two = F.bit_count("used") == 1
    padded = F.when(two, F.col("used")).otherwise(F.lit(window))
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (padded - F.col("used")).cast("int"))
    return rows.select("sequence_id", "used", padded.alias("padded"), F.unhex(F.concat(F.array_join(F.transform("p", lambda x: x["ids"]), ""), pad)).alias("ids"))


def pack_digests(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, position for every piece, in the order of docs' files.

    position is the document's place in that order; only the CRC-32 of a piece's ids is kept. An empty table has no pieces.
    """
    ranked, documents = file_ranks(docs, "position")
    pieces = cut(tokenize_pieces(ranked, keep=("doc_id", "position")).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack_pieces(pieces, documents).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "position")


def op8(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, as pack_digests() says."""
    return pack_digests(docs)
