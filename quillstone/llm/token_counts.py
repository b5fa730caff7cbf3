"""Token counts of sections by offset-mapped attribution: a document is encoded once, its tokens' spans are joined to sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.tokens import Encoder, chunks

#: How a token that crosses boundaries is allocated: to the section of its first byte, of its last, or of most of its bytes (ties: the first).
RULES = ("first", "last", "most")


def section_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which a document's sections start: its lines, each with the line feed that ends it."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(text)]]).astype(np.int64)


def attribute(starts: np.ndarray, token_ends: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section. Sections and tokens tile the text in bytes: section i is [starts[i], starts[i + 1]), token
    j ends at token_ends[j] and begins where the one before ends. The interval join is a search in the sorted starts."""
    begins = token_ends - np.diff(token_ends, prepend=0)
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, token_ends - 1, "right") - 1
    if rule == "first":
        own = first
    elif rule == "last":
        own = last
    else:
        own = first.copy()
        for j in np.flatnonzero(first != last):
            s = np.arange(first[j], last[j] + 1)
            ends = np.append(starts, token_ends[-1])[s + 1]
            own[j] = s[np.argmax(np.minimum(ends, token_ends[j]) - np.maximum(starts[s], begins[j]))]
    return np.bincount(own, minlength=len(starts))


def section_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rule: str = "first") -> DataFrame:
    """keep columns, section, start, end (code points, end exclusive), tokens, crossing for each section of each document.

    Sections are lines; an empty or null text has one empty section. Tokens are counted once each, so the tokens of a
    document's sections add up to its own. `crossing` counts tokens that begin in the section and end in a later one.
    Token spans come from the bytes of each token, so tokens that hold part of a character are placed exactly.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    out = ("section", "start", "end", "tokens", "crossing")
    keep = tuple(c for c in keep if c not in out)
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(c, T.LongType(), False) for c in out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for whole in batches:
            for batch in chunks(whole, text):
                texts = pc.fill_null(batch.column(text), "")
                ids, bounds = encoder.encode_batch(texts)
                lengths = encoder.byte_lengths[ids]
                parts: list[tuple[np.ndarray, ...]] = []
                for i, t in enumerate(texts):
                    raw = t.as_buffer().to_pybytes() if t.as_buffer() is not None else b""
                    starts = section_starts(raw)
                    ends = np.cumsum(lengths[bounds[i] : bounds[i + 1]])
                    first_bytes = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters before each byte
                    at = first_bytes[np.append(starts, len(raw))]
                    if len(ends):
                        counts = attribute(starts, ends, rule)
                        begins = ends - lengths[bounds[i] : bounds[i + 1]]
                        a, b = np.searchsorted(starts, begins, "right") - 1, np.searchsorted(starts, ends - 1, "right") - 1
                        crossing = np.bincount(a[a != b], minlength=len(starts))
                    else:
                        counts = crossing = np.zeros(len(starts), np.int64)
                    parts.append((np.full(len(starts), i), np.arange(len(starts)), at[:-1], at[1:], counts, crossing))
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(columns[0])) for c in keep], *map(pa.array, columns[1:])], names=[*keep, *out])

    return docs.select(*keep, text).mapInArrow(run, schema)


def document_tokens(sections: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokens and sections by document, summed map-side."""
    return sections.groupBy(*keep).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sections"))


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, section, start, end, tokens, crossing."""
    return section_tokens(docs)
