"""Byte-level BPE of whole documents, in Arrow batches.

The vocabulary is that of byte_bpe_50k.json; ids equal those of the `tokenizers` library. The pattern of this
tokenizer never joins what stands before a single space to what follows it, so a text is cut there, each distinct word of
a batch is encoded once, and ids are gathered by word.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
#: Text bytes that are encoded at a time, words that a task remembers, and the most bytes of one of them.
CHUNK_BYTES, REMEMBERED, REMEMBERED_BYTES = 2 << 20, 100_000, 64
#: Texts that can't be cut at single spaces: a space at an end or beside other white space, or the special token.
_ODD = r"^ | $| [\s\pZ\x{85}\x{1c}-\x{1f}]|[\s\pZ\x{85}\x{1c}-\x{1f}] |<\|endoftext\|>"

# The characters that the tokenizer's pattern takes for white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space that are cut out before the pattern is applied, which would keep a stack frame for each of their characters.
_LONG_SPACE = re.compile(rf"(?<![{_SPACE}])[{_SPACE}]{{1000,}}")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes Arrow arrays of texts; one per task."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        with open(path or vocabulary_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})
        self.known = pa.array([], pa.string())
        self.known_ids, self.known_begins, self.known_lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.byte_lengths = np.zeros(END_OF_TEXT_ID + 1, np.int64)
        for token, i in ranks.items():
            self.byte_lengths[i] = len(token)
        self.byte_lengths[END_OF_TEXT_ID] = len(END_OF_TEXT)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length.

        The pattern makes one piece of a run of white space, without its last character if a word follows, which the
        word's own piece begins with or which is a piece by itself. So a long run is a cut: what stands before it, the run's piece and
        what follows are encoded each.
        """
        if not _LONG_SPACE.search(text):
            return self._encode(text)
        out = []
        for i, segment in enumerate(text.split(END_OF_TEXT)):
            if i:
                out.append(np.array([END_OF_TEXT_ID], np.uint32))
            at = 0
            for m in _LONG_SPACE.finditer(segment):
                end = m.end() - (m.end() < len(segment))
                out += [self._encode(segment[at : m.start()]), np.array(self.core._core_bpe.encode_single_piece(segment[m.start() : end].encode()), np.uint32)]
                at = end
            out.append(self._encode(segment[at:]))
        return np.concatenate(out)

    def _encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, length) of distinct words, each as it stands behind a space. New words are encoded in one text and told apart by the bytes of their tokens."""
        at = np.asarray(pc.fill_null(pc.index_in(words, self.known), -1)).astype(np.int64)
        new = np.flatnonzero((at < 0) & (np.asarray(pc.binary_length(words)) > 0))
        missing = words.take(pa.array(new))
        ids = self.encode(" " + " ".join(missing.to_pylist())) if len(new) else np.zeros(0, np.uint32)
        begins = np.searchsorted(np.cumsum(self.byte_lengths[ids]) - self.byte_lengths[ids], np.cumsum(np.concatenate([[0], np.asarray(pc.binary_length(missing)).astype(np.int64) + 1])))
        begin, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        old = at >= 0
        begin[old], length[old] = self.known_begins[at[old]], self.known_lengths[at[old]]
        begin[new], length[new] = len(self.known_ids) + begins[:-1], np.diff(begins)
        every = np.concatenate([self.known_ids, ids])
        if len(self.known) < REMEMBERED and len(new):
            short = np.flatnonzero(np.asarray(pc.binary_length(missing)) <= REMEMBERED_BYTES)
            own = np.repeat(begin[new[short]] - (np.cumsum(length[new[short]]) - length[new[short]]), length[new[short]]) + np.arange(int(length[new[short]].sum()))
            self.known = pa.concat_arrays([self.known, missing.take(pa.array(short))])
            self.known_begins = np.concatenate([self.known_begins, len(self.known_ids) + np.cumsum(length[new[short]]) - length[new[short]]])
            self.known_lengths = np.concatenate([self.known_lengths, length[new[short]]])
            self.known_ids = np.concatenate([self.known_ids, every[own]])
        return every, begin, length

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's ids); null texts have none."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        words = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets = np.asarray(words.offsets).astype(np.int64)
        coded = words.values.dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        flat, begins, lengths = self._words(coded.dictionary)
        heads = pc.take(words.values, pa.array(offsets[:-1])).to_pylist()  # first words have no space before them
        own = [self.encode(texts[i].as_py() if o else w) for i, (w, o) in enumerate(zip(heads, odd.tolist(), strict=True))]
        own_lengths = np.fromiter(map(len, own), np.int64, len(own))
        index[offsets[:-1]] = len(begins) + np.arange(len(own))
        begins = np.concatenate([begins, len(flat) + np.cumsum(own_lengths) - own_lengths])
        lengths, flat = np.concatenate([lengths, own_lengths]), np.concatenate([flat, *own])
        sizes = lengths[index]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(begins[index] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[offsets]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, at least one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
