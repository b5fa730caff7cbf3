"""Secret scans: fixed patterns, and incompressible strings in sensitive context found by dictionary-primed zstandard."""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns (group 2 of assign is the secret), and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "novel")
# Words that make a context sensitive, and parts of identifiers that prime the compressor.
SENSITIVE = "password passwd pwd passphrase secret token apikey api_key api-key access_key private_key authorization bearer credential signature session_id client_id".split()
IDENTIFIERS = (
    "authorization authentication application certificate configuration connection container controller credential database default "
    "description development directory document encryption endpoint environment exception expression factory function generator handler "
    "identifier implementation index information initialize instance integer interface iterator javascript keyboard language library "
    "listener location manager message method module namespace network notification number object operation package parameter parser "
    "password permission pipeline placeholder position private process production property protected protocol provider public query "
    "readme reference registry repository request resource response result return schema secret security serializer server service "
    "session settings signature statement static string subscription synchronize template temporary terminal thread timestamp token "
    "transaction transform undefined unknown update username validate value variable version visible websocket window workspace "
    "action active address amount array async audio body buffer cache client color column command config count country create current data date debug default delete "
    "detail domain download email enable entry error event export field file filter first format group header height history image import input insert internal item "
    "label last length level limit line link list load main max member menu min model name number order output owner page payment phone price product profile project "
    "quantity rate read record remove report reset role row save search select send shipping size sort source start state status store stream submit sum table target "
    "task text theme time title total type update upload url user view width word write abstract bean "
    "example your insert change me here test sample dummy xxxxxxxx 00000000 12345678 abcdefghijklmnopqrstuvwxyz 0123456789 get set is has to from by with on off "
)
#: Letters of a candidate; characters before it in which a sensitive word must stand; characters of code around it that prime the
#: compressor; characters between two secrets of one list.
LEAST_CANDIDATE, REACH, AROUND, BETWEEN = 16, 48, 256, 8
#: How many times what a random string over the candidate's own alphabet needs its marginal compressed bytes have to be at least. Longer
#: candidates are measured in windows, and as a whole by the second of these.
NOVELTY, LEAST_WHOLE, WINDOW = 1.06, 0.9, 48
#: Bytes of the trained dictionary, lists of identifiers that it is trained on, their words, and the level, at which its letter codes are used for any length.
DICTIONARY, SAMPLES, SAMPLE_WORDS, LEVEL = 4096, 600, 5, 1

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=!@#$%%^&*-]{%d,}" % LEAST_CANDIDATE)
_PARTS = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[_/.:\s-]+")
_CLASSES = tuple((n, re.compile(p)) for n, p in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]")))
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
#: RE2 pattern of texts that can hold any span; the others are not looked at again.
_WORTH = "(?i:" + "|".join(re.escape(w) for w in SENSITIVE) + r"|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "end", "secret_start")]]))
Span = tuple[int, int, int, int]  # start, place of its kind in KINDS, end, start of the secret itself


def in_words(text: str) -> str:
    """The text in small letters with its identifiers cut into their words, as the dictionary holds them."""
    return _PARTS.sub(" ", text).lower()


def random_bytes(candidate: str) -> float:
    """The bytes that a random string of this length needs over the candidate's own letters: those of the classes it uses, and its other marks."""
    classes = sum(n for n, p in _CLASSES if p.search(candidate))
    return len(candidate) * math.log2(max(2, classes + len({c for c in candidate if not c.isalnum()}))) / 8


@lru_cache(maxsize=1)
def dictionary() -> bytes:
    """A dictionary with letter codes, trained on lists of the identifiers; without these codes a short string is stored as it is, whatever it says."""
    words, deal = in_words(IDENTIFIERS).split(), random.Random(1)
    return zstandard.train_dictionary(DICTIONARY, [" ".join(deal.sample(words, SAMPLE_WORDS)).encode() for _ in range(SAMPLES)], level=LEVEL).as_bytes()


class Scanner:
    """Finds the spans of one text after another; one per task."""

    def __init__(self, trained: bytes | None = None):
        primer = zstandard.ZstdCompressionDict(trained or dictionary(), dict_type=zstandard.DICT_TYPE_FULLDICT)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _bytes(self, text: str) -> int:
        return len(self.zstd.compress(text.encode("utf-8", "surrogatepass")))

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes, as a multiple of what a random string needs: what the candidate, window by window, adds to its surroundings.

        Both are primed with the dictionary. As each window is measured by itself, length changes nothing; a candidate of windows that
        repeat each other is worth what it adds as a whole.
        """
        b, a = in_words(before) + " ", " " + in_words(after)
        n = max(1, round(len(candidate) / WINDOW))
        cuts = [len(candidate) * i // n for i in range(n + 1)]
        alone = self._bytes(b + a)
        whole = (self._bytes(b + in_words(candidate) + a) - alone) / random_bytes(candidate)
        if n == 1 or whole < LEAST_WHOLE:
            return whole
        return sum(self._bytes(b + in_words(candidate[i:j]) + a) - alone for i, j in zip(cuts, cuts[1:], strict=False)) / random_bytes(candidate)

    def base(self, text: str) -> list[Span]:
        out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
        out += [(m.start(), k, m.end(), m.start()) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
        return sorted(out)

    def novel(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates, or what base spans leave of them, in sensitive context that don't compress.

        A sensitive word stands shortly before, or another candidate in such context does, with at most BETWEEN characters between that are
        no letters or digits: the parts of a token and the entries of a list. Surroundings are measured without candidates that the dictionary
        alone says are random, copies of this one included: what random strings stand around a secret doesn't hide it.
        """
        if not _SENSITIVE.search(text):
            return []
        taken: list[list[int]] = []
        for a, b in sorted((s[0], s[2]) for s in base):
            if taken and a <= taken[-1][1]:
                taken[-1][1] = max(b, taken[-1][1])
            else:
                taken.append([a, b])
        past, places = [b for _, b in taken], []
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            i = bisect.bisect_right(past, a)
            while i < len(taken) and taken[i][0] < b:
                places.append((a, taken[i][0]))
                a, i = taken[i][1], i + 1
            places.append((a, b))
        places = [(a, b) for a, b in places if b - a >= LEAST_CANDIDATE]
        begins, known = [a for a, _ in places], {}

        def made_up(a: int, b: int) -> bool:
            s = text[a:b]
            if s not in known:
                known[s] = self.novelty("", s, "") >= NOVELTY
            return known[s]

        def around(low: int, high: int) -> str:
            kept, at = [], low
            for i in range(max(0, bisect.bisect_left(begins, low) - 1), bisect.bisect_left(begins, high)):
                a, b = places[i]
                if b > low and made_up(a, b):
                    kept.append(text[at : max(at, a)])
                    at = max(at, b)
            return " ".join([*kept, text[at:high]])

        out, last = [], -BETWEEN - 1
        for a, b in places:
            near = a - last <= BETWEEN and not any(map(str.isalnum, text[last:a])) or _SENSITIVE.search(text, max(0, a - REACH), a)
            if near:
                last = b
                if self.novelty(around(max(0, a - AROUND), a), text[a:b], around(b, min(len(text), b + AROUND))) >= NOVELTY:
                    out.append((a, 3, b, a))
        return out

    def spans(self, text: str) -> list[Span]:
        base = self.base(text)
        return sorted(base + self.novel(text, base))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every secret (of an assignment, its value) replaced by a mark of its kind."""
    out, at = [], 0
    for _, kind, end, start in sorted(spans, key=lambda s: (s[3], s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()} REMOVED]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with `spans`, array of (kind, start, end, secret_start) in code points, ends exclusive, by start and kind.

    Whole texts are read; null and empty ones have no spans. With redact the secrets in `text` are replaced as well.
    Spans of different kinds may overlap. Repeated rows are scanned each. A column named spans is replaced.
    """
    docs = docs.drop("spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", SPANS, False)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_start", pa.int64())]))

    trained = dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(trained)
        for batch in batches:
            texts = batch.column(text)
            found: list[list[Span]] = [[]] * len(texts)
            changed: dict[int, str] = {}
            for i in np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, _WORTH), False))).tolist():
                t = texts[i].as_py()
                found[i] = scanner.spans(t)
                if redact and found[i]:
                    changed[i] = redacted(t, found[i])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                columns[text] = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], texts.type))
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "secret_start": s} for a, k, b, s in row] for row in found], kind)
            yield pa.RecordBatch.from_arrays([*columns.values(), spans], names=[*columns, "spans"])

    return docs.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in their texts replaced; no document goes."""
    return scan(docs, redact=True).select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "spans")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
