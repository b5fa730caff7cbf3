"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexicon of stems, whole words and phrases. Weighted transducers read them: one finds phrases, one
insults (more after an intensifier), one threats (a verb of harm counts little without an intention before it), and three
scale hits that are negated, reported or aimed at somebody. Their composition runs over each clause; weights multiply along
the path of a hit, and the hits of a clause add up to its score. A document's probability is a logistic function
of its worst clause and of all its clauses. The grammar is fixed; stems are a short seed list plus those that labelled
rows support, and the logistic function is fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import cut, drop_cut, free_name, ordering_hash

# Seed stems; a word that starts with one of them has the symbol.
INSULTS = "idiot moron stupid imbecile scum scumbag loser pathetic worthless disgusting trash clown dumb dumbass bastard retard filthy vermin".split()
HARMS = "kill murder strangle stab destroy burn shoot hurt beat hunt".split()
# Phrases that are a hit as a whole.
PHRASES = {
    "piece of shit": "insult", "piece of crap": "insult", "piece of garbage": "insult", "waste of space": "insult", "waste of oxygen": "insult", "shut up": "insult",
    "go to hell": "threat", "burn in hell": "threat", "drop dead": "threat", "watch your back": "threat",
}
# Whole words with the other symbols.
TARGETS = "you your yours yourself u they them he she him her his these those people everyone du dich ihr tu toi vous usted tú vosotros".split()
NEGATIONS = "not no never none without isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca jamás sin".split()
REPORTS = "said says say claimed claims called wrote writes reported reports quoted quotes according alleged alleges sagte sagt dit écrit dijo dice".split()
INTENSIFIERS = "such total complete utter absolute absolutely so very really fucking bloody damn total völlig tellement tan muy".split()
INTENTIONS = "will would shall should must gonna going wanna want hope wish deserve deserves i'll we'll werde werden sollte vais voy".split()

HITS = ("insult", "threat")
SYMBOLS = ("other", "target", "negation", "report", "quote", "intensifier", "intention", "harm", *HITS)
#: Tokens over which a negation, an aim, an intensifier and an intention reach.
NEGATION_SPAN, TARGET_SPAN, INTENSIFIER_SPAN, INTENTION_SPAN = 3, 4, 2, 3
#: Factors of hits that are negated, reported, aimed, intensified; of harm with and without an intention; weights of seeds and phrases.
NEGATED, REPORTED, AIMED, INTENSIFIED, INTENDED, UNINTENDED, SEED, PHRASE = 0.2, 0.4, 1.3, 1.5, 1.5, 0.3, 2.0, 3.0
#: Least letters of a learned stem; most letters that are tried; evidence (G statistic), rows and precision it must have.
STEM_LETTERS, MOST_LETTERS, LEAST_G, LEAST_ROWS, LEAST_PRECISION = 4, 8, 24.0, 4, 0.6
#: Documented bound: labelled rows for fitting.
MAX_LABELLED = 20_000
#: Copies of a labelled document: words of a shingle, bands and min-hashes of a band (at a similarity of 0.8, one in 3,500 is missed).
SHINGLE_WORDS, BANDS, BAND_HASHES = 5, 8, 2

_CLAUSE = re.compile(r"[.!?;:\n\r]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: arcs[(state, symbol)] = (next state, symbol written, weight).

    A symbol without an arc takes the state's arc for "*", or stays; it is written as it is, with weight 1.
    """

    start: str
    arcs: dict[tuple[str, str], tuple[str, str, float]] = field(hash=False)

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        got = self.arcs.get((state, symbol))
        return got if got else (self.arcs.get((state, "*"), (state, "", 1.0))[0], symbol, 1.0)


def reaching(trigger: str, span: int, reads: dict[str, tuple[str, float]], alone: dict[str, tuple[str, float]] | None = None) -> Transducer:
    """Within `span` tokens after `trigger` the symbols in `reads` are written as (symbol, weight) says; elsewhere as `alone` says."""
    arcs: dict[tuple[str, str], tuple[str, str, float]] = {}
    for left in range(span + 1):
        arcs[str(left), "*"] = (str(max(0, left - 1)), "", 1.0)
        for s, (out, w) in (reads if left else alone or {}).items():
            arcs[str(left), s] = (str(max(0, left - 1)), out, w)
        arcs[str(left), trigger] = (str(span), trigger, 1.0)
    return Transducer("0", arcs)


def reporting(factor: float = REPORTED) -> Transducer:
    """Scales hits after a verb of saying, to the clause's end, and hits between quotation marks."""
    arcs = {("plain", "report"): ("said", "report", 1.0), ("plain", "quote"): ("quote", "quote", 1.0), ("said", "quote"): ("quote", "quote", 1.0), ("quote", "quote"): ("plain", "quote", 1.0)}
    for s in HITS:
        arcs["said", s] = ("said", s, factor)
        arcs["quote", s] = ("quote", s, factor)
    return Transducer("plain", arcs)


def phrasing(phrases: dict[str, str], base: dict[str, str]) -> Transducer:
    """Reads words of phrases as symbols of their own; writes the hit at a phrase's last word, else what the word is by itself (`base`).

    The states are the prefixes of phrases; a word that doesn't go on goes to the longest prefix that ends in it.
    """
    whole = {tuple(p.split()): k for p, k in phrases.items()}
    prefixes = {p[:i] for p in whole for i in range(len(p))}
    arcs: dict[tuple[str, str], tuple[str, str, float]] = {}
    for at in prefixes:
        arcs[" ".join(at), "*"] = ("", "", 1.0)
        for word in {w for p in whole for w in p}:
            ends = [(*at[i:], word) for i in range(len(at) + 1)]
            hit = next((whole[e] for e in ends if e in whole), None)
            to = next((e for e in ends if e in prefixes), ())
            arcs[" ".join(at), f"word {word}"] = ("", hit, PHRASE) if hit else (" ".join(to), base.get(word, "other"), 1.0)
    return Transducer("", arcs)


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """The transducer that hands what `first` writes to `second`, weights multiplied, over the reachable pairs of states."""
    symbols, start = tuple(symbols), (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = todo.pop()
        for s in symbols:
            a2, mid, w = first.step(a, s)
            b2, out, v = second.step(b, mid)
            arcs[f"{a}|{b}", s] = (f"{a2}|{b2}", out, w * v)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer("|".join(start), arcs)


def kinds_of_words() -> dict[str, str]:
    """Whole words to symbols."""
    return {w: k for k, ws in (("intensifier", INTENSIFIERS), ("intention", INTENTIONS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("quote", '"“”«»')) for w in ws}


@cache
def grammar(base: tuple[tuple[str, str], ...]) -> tuple[Transducer, Transducer]:
    """(the composition that runs forwards, the aim that runs both ways over what it writes); base: words of phrases and their own symbols."""
    base = dict(base)
    keep = {k: (k, 1.0) for k in HITS}
    scaled = lambda x: {k: (k, x) for k in HITS}
    chain = [
        phrasing(PHRASES, base),
        reaching("intensifier", INTENSIFIER_SPAN, {"insult": ("insult", INTENSIFIED)}),
        reaching("intention", INTENTION_SPAN, keep | {"harm": ("threat", INTENDED)}, {"harm": ("threat", UNINTENDED)}),
        reaching("negation", NEGATION_SPAN, scaled(NEGATED)),
        reporting(),
    ]
    aim = reaching("target", TARGET_SPAN, scaled(AIMED))
    symbols = (*SYMBOLS, *(f"word {w}" for w in base))
    return reduce(lambda a, b: compose(a, b, symbols), chain), aim


@dataclass
class Model:
    """stems: insult and harm stems with weights; weights: of the worst clause, of all clauses, and the intercept."""

    stems: dict[str, tuple[str, float]]
    weights: list[float]


class Scorer:
    """Runs the grammar over texts. Built once per task."""

    def __init__(self, stems: dict[str, tuple[str, float]]):
        self.stems, self.lengths = stems, sorted({len(s) for s in stems}, reverse=True)
        self.words = kinds_of_words()
        self.in_phrases = {w: self.lexical(w)[0] for p in PHRASES for w in p.split()}
        self.found = re.compile(worth(stems))
        (self.machine, self.aim), self.known = grammar(tuple(self.in_phrases.items())), {}

    def lexical(self, word: str) -> tuple[str, float]:
        return next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), None) or (self.words.get(word, "other"), 1.0)

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.known.get(word)
        if got is None:
            kind, weight = self.lexical(word)
            got = (f"word {word}" if word in self.in_phrases else kind, weight)
            if len(self.known) < 50_000:
                self.known[word] = got
        return got

    def clause(self, words: list[str]) -> float:
        """The sum over a clause's hits of their stems' weights times the weights along their paths."""
        state, written = self.machine.start, []
        for w in words:
            symbol, weight = self.symbol(w)
            state, out, factor = self.machine.step(state, symbol)
            written.append((out, weight * factor))
        if not any(s in HITS for s, _ in written):
            return 0.0
        aimed = np.zeros(len(written), bool)
        for places in (range(len(written)), range(len(written) - 1, -1, -1)):  # somebody may be named before or after
            state = self.aim.start
            for i in places:
                state, _, factor = self.aim.step(state, written[i][0])
                aimed[i] |= factor != 1
        return sum(w * (AIMED if aimed[i] else 1.0) for i, (s, w) in enumerate(written) if s in HITS)

    def features(self, text: str) -> tuple[float, float] | None:
        """Of the worst clause and of all clauses, damped; None without a hit."""
        text = text.lower()
        if not self.found.search(text):
            return None
        scores = [s for c in _CLAUSE.split(text) if self.found.search(c) and (s := self.clause(_WORD.findall(c)))]
        return (math.log1p(max(scores)), math.log1p(sum(scores))) if scores else None


def worth(stems: dict[str, tuple[str, float]]) -> str:
    """A pattern of what a text with a hit holds: a stem or a phrase."""
    return "|".join([*map(re.escape, sorted(stems)), *(r"[\W_]+".join(p.split()) for p in PHRASES)])


def _may_match(texts: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, f"(?i){pattern}"), False))


def learn_stems(sample: DataFrame, text: str, label: str) -> dict[str, tuple[str, float]]:
    """Seed stems and those that labelled rows support.

    Counts, for each prefix of a word, the toxic and the other documents in which a word begins with it (summed in each
    partition before the shuffle), over all rows and over those that no seed stem explains, as a word that only stands
    beside seeds is no evidence. Prefixes whose G statistic, rows and precision pass on the latter are kept, but for those of which
    a better one is a prefix or begins with them. A stem's weight is its smoothed log odds; it is a verb of harm if in at
    least half of its toxic documents an intention stands close before it, and an insult otherwise.
    """
    stems = {w: (k, SEED) for k, ws in (("insult", INSULTS), ("harm", HARMS)) for w in ws}
    plain = ~F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(stems) + ")")
    sample = sample.withColumn("plain", plain.cast("int"))
    totals = sample.agg(F.sum(label).alias("p"), F.count("*").alias("n"), F.sum(F.col(label) * F.col("plain")).alias("pp"), F.sum("plain").alias("pn")).first()
    p, n, pp, pn = (int(x or 0) for x in totals)
    if not 0 < p < n:
        return stems
    intentions, counted = frozenset(INTENTIONS), ("neg", "pos", "plain_neg", "plain_pos", "meant")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def flush():
            return pd.DataFrame({"stem": pd.Series(list(seen), dtype=object)} | {c: pd.Series([v[i] for v in seen.values()], dtype="int64") for i, c in enumerate(counted)})

        for pdf in batches:
            for t, y, alone in zip(pdf[text], pdf[label], pdf["plain"], strict=True):
                words = _WORD.findall(t.lower()) if t else []
                meant = {x for i, w in enumerate(words) if w in intentions for x in words[i + 1 : i + 1 + INTENTION_SPAN]}
                stems_of = lambda words: {w[:k] for w in words if len(w) >= STEM_LETTERS and not w[0].isdigit() for k in range(STEM_LETTERS, min(len(w), MOST_LETTERS) + 1)}
                for stem in stems_of(set(words)):
                    c = seen.setdefault(stem, [0] * len(counted))
                    c[int(y)] += 1
                    c[2 + int(y)] += int(alone)
                for stem in stems_of(meant) if y else ():
                    seen[stem][4] += 1
            if len(seen) > 100_000:
                yield flush()
                seen.clear()
        if seen:
            yield flush()

    base, g = F.lit(pp / max(1, pn)), F.col("plain_pos") + F.col("plain_neg")
    part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / (g * q))).otherwise(0.0)
    counts = sample.mapInPandas(count, "stem string, " + ", ".join(f"{c} long" for c in counted)).groupBy("stem").agg(*[F.sum(c).alias(c) for c in counted])
    counts = counts.withColumn("g", 2 * (part("plain_pos", base) + part("plain_neg", 1 - base)))
    new = (F.col("plain_pos") >= LEAST_ROWS) & (F.col("plain_pos") / g >= F.greatest(F.lit(LEAST_PRECISION), base)) & (F.col("g") >= LEAST_G)
    kept = counts.where(new | F.col("stem").isin(list(stems)))
    shorter = {s[:i] for s in stems for i in range(1, len(s))}
    for r in kept.orderBy(F.desc("g"), F.desc(F.length("stem")), "stem").collect():  # at most as many as the sample's words support
        s, weight = r["stem"], max(0.25, math.log((r["pos"] + 0.5) / (r["neg"] + 0.5) * (n - p) / p))
        if s in stems:
            stems[s] = (stems[s][0], weight) if r["pos"] >= LEAST_ROWS else stems[s]
        elif s not in shorter and not any(s[:i] in stems for i in range(1, len(s))):
            stems[s] = ("harm" if 2 * r["meant"] >= r["pos"] else "insult", weight)
            shorter |= {s[:i] for i in range(1, len(s))}
    return stems


def fit_weights(x: np.ndarray, y: np.ndarray, l2: float = 0.5) -> list[float]:
    """Logistic regression by Newton steps with a ridge; the intercept, last, has none."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge, w = np.diag([l2] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - q) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


#: For a corpus without usable labels: one plain seed insult is short of 0.5, an aimed one or two reach it.
DEFAULT_WEIGHTS = (1.5, 1.0, -3.0)


def fitted(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of both features, none negative: a worse clause never makes a document better."""
    order = np.lexsort((y, *x.T))  # rows come in any order; sums of floats shall not
    x, y = x[order], y[order]
    both = fit_weights(x, y)
    if min(both[:-1]) >= 0:
        return both
    worst, every = fit_weights(x[:, :1], y), fit_weights(x[:, 1:], y)
    return [0.0, *every] if both[0] < both[1] else [worst[0], 0.0, worst[1]]


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most max_labelled labelled documents whose CRC-32 of doc_id mod 5 isn't 0, chosen by hash.

    A document with several labels counts as toxic if one says so; null labels are ignored. Of an id that stands on several
    rows the text with the smallest hash counts, so rows are no more than ids. The chosen ids are at most max_labelled, hence the broadcast.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = own.orderBy(ordering_hash(F.col("doc_id")), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def distinct_texts(sample: DataFrame) -> DataFrame:
    """The sample without copies: else the words of one toxic text that has many near copies look like evidence.

    Rows with equal labels that agree in a band of min-hashes of word shingles are neighbours; a row that has a neighbour with
    a smaller hash of its text goes. So something of every group stays, the same however rows are dealt.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixers = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * BAND_HASHES), np.uint64)
        for pdf in batches:
            bands = []
            for text in pdf["text"]:
                w = text.encode("utf-8", "surrogatepass").lower().split()
                h = np.fromiter({xxhash.xxh64_intdigest(b" ".join(w[i : i + SHINGLE_WORDS])) for i in range(max(1, len(w) - SHINGLE_WORDS + 1))}, np.uint64)
                least = np.array([((h ^ x) * (y | np.uint64(1))).min() for x, y in mixers.T]).reshape(BANDS, BAND_HASHES)
                bands.append([xxhash.xxh64_intdigest(b.tobytes()) >> 1 for b in least])
            yield pdf[["text", "toxic"]].assign(h=[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in pdf["text"]], m=bands)

    rows = cut(sample.mapInPandas(sketch, "text string, toxic int, h long, m array<long>"), "sketches")
    near = rows.select("h", "toxic", F.posexplode("m").alias("i", "v"))
    later = near.withColumn("least", F.min("h").over(Window.partitionBy("i", "v", "toxic"))).where("h > least").select("h", "toxic").distinct()
    return rows.join(later, ["h", "toxic"], "left_anti").dropDuplicates(["h", "toxic"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn stems and weights; equal for equal rows, however they are dealt. At most max_labelled rows of a few numbers come to the driver."""
    sample = cut(distinct_texts(training_rows(docs, labels, max_labelled)), "labelled")
    stems = learn_stems(sample, "text", "toxic")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(stems)
        for pdf in batches:
            rows = np.array([scorer.features(t) or (0.0, 0.0) for t in pdf["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"worst": rows[:, 0], "every": rows[:, 1], "toxic": pdf["toxic"].astype("int64")})

    rows = sample.mapInPandas(measure, "worst double, every double, toxic long").collect()
    drop_cut(sample)
    y = np.array([r["toxic"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(stems, list(DEFAULT_WEIGHTS))
    return Model(stems, fitted(np.array([(r["worst"], r["every"]) for r in rows]), y))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`: the probability that a document is toxic, from its whole text.

    Null and empty texts, and texts without a stem, get the intercept's probability. Every row and column is kept;
    a column already named `out` is replaced.
    """
    schema = docs.drop(out).schema.add(out, "double", False)
    weights, pattern = np.array(model.weights), worth(model.stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.stems)
        plain = 1 / (1 + math.exp(-weights[-1]))
        for batch in batches:
            texts = batch.column(text)
            out_col = np.full(len(texts), plain)
            for i in np.flatnonzero(_may_match(texts, pattern)):
                x = scorer.features(texts[int(i)].as_py())
                if x is not None:
                    out_col[i] = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.dot(x, weights[:-1]) + weights[-1])))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out_col)], names=[*batch.schema.names, out])

    return docs.drop(out).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with their own columns."""
    out = free_name(docs, "toxicity")
    return score(docs, fit(docs, labels), out=out).where(F.col(out) < threshold).drop(out)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a row with a null doc_id isn't held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
