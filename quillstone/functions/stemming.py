"""English stems and stop words of the database's text search: the published Porter2 algorithm, for distinct words."""

from __future__ import annotations

import re
from functools import lru_cache

# Words without a lexeme.
ENGLISH_STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now".split()
)
# Words with stems of their own, words that stay, words that stay after the plural is off, beginnings that set the first region.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
INVARIANT_SINGULAR = frozenset("inning outing canning herring earring proceed exceed succeed".split())
FIRST_REGION = ("gener", "commun", "arsen")
# Suffixes and what replaces them, longest first within a step; a condition on what stands before is written as a look-behind.
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _suffix(word: str, suffixes) -> str | None:
    return next((s for s in suffixes if word.endswith(s)), None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; digits count as consonants, words of one or two letters stay."""
    if len(word) < 3 or word in INVARIANT:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(r"([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    r1 = next((len(p) for p in FIRST_REGION if w.startswith(p)), None) or _after(w, 0)
    r2 = _after(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in INVARIANT_SINGULAR:
        return w
    s = _suffix(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: len(w) - len(s)] + "ee"
    elif s and _VOWEL.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    s = _suffix(w, [x for x, _ in STEP_2])
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if not (s == "ogi" and not before.endswith("l") or s == "li" and before[-1:] not in "cdeghkmnrt"):
            w = before + dict(STEP_2)[s]
    s = _suffix(w, [x for x, _ in STEP_3])
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + dict(STEP_3)[s]
    s = _suffix(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme(word: str) -> str | None:
    """The lexeme of a lower-case word: its stem, or none for a stop word."""
    return None if word in ENGLISH_STOP_WORDS else stem(word)
