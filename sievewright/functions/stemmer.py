"""The English (Porter2) stemmer, written from its published definition."""

from __future__ import annotations

import re

# Fixed values of the published definition: irregular words, regions, suffix rules.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_STEP_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
VOWELS, DOUBLES, LI_ENDINGS = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_SHORT_END = re.compile(f"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    special = re.match("gener|commun|arsen", word)
    if special:
        r1 = special.end()
    else:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _has_vowel(text: str) -> bool:
    return any(c in VOWELS for c in text)


def _step_1a(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _step_1b(w: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            return w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            body = w[: -len(suffix)]
            if not _has_vowel(body):
                return w
            if body.endswith(("at", "bl", "iz")):
                return body + "e"
            if body.endswith(DOUBLES):
                return body[:-1]
            if r1 >= len(body) and _SHORT_END.search(body):
                return body + "e"
            return body
    return w


def _step_2(w: str, r1: int) -> str:
    for suffix, put in STEP_2:
        if w.endswith(suffix):
            body = w[: -len(suffix)]
            if len(body) < r1 or suffix == "ogi" and not body.endswith("l") or suffix == "li" and body[-1:] not in tuple(LI_ENDINGS):
                return w
            return body + put
    return w


def _step_3(w: str, r1: int, r2: int) -> str:
    for suffix, put in STEP_3:
        if w.endswith(suffix):
            body = w[: -len(suffix)]
            return body + put if len(body) >= (r2 if suffix == "ative" else r1) else w
    return w


def _step_4(w: str, r2: int) -> str:
    for suffix in STEP_4:
        if w.endswith(suffix):
            body = w[: -len(suffix)]
            return body if len(body) >= r2 and (suffix != "ion" or body.endswith(("s", "t"))) else w
    return w


def _step_5(w: str, r1: int, r2: int) -> str:
    if w.endswith("e"):
        body = w[:-1]
        return body if len(body) >= r2 or len(body) >= r1 and not _SHORT_END.search(body) else w
    return w[:-1] if w.endswith("ll") and len(w) - 1 >= r2 else w


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.removeprefix("'")
    w = re.sub(f"(^|[{VOWELS}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for suffix in ("'s'", "'s", "'"):
        if w.endswith(suffix):
            w = w[: -len(suffix)]
            break
    w = _step_1a(w)
    if w in AFTER_STEP_1A:
        return w
    w = _step_1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _step_5(_step_4(_step_3(_step_2(w, r1), r1, r2), r2), r1, r2)
    return w.replace("Y", "y")
