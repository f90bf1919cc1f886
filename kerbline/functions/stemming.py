"""Porter's suffix stripping for English words (the published algorithm with common extensions)."""

from __future__ import annotations

# Irregular words and the suffix tables of the published algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """c / v per letter; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(base: str) -> int:
    return _shape(base).count("vc")


def _ends_cvc(word: str) -> bool:
    s = _shape(word)
    if len(word) >= 3 and s[-3:] == "cvc" and word[-1] not in "wxy":
        return True
    return len(word) == 2 and s == "vc"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        base = w[: -len(end)]
        if w.endswith(end) and "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double(base):
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if _measure(base) == 1 and _ends_cvc(base) else base
    return w


def _swap(w: str, table: list[tuple[str, str]]) -> str:
    for end, new in table:
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if end == "logi":
                return base + new if _measure(base + "l") > 0 else w
            if _measure(base) > 0:
                w2 = base + new
                return _swap(w2, table) if end == "alli" else w2
            return w
    return w


def _long_suffix(w: str) -> str:
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                return base
            return w
    return w


def _tail(w: str) -> str:
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _tail(_long_suffix(_swap(_swap(w, STEP2), STEP3)))
