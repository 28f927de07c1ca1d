"""The Porter stemming algorithm, after M. F. Porter (1980), for one word.

With the corrections in general use since: words of one or two letters are kept,
``bli`` gives ``ble``, ``logi`` gives ``log``, ``fulli`` gives ``ful``, short words
in ``ies`` and ``ied`` end in ``ie``, a final ``y`` turns to ``i`` only after a
consonant that does not begin the word, and a few irregular words are listed.
"""

from __future__ import annotations

import re

# ---- fixed values: irregular words, and suffix tables of steps 2, 3 and 4 ----------
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
# ---- end of fixed values ----------------------------------------------------------

_MEASURE = re.compile("v+c+")


def _shape(stem: str) -> str:
    """Vowels as v and consonants as c; y is a vowel after a consonant."""
    shape = ""
    for letter in stem:
        if letter in "aeiou" or (letter == "y" and shape.endswith("c")):
            shape += "v"
        else:
            shape += "c"
    return shape


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_shape(stem)))


def _short_end(stem: str) -> bool:
    shape = _shape(stem)
    return shape == "vc" or (shape.endswith("cvc") and stem[-1] not in "wxy")


def _swap(word: str, table: dict[str, str]) -> str:
    """Replace the longest listed suffix, if enough is left before it."""
    for suffix in sorted((s for s in table if word.endswith(s)), key=len, reverse=True):
        stem = word[: len(word) - len(suffix)]
        # In "logi" the l counts as part of the stem.
        kept = stem + "l" if suffix == "logi" else stem
        return stem + table[suffix] if _measure(kept) > 0 else word
    return word


def _second(word: str) -> str:
    """Step 2; what is left of an ``alli`` goes through it once more."""
    swapped = _swap(word, STEP_2)
    if word.endswith("alli") and swapped != word:
        return _second(swapped)
    return swapped


def _plural(word: str) -> str:
    if len(word) == 4 and word.endswith("ies"):
        return word[:-1]
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            if _measure(stem) == 1 and _short_end(stem):
                return stem + "e"
            return stem
    return word


def _residue(word: str) -> str:
    for suffix in sorted((s for s in STEP_4 if word.endswith(s)), key=len, reverse=True):
        stem = word[: len(word) - len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st"):
            return stem
        return word
    return word


def porter_stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _residue(_swap(_second(word), STEP_3))
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
