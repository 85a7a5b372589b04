"""Porter's stemmer (M. F. Porter, 1980), as a function of one lower-case word."""

from __future__ import annotations

import re

#: The suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def cvc(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def replaced(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The longest matching suffix is replaced if what stands before it is long enough."""
    for suffix, by in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + by if measure(stem) >= least else word
    return word


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + by
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            base = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in shape(base):
                word = base + "e" if base.endswith(("at", "bl", "iz")) else base[:-1] if double(base) and base[-1] not in "lsz" else base + "e" if measure(base) == 1 and cvc(base) else base
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(word, STEP2, 1)
    word = replaced(word, STEP3, 1)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
