"""The Porter stemmer, from M. F. Porter, "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

import re

_VOWELS = "aeiou"
# The suffix tables of steps 2, 3 and 4 of the paper.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
_STEP4 = tuple((x, "") for x in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())
_TABLES = [sorted(table, key=lambda x: -len(x[0])) for table in (_STEP2, _STEP3, _STEP4)]


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in _VOWELS or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(part: str) -> int:
    return len(re.findall("v+c+", _shape(part)))


def _short_end(part: str) -> bool:
    return _shape(part)[-3:] == "cvc" and part[-1] not in "wxy"


def _by_table(word: str, table: list[tuple[str, str]], least: int) -> str:
    for suffix, other in table:
        if word.endswith(suffix):
            part = word[: -len(suffix)]
            if _measure(part) > least and (suffix != "ion" or part[-1:] in ("s", "t")):
                return part + other
            return word
    return word


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        part = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
        if part is not None and "v" in _shape(part):
            word = part
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _by_table(word, _TABLES[0], 0)
    word = _by_table(word, _TABLES[1], 0)
    word = _by_table(word, _TABLES[2], 1)
    if word.endswith("e"):
        part = word[:-1]
        if _measure(part) > 1 or _measure(part) == 1 and not _short_end(part):
            word = part
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
