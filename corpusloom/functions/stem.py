"""Porter's suffix stripping for English words, as published in 1980 with the author's later changes (bli, logi).

A word's shape is a string of c and v; its measure is how often a vowel stretch is followed by a consonant stretch. Rules are
tables of (suffix, replacement), tried longest first; a rule whose suffix fits ends its step, whether its condition holds or not.
"""

from __future__ import annotations

import unicodedata

# The suffixes of steps 2, 3 and 4, with what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Tokens of other lengths, in UTF-8, are left as they are.
SHORTEST, LONGEST = 3, 64


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant, all that is no vowel is a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiou"


def _suffix(word: str, suffixes) -> str | None:
    """The longest of the suffixes that a word has beside some stem."""
    return max((s for s in suffixes if len(word) > len(s) and word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    cut = _suffix(word, ("sses", "ies", "ss", "s"))
    return word[: -{"sses": 2, "ies": 2, "s": 1}[cut]] if cut and cut != "ss" else word


def _past(word: str) -> str:
    cut = _suffix(word, ("eed", "ed", "ing"))
    if cut is None:
        return word
    stem = word[: -len(cut)]
    if cut == "eed":
        return stem + "ee" if measure(stem) > 0 else word
    if "v" not in shape(stem):
        return word
    if _suffix(stem, ("at", "bl", "iz")):
        return stem + "e"
    if _double(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if measure(stem) == 1 and _short(stem) else stem


def _final_y(word: str) -> str:
    return word[:-1] + "i" if word[-1] == "y" and "v" in shape(word[:-1]) else word


def _replaced(word: str, rules: dict[str, str]) -> str:
    cut = _suffix(word, rules)
    return word[: -len(cut)] + rules[cut] if cut and measure(word[: -len(cut)]) > 0 else word


def _residue(word: str) -> str:
    cut = _suffix(word, STEP_4)
    stem = word[: -len(cut)] if cut else word
    fits = cut and measure(stem) > 1 and (cut != "ion" or stem[-1] in "st")
    return stem if fits else word


def _final_e(word: str) -> str:
    stem = word[:-1]
    if word[-1] == "e" and (measure(stem) > 1 or (measure(stem) == 1 and not _short(stem))):
        word = stem
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    word = _final_y(_past(_plural(word)))
    return _final_e(_residue(_replaced(_replaced(word, STEP_2), STEP_3)))


def folded(word: str) -> str:
    """Without marks on its letters."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def stem(word: str) -> str:
    """What a token is indexed as: folded, then stemmed."""
    return porter(folded(word))
