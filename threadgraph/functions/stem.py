"""Porter's stemmer (1980). Words are stemmed in Arrow batches; callers stem distinct words, not occurrences."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: suffixes, and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str], least: int) -> str:
    suffix = max((s for s in rules if word.endswith(s)), key=len, default=None)
    if suffix is not None and _measure(stem := word[: -len(suffix)]) >= least:
        return stem + rules[suffix]
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif (found := re.search("(ed|ing)$", word)) and "v" in _shape(rest := word[: found.start()]):
        word = rest
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2, 1), STEP_3, 1)
    suffix = max((s for s in (*STEP_4, "ion") if word.endswith(s)), key=len, default=None)
    if suffix is not None:
        rest = word[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def porter_stem(word: Column | str) -> Column:
    return F.pandas_udf(_stems, "string")(word)
