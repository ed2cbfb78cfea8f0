"""Search terms: the same rule as a column expression and, for a query string, in Python."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TERM = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and the letters under the marks."""
    marked, plain = [], []
    for code in range(0xE0, 0x250):
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if char != base and base.isascii() and char == char.lower():
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _accents()


def terms(text: Column) -> Column:
    """Lower-case terms without accents, in text order."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(TERM), F.lit(0))


def query_terms(text: str, stemmed: bool = True) -> list[str]:
    """Distinct terms of a query string."""
    folded = text.lower().translate(str.maketrans(MARKED, PLAIN))
    words = re.findall(r"[^\W_]+", folded)
    return list(dict.fromkeys(porter(w) if stemmed else w for w in words))


VOWELS = "aeiou"
# Suffix tables of the published stemming algorithm, steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize")


@lru_cache(maxsize=8)
def _longest_first(suffixes: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted(suffixes, key=len, reverse=True))


def _kinds(word: str) -> str:
    """``c`` or ``v`` per letter; a y after a consonant is a vowel."""
    kinds = ""
    for letter in word:
        vowel = letter in VOWELS or (letter == "y" and kinds[-1:] == "c")
        kinds += "v" if vowel else "c"
    return kinds


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in _longest_first(tuple(table)):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


@lru_cache(maxsize=1 << 17)
def porter(word: str) -> str:
    """Porter's 1980 suffix stripper; words of one or two letters, and others than a–z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and _has_vowel(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP_2, 0)
    word = _replace(word, STEP_3, 0)
    for suffix in _longest_first(STEP_4):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            word = stem
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems, computed once per distinct word of a batch."""
    return words.map({w: porter(w) for w in words.dropna().unique()})
