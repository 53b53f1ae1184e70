"""Tokenizers of the text index: plain, diacritic-folding, and with Porter stems."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import text_of

WORD = r"([\p{L}\p{N}]+)"


def simple_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits; stays in the JVM."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(WORD), F.lit(1))


def fold(text: str) -> str:
    """Lower case, diacritics of composed letters removed."""
    out = []
    for ch in text.lower():
        base = unicodedata.normalize("NFD", ch)[0] if ch > "\x7f" else ch
        if not unicodedata.combining(ch):
            out.append(base)
    return "".join(out)


_VOWELS = frozenset("aeiou")


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for i, ch in enumerate(w):
        out.append(ch not in _VOWELS and not (ch == "y" and i > 0 and out[i - 1]))
    return out


def _measure(w: str) -> int:
    c = _consonants(w)
    return sum(1 for i in range(1, len(c)) if c[i] and not c[i - 1])


def _has_vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _cvc(w: str) -> bool:
    c = _consonants(w)
    return len(w) > 2 and c[-1] and not c[-2] and c[-3] and w[-1] not in "wxy"


# The suffix rules of Porter's algorithm (1980), steps 2 to 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def porter(w: str) -> str:
    """Stem of a lower-case word; words of fewer than three or more than 64 bytes stay.

    Letters are bytes here: each byte of a letter outside ASCII is a consonant.
    """
    raw = w.encode()
    return _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "replace") if 3 <= len(raw) <= 64 else w


def _stem(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    shortened = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, shortened = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, shortened = w[:-3], True
    if shortened:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = _longest(w, rules)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = _longest(w, STEP4)
    if s:
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def _porter_each(words):  # a pandas Series of arrays; Arrow batches
    return words.map(lambda ws: [porter(fold(w)) for w in ws])


@F.pandas_udf(StringType())
def _porter_word(words):
    return words.map(lambda w: porter(fold(w)))


def porter_tokens(c: Column | str) -> Column:
    """Tokens with diacritics folded and Porter stems, for short texts such as queries; an index stems distinct words."""
    return _porter_each(simple_tokens(c))


def stem_words(words: DataFrame) -> DataFrame:
    """``word, token``: the stem of each word (``word``, distinct)."""
    return words.select("word", _porter_word("word").alias("token"))


TOKENIZERS = {"simple": simple_tokens, "porter": porter_tokens}


def tokenize(text: str, tokenizer: str = "simple") -> list[str]:
    """Tokens of a query string, as the column functions give them."""
    import regex

    words = regex.findall(WORD, text.lower())
    return [porter(fold(w)) for w in words] if tokenizer == "porter" else words
