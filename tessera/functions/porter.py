"""The Porter stemmer (Porter 1980) as a Pandas UDF, meant for distinct terms."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .units import listed

_KINDS = str.maketrans("abcdefghijklmnopqrstuvwxyz", "".join("v" if x in "aeiou" else "c" for x in "abcdefghijklmnopqrstuvwxyz"))


def _shape(w: str) -> str:
    """c for each consonant, v for each vowel; what a letter is, only those before
    it tell."""
    if "y" not in w:
        return w.translate(_KINDS)
    kinds = ""
    for x in w:
        kinds += "v" if x in "aeiou" or x == "y" and kinds.endswith("c") else "c"
    return kinds


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _shape(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return w[-1:] not in ("w", "x", "y") and _shape(w).endswith("cvc")


# Fixed values of the algorithm: suffixes of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _by_last(suffixes) -> dict[str, tuple[str, ...]]:
    """Suffixes by their last letter, longest first."""
    found: dict[str, tuple[str, ...]] = {}
    for s in sorted(suffixes, key=len, reverse=True):
        found[s[-1]] = (*found.get(s[-1], ()), s)
    return found


_TABLES = [(table, _by_last(table)) for table in (STEP2, STEP3)]
_ENDS4 = _by_last(STEP4)


def _end(w: str, ends: dict[str, tuple[str, ...]]) -> str | None:
    """The longest suffix that ``w`` has."""
    some = ends.get(w[-1:])
    if some and w.endswith(some):
        for s in some:
            if w.endswith(s):
                return s
    return None


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else None
        if cut and _has_vowel(w[: -len(cut)]):
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in _TABLES:
        end = _end(w, ends)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _end(w, _ENDS4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: What a word ends in that a step may change: others are their own stems.
ENDS = "(?:s|ed|ing|y|e|ll|" + "|".join(sorted({*STEP2, *STEP3, *STEP4})) + ")$"
_stems: dict[str, str] = {}


def stems(words: pa.Array) -> pa.Array:
    """Of lower-case words, many of which come again and again."""
    some = pc.and_(pc.match_substring_regex(words, ENDS), pc.string_is_ascii(words))
    asked = listed(words.filter(some))
    if len(_stems) > 1 << 17:
        _stems.clear()
    get, found = _stems.get, []
    for w in asked:
        s = get(w)
        if s is None:
            _stems[w] = s = stem(w)
        found.append(s)
    return pc.replace_with_mask(words, some, pa.array(found, pa.string()))


@F.pandas_udf(StringType())
def porter_stem(terms: pd.Series) -> pd.Series:
    return terms.map(stem, na_action="ignore")
