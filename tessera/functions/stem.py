"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980, with its author's two later changes), and column functions over it."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", shape(stem)))


def ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def ends_short(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word of 3 to 64 characters; what is no vowel is a consonant."""
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif ends_double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and ends_short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = max((e for e in table if word.endswith(e)), key=len, default=None)
        if end and measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = max((e for e in STEP_4 if word.endswith(e)), key=len, default=None)
    if end and measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not ends_short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


#: Words of a batch that are stemmed at a time, about.
HELD = 500_000


def in_pieces(lists: pa.Array, most: int, tallied: bool) -> pa.Array:
    """Lists of words as lists of stems, or (tallied) of struct(term, tf), about ``most`` words at a time.

    Words stay Arrow's: only the distinct ones of a piece become Python's.
    """
    size = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        size[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
    out, counts = [], [np.zeros(1, np.int64)]
    for first, last in zip([0, *cuts], [*cuts, len(lists)], strict=True):
        words = lists.slice(first, last - first).flatten().dictionary_encode()
        stems = pa.array(map(stem, words.dictionary.to_pylist()), pa.string()).dictionary_encode()
        term, n = stems.indices.to_numpy()[words.indices.to_numpy()], size[first:last]
        if tallied:
            key, times = np.unique(np.repeat(np.arange(len(n)) << 32, n) | term, return_counts=True)
            term, n = key & 0xFFFFFFFF, np.bincount(key >> 32, minlength=len(n))
        items = stems.dictionary.take(pa.array(term))
        out.append(pa.StructArray.from_arrays([items, pa.array(times, pa.int32())], ["term", "tf"]) if tallied else items)
        counts.append(n)
    mask = lists.is_null() if lists.null_count and not tallied else None
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.concat_arrays(out), mask=mask)


def stemmed(words: Column) -> Column:
    """An array of words as an array of stems, in Arrow batches; each distinct word is stemmed once per worker."""
    most = HELD

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return in_pieces(lists, most, False)

    return run(words)


def plain_letters() -> tuple[str, str]:
    """Letters with marks up to U+1EFF, and the letters without them."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))]
    kept = [(c, b) for c, b in pairs if c != b]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


MARKED, BARE = plain_letters()


def folded(text: Column) -> Column:
    """Lower case, without marks on letters."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), MARKED, BARE)).otherwise(low)


def counted(words: Column) -> Column:
    """An array of words as array of struct(term, tf): stems and how often each occurs, in Arrow batches."""
    most = HELD

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def run(lists: pa.Array) -> pa.Array:
        return in_pieces(lists, most, True)

    return run(words)
