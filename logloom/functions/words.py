"""Words for full-text search: folding, stemming, and postings of whole Arrow batches.

The text is cut into words by the JVM. Python sees every distinct word of a batch once; the
rest is array work, so no Python runs per row and no vocabulary is shuffled or broadcast.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Combining marks that belong to a word without counting as part of it.
_MARKS = ("\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b"
          "\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331")
# Letters run without a look at the marks, which are rare: one class with all of them takes the JVM longer.
_LETTERS = r"[\p{L}\p{N}\p{Co}]"
WORD = rf"{_LETTERS}+(?:[{_MARKS}]+{_LETTERS}*)*"

# The suffix rules of the published stemming algorithm (M. F. Porter, 1980), with its
# author's later bli and logi rules.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
          ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
          ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize"]
# Only words of 3 to 64 bytes are stemmed.
_MIN_BYTES, _MAX_BYTES = 3, 64


_KIND = {ord(ch): "v" if ch in "aeiou" else "y" if ch == "y" else "c" for ch in map(chr, range(128))}
_SYLLABLE = re.compile("v+c+")


def _shape(word: str) -> str:
    """The word as ``v`` and ``c``: y is a vowel after a consonant."""
    kinds = word.translate(_KIND) if word.isascii() else "".join(_KIND.get(ord(ch), "c") for ch in word)
    if "y" not in kinds:
        return kinds
    out = []
    for kind in kinds:
        out.append(kind if kind != "y" else "v" if out and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_SYLLABLE.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest_first(suffixes) -> tuple[str, ...]:
    return tuple(sorted(suffixes, key=len, reverse=True))


_NEW2, _NEW3 = dict(_STEP2), dict(_STEP3)
_ENDS2, _ENDS3, _ENDS4 = _longest_first(_NEW2), _longest_first(_NEW3), _longest_first(_STEP4)
# What a word that any step changes ends in; that step 1 leaves such an ending behind needs one of its own first.
_ENDS = ("s", "ed", "ing", "y", "e", "ll", *sorted({x for x in (*_NEW2, *_NEW3, *_STEP4) if x[-1] not in "sye"}))


def _ending(word: str, ends: tuple[str, ...]) -> str:
    """The longest of the endings the word has more than, or nothing."""
    if word.endswith(ends):
        for suffix in ends:
            if word.endswith(suffix) and len(word) > len(suffix):
                return suffix
    return ""


def _replace(word: str, ends: tuple[str, ...], new: dict[str, str]) -> str:
    suffix = _ending(word, ends)
    if suffix and _measure(word[:-len(suffix)]) > 0:
        return word[:-len(suffix)] + new[suffix]
    return word


def _past_and_progressive(word: str) -> str:
    if word.endswith("eed") and len(word) > 3:
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[:-len(suffix)]
        if word.endswith(suffix) and _has_vowel(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


def porter(word: str) -> str:
    """The stem of a folded word."""
    if not word.endswith(_ENDS):
        return word
    if not _MIN_BYTES <= len(word.encode()) <= _MAX_BYTES:
        return word
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past_and_progressive(word)
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _ENDS2, _NEW2)
    word = _replace(word, _ENDS3, _NEW3)
    suffix = _ending(word, _ENDS4)
    if suffix:
        stem = word[:-len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


class _Memo(dict):
    """A dict that fills itself; it travels to a task empty and is bounded there."""

    limit = 200_000

    def __reduce__(self):
        return type(self), ()

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class _Folding(_Memo):
    """Character to its folded form."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch in _MARKS:
            return self.keep(code, "")
        ch = next((form for form in (ch.casefold(), ch.lower()) if len(form) == 1), ch)
        parts = unicodedata.normalize("NFD", ch)
        return self.keep(code, parts[0] if len(parts) == 2 and parts[0].isascii() else ch)


_FOLDING = _Folding()


def fold(word: str) -> str:
    """Lower case without combining marks; an accented Latin letter becomes its base letter."""
    return word.lower() if word.isascii() else word.translate(_FOLDING)


class _Terms(_Memo):
    """Word as written to its term."""

    def __missing__(self, word: str) -> str:
        folded = fold(word)
        # most words have no ending to take off; they need no memory
        return self.keep(word, porter(folded)) if folded.endswith(_ENDS) else folded


_TERMS = _Terms()


def term(word: str) -> str:
    return _TERMS[word]


def words(text: Column) -> Column:
    """All words of a text in order, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _asked_for(words: list[str], asked: tuple[tuple[str, bool], ...]) -> np.ndarray:
    """Which words have one of the terms. A stem begins as its word does, so that others need not be stemmed."""
    exact = {t for t, prefix in asked if not prefix}
    begins = tuple(t for t, prefix in asked if prefix)
    first = {c for t, _ in asked for c in (t[0], t[0].upper())}
    return np.array([(w[0] in first or w[0] > "\x7f") and ((t := term(w)) in exact or t.startswith(begins)) for w in words], bool)


def _postings(batch: pa.Array, asked: tuple[tuple[str, bool], ...] | None = None) -> pa.Array:
    n = len(batch)
    lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    row = np.repeat(np.arange(n), lengths)
    pos = np.arange(starts[-1]) - starts[row] if starts[-1] else np.empty(0, np.int64)
    coded = batch.flatten().dictionary_encode()
    listed, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if asked is not None:
        kept = _asked_for(listed, asked)
        listed = [w for w, keep in zip(listed, kept.tolist()) if keep]
        held = np.flatnonzero(kept[index])
        row, pos, index = row[held], pos[held], (np.cumsum(kept) - 1)[index[held]]
    stems = pa.array([term(w) for w in listed], pa.string()).dictionary_encode()
    sort = pc.sort_indices(stems.dictionary)
    terms = stems.dictionary.take(sort)
    place = np.empty(len(terms), np.int64)
    place[sort.to_numpy()] = np.arange(len(terms))
    code = place[stems.indices.to_numpy(zero_copy_only=False)][index]

    order = np.argsort(row * max(len(terms), 1) + code, kind="stable")  # words arrive by row and position
    row, code, pos = row[order], code[order], pos[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    group = np.flatnonzero(first)
    positions = pa.ListArray.from_arrays(pa.array(np.append(group, len(row)), pa.int32()), pa.array(pos, pa.int32()))
    names = terms.take(pa.array(code[group]))
    entries = pa.StructArray.from_arrays([names, positions], ["term", "positions"])
    offsets = np.searchsorted(row[group], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


# The postings function travels with its helpers, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_POSTINGS = T.ArrayType(T.StructType([
    T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def postings(listed: Column | str, asked: Sequence[tuple[str, bool]] | None = None) -> Column:
    """Word lists to their terms (sorted) with the positions of each; of ``asked``, only those (term, or its beginning if True)."""
    wanted = None if asked is None else tuple(asked)

    def run(batch: pa.Array) -> pa.Array:
        return _postings(batch, wanted)

    return F.arrow_udf(run, _POSTINGS)(listed)
