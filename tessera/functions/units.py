"""Units of many texts: runs of letters, digits and hyphens of the lower-case
text, or of characters beyond ASCII.  Any kind of token lies in one unit, so what
is slow is done once for each distinct unit, and occurrences are arrays."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property, lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_INSIDE = _LETTER.copy()
_INSIDE[list(b"0123456789-")] = True
_INSIDE[128:] = True
_ASCII = re.compile("[a-z0-9]+")
#: Letters of old, which Java and Python know.
_LATIN = re.compile("[a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


@lru_cache(1 << 15)
def _in_word(c: str) -> bool:
    return category(c)[0] in "LN"


def words_in(unit: str, unknown: frozenset = frozenset()) -> list[str]:
    """Runs of letters and numbers; ``unknown`` ones are taken for neither."""
    if unit.isascii():
        return _ASCII.findall(unit)
    if _LATIN.fullmatch(unit):
        return [unit]
    return "".join([c if _in_word(c) and c not in unknown else " " for c in unit]).split()


def listed(a: pa.Array) -> list:
    """Strings or bytes as a list, which ``to_pylist`` makes one scalar after another."""
    return a.to_numpy(zero_copy_only=False).tolist()


def expand(first: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, so many times."""
    return np.repeat(first - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())


class Units:
    """``names``: distinct units; row, at (where it begins, in bytes of all texts) and
    number of the name of each, in order."""

    def __init__(self, texts: list[str]):
        lowered = pa.array([t.lower() + "\n" for t in texts], pa.string())
        self.offsets = np.frombuffer(lowered.buffers()[1], np.int32)[: len(texts) + 1]
        data = np.frombuffer(lowered.buffers()[2], np.uint8)[: self.offsets[-1]]
        inside = _INSIDE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0], edges]) if inside[0] else edges
        self.at, ends = edges[::2], edges[1::2]
        bounds = np.concatenate([[0], np.cumsum(ends - self.at)]).astype(np.int32)
        found = pc.dictionary_encode(pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds), pa.py_buffer(data[inside])))
        self.no, self.names = found.indices.to_numpy(), found.dictionary
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.at, self.offsets)))
        # those that are letters from a to z alone
        bounds = np.frombuffer(self.names.buffers()[1], np.int32)[: len(self.names) + 1]
        odd = np.concatenate([[0], np.cumsum(~_LETTER[np.frombuffer(self.names.buffers()[2], np.uint8)[: bounds[-1]]])])[bounds] if len(self.names) else bounds
        self.plain, self.size = odd[1:] == odd[:-1], np.diff(bounds)

    @cached_property
    def odd(self) -> list[tuple[int, str]]:
        """Number and name of units that aren't plain."""
        at = np.flatnonzero(~self.plain)
        return [*zip(at.tolist(), listed(self.names.take(pa.array(at))), strict=True)]

    def tokens(self, split: Callable[[str], list[str]], kept: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Names of tokens; number of the name, row and place of each token, in
        order.  Plain units are one token if ``kept``, others are split."""
        lists = [split(x) for _, x in self.odd]
        flat = pa.array([w for ws in lists for w in ws], pa.string())
        known = pc.index_in(flat, value_set=self.names).to_numpy(zero_copy_only=False)
        more = pc.dictionary_encode(flat.filter(pa.array(np.isnan(known)))) if len(flat) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.string()))
        ids = np.zeros(len(flat), np.int64)
        new = np.isnan(known) if len(flat) else np.zeros(0, bool)
        ids[~new], ids[new] = known[~new], more.indices.to_numpy() + len(self.names)
        counts = (kept & self.plain).astype(np.int64)
        counts[[i for i, _ in self.odd]] = [*map(len, lists)]
        first = np.cumsum(counts) - counts
        flat_ids = np.repeat(np.arange(len(counts)), counts)
        odd = np.array([i for i, _ in self.odd], np.int64)
        flat_ids[expand(first[odd], counts[odd])] = ids
        reps = counts[self.no]
        names = pa.concat_arrays([self.names, more.dictionary])
        return names, flat_ids[expand(first[self.no], reps)], np.repeat(self.row, reps), np.repeat(self.at, reps)

    def terms(self, name: Callable[[pa.Array], pa.Array], unknown: frozenset) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Full-text terms, some more than once; row and number of each occurrence.
        ``name`` makes terms of words."""
        lists = [words_in(x, unknown) for _, x in self.odd]
        flat = pa.array([w for ws in lists for w in ws], pa.string())
        counts = self.plain.astype(np.int64)
        odd = np.array([i for i, _ in self.odd], np.int64)
        counts[odd] = [*map(len, lists)]
        first = np.cumsum(counts) - counts
        ids, plain = np.zeros(counts.sum(), np.int64), np.flatnonzero(self.plain)
        ids[first[plain]] = np.arange(len(plain))
        ids[expand(first[odd], counts[odd])] = len(plain) + np.arange(len(flat))
        reps = counts[self.no]
        return name(pa.concat_arrays([self.names.take(pa.array(plain)), flat])), np.repeat(self.row, reps), ids[expand(first[self.no], reps)]
