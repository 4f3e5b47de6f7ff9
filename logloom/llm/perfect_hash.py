"""A minimal perfect hash of whole numbers: every key has its own place among 0 to n - 1.

Keys are thrown into a bit row of twice their number; those that fall alone set their bit, the others go on to the
next row. A key's place is the number of set bits before its own. Other numbers also get a place, so that callers
compare the key that is kept there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from logloom.llm import text as X

#: Bits a key in each row.
ROOM = 2


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    salted = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + X.seeds(1, level + 1)[0]
    return (X.mix(salted) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """``rows[k]`` has, for each bit, the place of the key that set it, or -1; ``keys`` are the keys by place."""

    rows: tuple[np.ndarray, ...]
    keys: np.ndarray

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 for a number that is not a key."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, row in enumerate(self.rows):
            at = row[_spot(keys[left], level, len(row))]
            found = at >= 0
            out[left[found]] = at[found]
            left = left[~found]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def build(keys: np.ndarray) -> PerfectHash:
    """The hash of distinct ``keys``, the same whatever their order."""
    left, rows, placed, first = np.sort(np.asarray(keys, np.int64)), [], [], 0
    while len(left):
        spot = _spot(left, len(rows), ROOM * len(left))
        row = np.full(ROOM * len(left), -1, np.int32)
        alone = np.bincount(spot, minlength=len(row))[spot] == 1
        won = spot[alone]
        row[won] = 0
        bits = np.flatnonzero(row == 0)
        row[bits] = first + np.arange(len(bits), dtype=np.int32)
        placed.append(left[alone][np.argsort(won)])
        rows.append(row)
        first += len(bits)
        left = left[~alone]
    return PerfectHash(tuple(rows), np.concatenate(placed) if placed else np.zeros(0, np.int64))
