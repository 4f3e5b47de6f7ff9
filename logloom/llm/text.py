"""Whole texts as byte arrays: the blocks that array work inside a task runs on.

An Arrow batch of texts is cut into blocks of whole documents, so that temporary arrays stay small
whatever the batch holds; a document larger than a block is a block of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

#: Words longer than this are hashed one by one.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _A + np.uint64(seed))


@dataclass
class Block:
    """Documents ``lo`` to ``hi`` of a batch; ``data[offsets[i]:offsets[i + 1]]`` are the bytes of one."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


#: Returns free memory of the C library to the system; only some libraries have it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hand_back() -> None:
    """Gives free memory back to the system: Python workers live on, and so would what they held."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, docs: int = 1 << 30) -> Iterator[Block]:
    """The texts of one Arrow column (null is empty), without copying them; at most ``docs`` in a block."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, index, raw = column.buffers()
    offsets = np.frombuffer(index, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + docs)
        yield Block(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi
    hand_back()


@dataclass
class Words:
    """Words of a block in order: byte ``start`` and ``end``, 64-bit ``hash``; ``first[i]`` is the first word of document i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def byte_table(keep: np.ndarray, lower: bool = True) -> np.ndarray:
    """For each byte what it counts as, 0 for separators. NUL, if it is kept, counts as byte 0xFF, which UTF-8 never has."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 0x20
    if keep[0]:
        table[0] = 0xFF
    table[~keep] = 0
    return table


_all = np.arange(256)
#: Digits, letters a-z in either case, and every character beyond ASCII.
ALNUM = byte_table(((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x41) & (_all <= 0x5A))
                   | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80))
#: Everything but ASCII white space.
SOLID = byte_table(~((_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D))))


def words(block: Block, table: np.ndarray) -> Words:
    """The words of every document of a block, hashed by their mapped bytes. Words never cross documents."""
    n = len(block.data)
    data = np.zeros(n + 8, np.uint8)
    data[:n] = table[block.data]
    solid = data[:n] != 0
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = solid
    after = np.zeros(n + 1, bool)
    after[:n] = solid
    start = np.flatnonzero(after & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~after))
    first = np.searchsorted(start, block.offsets)
    del solid, edge, before, after
    return Words(start, end, _hash(data, start, end), first)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step; ``data`` has eight bytes to spare."""
    size = end - start
    out = mix(size.astype(np.uint64) * _A)
    eights = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (max(len(data) - 7, 0),), (1,))
    live, at = np.arange(len(start)), start
    left = size
    longest = size > LONG_WORD
    if longest.any():
        live = np.flatnonzero(~longest)
        at, left = start[live], size[live]
    while len(live):
        part = eights[at]
        short = np.minimum(left, 8).astype(np.uint64)
        part = part & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - short) * np.uint64(8)))
        out[live] = mix((out[live] ^ part) * _A + np.uint64(1))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(longest):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def chains(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` consecutive entries, in order; entry i covers i to i + n - 1."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mix(out * _A + hashes[k:k + count])
    return out


def binary_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of ``flat[bounds[i]:bounds[i + 1]]``."""
    offsets = (np.asarray(bounds, np.int64) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
