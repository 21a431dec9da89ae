"""CRC-32 of many byte spans at once.

A CRC is linear over bits: the CRC of a span is a constant of its length XORed with one
contribution per byte, which depends on the byte and its distance from the span's end
alone.  The contributions are a table of distance by byte, gathered for all spans and
folded with one `bitwise_xor.reduceat`.  Spans longer than the table are cut into blocks
of its size, counted from the end; neighbouring blocks are folded two by two, the left
one moved on by the length of the right, until each span has one value."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected CRC-32 polynomial of zlib, PNG and Ethernet.
POLYNOMIAL = 0xEDB88320
#: Distances in the table: 64 KB of it stay in a core's cache.
REACH = 64
ONES = np.uint32(0xFFFFFFFF)
#: Bytes that are folded in one go.
PORTION = 1 << 20


@lru_cache(maxsize=1)
def position_table() -> np.ndarray:
    """[distance from the end, byte] -> contribution of the byte."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    table = np.zeros((REACH, 256), np.uint32)
    table[0] = byte
    for d in range(1, REACH):
        table[d] = (table[d - 1] >> 8) ^ byte[table[d - 1] & 0xFF]
    return table


@lru_cache(maxsize=128)
def _moves(power: int) -> np.ndarray:
    """Four tables of 256: a CRC state moved on by 2 ** power zero bytes, by its bytes."""
    if power == 0:
        byte = position_table()[0]
        out = np.zeros((4, 256), np.uint32)
        for k in range(4):
            state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            out[k] = (state >> np.uint32(8)) ^ byte[state & 0xFF]
        return out
    half = _moves(power - 1)
    return np.stack([_move(half[k], power - 1) for k in range(4)])


def _move(state: np.ndarray, power: int) -> np.ndarray:
    t = _moves(power)
    return t[0][state & 0xFF] ^ t[1][(state >> 8) & 0xFF] ^ t[2][(state >> 16) & 0xFF] ^ t[3][state >> 24]


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC of a span of zero bytes of each length."""
    lengths = np.asarray(lengths, np.int64)
    out = np.full(len(lengths), ONES, np.uint32)
    power, left = 0, lengths.copy()
    while left.any():
        out = np.where(left & 1, _move(out, power), out).astype(np.uint32)
        left >>= 1
        power += 1
    return out ^ ONES


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The contributions of spans of 1 to REACH bytes, folded."""
    table = position_table().reshape(-1)
    out = np.zeros(len(starts), np.uint32)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        base = ends[at] - lengths[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + PORTION, side="right")))
        n, first = lengths[at:stop], ends[at:stop] - lengths[at:stop] - base
        i = np.arange(int(n.sum()))
        start = np.repeat(starts[at:stop] - first, n)
        distance = np.repeat(first + n - 1, n) - i
        out[at:stop] = np.bitwise_xor.reduceat(table[distance * 256 + data[start + i]], first)
        at = stop
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of data[start:end] for every span, as zlib gives it."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - np.asarray(starts, np.int64)
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= REACH))
    if len(short):
        out[short] = _folded(data, starts[short], lengths[short])
    long = np.flatnonzero(lengths > REACH)
    if len(long):
        out[long] = _blocks(data, starts[long], lengths[long])
    kinds, which = np.unique(lengths, return_inverse=True)
    return out ^ length_constants(kinds)[which]


def _blocks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Spans of any length: blocks of REACH bytes from the end, then a tree."""
    count = -(-lengths // REACH)
    span = np.repeat(np.arange(len(starts)), count)
    # the number of blocks between a block and the end of its span, falling to 0
    after = np.repeat(np.cumsum(count) - 1, count) - np.arange(len(span))
    stop = np.repeat(starts + lengths, count) - after * REACH
    begin = np.maximum(stop - REACH, np.repeat(starts, count))
    state = _folded(data, begin, stop - begin)
    power = REACH.bit_length() - 1
    while len(state) > len(starts):
        state = np.where(after & 1, _move(state, power), state).astype(np.uint32)
        after >>= 1
        first = np.ones(len(state), bool)
        first[1:] = (span[1:] != span[:-1]) | (after[1:] != after[:-1])
        at = np.flatnonzero(first)
        state, span, after, power = np.bitwise_xor.reduceat(state, at), span[at], after[at], power + 1
    return state
