"""CRC-32C (Castagnoli) of many byte ranges at once, and its masked form.

The ranges of a buffer are cut into pieces of ``LANE`` 16-bit words; all pieces
advance in step, one table lookup a word, and a range's pieces are then joined
by the linear map that advances a checksum over one piece of zeros.  Ranges
begin and end at even bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LANE = 128
_POLYNOMIAL = np.uint32(0x82F63B78)
_ONES = np.uint32(0xFFFFFFFF)
#: fixed value: what the masked form adds after turning the checksum by 15 bits
_MASK_DELTA = np.uint32(0xA282EAD8)


@cache
def _step() -> np.ndarray:
    """The checksum of each 16-bit word after a zero checksum."""
    c = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        c = np.where(c & 1, (c >> 1) ^ _POLYNOMIAL, c >> 1).astype(np.uint32)
    return c


@cache
def _skip() -> tuple[np.ndarray, np.ndarray]:
    """Advance over ``LANE`` zero words, by low and high half of the checksum."""
    t = _step()
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(LANE):
        bits = t[bits & 0xFFFF] ^ (bits >> 16)
    halves = []
    for half in (bits[:16], bits[16:]):
        v = np.zeros(1, np.uint32)
        for b in half:
            v = np.concatenate([v, v ^ b])
        halves.append(v)
    return halves[0], halves[1]


def crc32c(words: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Checksums of the ranges of ``count`` (two at least) 16-bit words from ``start``."""
    if len(start) == 0:
        return np.zeros(0, np.uint32)
    pieces = -(-count // LANE)
    pad = pieces * LANE - count
    first = np.cumsum(pieces) - pieces
    rec = np.repeat(np.arange(len(start)), pieces)
    base = (start - pad)[rec] + (np.arange(len(rec)) - first[rec]) * LANE
    lanes = words[np.maximum(base[:, None] + np.arange(LANE), 0)]
    lanes[first] = np.where(np.arange(LANE) < pad[:, None], np.uint16(0), lanes[first])
    # a checksum starts with ones, which is the same as inverting the first 32 bits
    flat = lanes.reshape(-1)
    for k in (0, 1):
        flat[first * LANE + pad + k] ^= np.uint16(0xFFFF)
    lanes = np.ascontiguousarray(lanes.T)
    t = _step()
    c = np.zeros(len(rec), np.uint32)
    for row in lanes:
        c = t[(c ^ row) & 0xFFFF] ^ (c >> 16)
    low, high = _skip()
    order = np.argsort(-pieces, kind="stable")
    live = np.searchsorted(-pieces[order], -np.arange(1, pieces.max() + 1), "right")
    out = np.zeros(len(start), np.uint32)
    for k, n in enumerate(live.tolist()):
        r = order[:n]
        a = out[r]
        out[r] = low[a & 0xFFFF] ^ high[a >> 16] ^ c[first[r] + k]
    return out ^ _ONES


def masked(crc: np.ndarray) -> np.ndarray:
    """The stored form: turned by 15 bits plus a constant, so that a checksum
    of bytes that hold checksums stays good."""
    return ((crc >> 15) | (crc << 17)) + _MASK_DELTA
