"""Bit-sliced Hamming comparison of many fingerprints at once.

Fingerprints lie in vertical bit planes: word w of plane b holds bit b of 64 of them, one in each lane. A block is one
query and one word. For all blocks together, each plane is XORed with the query's bit and added to carry-save counters;
counters start at ``2**k - 1 - radius``, so that a lane's carry out of the last one means that it is beyond the radius,
which a sticky mask keeps. After every few planes the blocks all of whose lanes are beyond are abandoned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints that are turned into planes at a time, a multiple of 64.
PIECE = 1 << 12


@dataclass
class Work:
    """What comparisons did: blocks begun, blocks abandoned before the last plane, and planes added to blocks."""

    begun: int = 0
    abandoned: int = 0
    planes: int = 0


def planes_of(marks: np.ndarray) -> np.ndarray:
    """(n, words) fingerprints of words * 64 bits as (bits, lanes / 64) planes; lanes are filled up with zeros."""
    n, width = marks.shape
    planes = np.zeros((width * 64, -(-n // 64) * 8), np.uint8)
    for at in range(0, n, PIECE):  # as bits take eight times the bytes
        rows = np.ascontiguousarray(marks[at : at + PIECE], "<u8")
        bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), width * 8), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        planes[:, at // 8 : at // 8 + packed.shape[1]] = packed
    return planes.view("<u8")


def later(word: np.ndarray, lane: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Masks of the lanes of a word that lie after ``lane`` and before ``last`` (numbers over all words)."""
    low = np.clip(lane + 1 - 64 * word, 0, 64).astype(np.uint64)
    high = np.clip(last - 64 * word, 0, 64).astype(np.uint64)
    below = lambda n: np.where(n >= 64, FULL, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))
    return below(high) & ~below(low)


def hits(planes: np.ndarray, queries: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: np.ndarray, step: int = 8, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(block, lane in its word) of the lanes asked for within their block's radius.

    queries: (blocks, words) fingerprints; word: the planes' word of each block; lanes: a mask for each block.
    """
    work = work or Work()
    bits = len(planes)
    block = np.nonzero(lanes)[0]
    work.begun += len(block)
    if not len(block):
        return block, block
    k = max(1, int(radius.max()).bit_length())
    start = np.minimum((1 << k) - 1 - radius[block], (1 << k) - 1).astype(np.uint64)
    counters = [np.where((start >> np.uint64(c)) & np.uint64(1) != 0, FULL, np.uint64(0)) for c in range(k)]
    over, at, asked = ~lanes[block], word[block], queries[block]
    for first in range(0, bits, step):
        if first:
            alive = over != FULL
            n = np.count_nonzero(alive)
            work.abandoned += len(alive) - n
            if not n:
                return block[:0], block[:0]
            if n < len(alive):
                block, over, at, asked = block[alive], over[alive], at[alive], asked[alive]
                counters = [c[alive] for c in counters]
        for b in range(first, min(bits, first + step)):
            bit = (asked[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)
            carry = planes[b][at] ^ (np.uint64(0) - bit)
            for c in counters:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
        work.planes += step * len(block)
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(near)
    return block[row], lane


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its component) after the pairs (a, b) are joined."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def lightest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the pairs (a, b) of a spanning forest of n nodes with the least weights (Boruvka's rounds)."""
    label, chosen, left = np.arange(n), [np.zeros(0, np.int64)], np.arange(len(a))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            break
        rank = weight[left].astype(np.int64) * len(a) + left
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        picked = np.unique(best[best < np.iinfo(np.int64).max]) % len(a)
        chosen.append(picked)
        label = forest(label, a[picked], b[picked])
    return np.concatenate(chosen)
