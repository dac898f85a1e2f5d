"""Anchors: the places by which equal long strings of different texts find each other.

Of the grams of ``GRAM`` bytes inside a string of ``LENGTH`` bytes, the one with the smallest hash
is its anchor; equal strings have equal anchors at the same place. Neighbouring strings
mostly share an anchor, so a run of starts with one anchor is one row, about one for
every 85 bytes of text. All hashes come from one cumulative sum per block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH = 200
GRAM = 32
# Texts of a block are worked on together; longer texts are taken in overlapping parts.
BLOCK_BYTES = 1 << 20
PLACE_BITS = 22

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo two to the 64."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS[:] = [
            np.concatenate(
                [np.ones(1, np.uint64), np.full(size, base & (2**64 - 1), np.uint64)]
            ).cumprod(dtype=np.uint64)
            for base in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _POWERS[0], _POWERS[1]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)))


class Hashes:
    """Hashes of all substrings of a run of bytes."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _powers(len(data) + 1)
        terms = _BYTES[data] * powers[: len(data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def grams(self, size: int) -> np.ndarray:
        """Of every substring of one size."""
        raw = self.sums[size:] - self.sums[:-size]
        return _mixed(raw * self.inverse[: len(raw)])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        raw = (self.sums[high] - self.sums[low]) * self.inverse[low]
        return _mixed(_mixed(raw) + (high - low).astype(np.uint64))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def blocks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Blocks of whole texts: their numbers, where each part begins in its text, bytes, edges."""
    numbers: list[int] = []
    offsets: list[int] = []
    parts: list[bytes] = []
    held = 0
    for number, text in enumerate(texts):
        step = BLOCK_BYTES
        for offset in range(0, max(1, len(text)), step):
            part = text[offset : offset + step + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            numbers.append(number)
            offsets.append(offset)
            parts.append(part)
            held += len(part)
            if held >= BLOCK_BYTES:
                yield numbers, offsets, b"".join(parts), _edges(parts)
                numbers, offsets, parts, held = [], [], [], 0
    if parts:
        yield numbers, offsets, b"".join(parts), _edges(parts)


def _edges(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(part) for part in parts])])


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block: text number, anchor hash, hash of the run's bytes, first start, starts, anchor place.

    ``first start`` is counted within the text; a run of s starts covers s + LENGTH - 1 bytes.
    The anchor's place is counted from the first start.
    """
    for numbers, offsets, joined, edges in blocks(texts):
        data = np.frombuffer(joined, np.uint8)
        hashes = Hashes(data)
        grams = hashes.grams(GRAM)
        place = np.uint64((1 << PLACE_BITS) - 1)
        order = (_mixed(grams) & ~place) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_minimum(order, LENGTH - GRAM + 1) & place).astype(np.int64)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[edges[:-1]] += 1
        inside[edges[1:] - LENGTH + 1] -= 1
        starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8)[: len(anchor)])
        anchor = anchor[starts]
        new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(anchor) != 0)])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        low = starts[first]
        part = np.searchsorted(edges, low, "right") - 1
        yield (
            np.asarray(numbers)[part],
            grams[anchor[first]].view(np.int64),
            hashes.of(low, low + count + (LENGTH - 1)).view(np.int64),
            low - edges[part] + np.asarray(offsets)[part],
            count,
            anchor[first] - low,
        )
