"""Order of the suffixes of many groups of strings at a time, by deep-shallow sorting.

Only suffixes that can be equal are ordered: those of one group that lie at the same
distance before its anchor. Bytes beyond ``LENGTH`` do not count.

Shallow: multikey quicksort whose characters are words of eight bytes, down to ``SHALLOW``
bytes. Each pass parts all sets by their next word; a suffix alone in its set has its place.

Deep: what still agrees mostly agrees for long, so each remaining set is ordered by its
blind trie. A node of it knows only a depth and, per branch, the byte there. The tries are
built from the top, those of all sets together: the first suffix of a set is its trie's
spine, and each other suffix is compared with the spine once, which gives the node at which
it leaves and its branch. The suffixes of one branch are a set with a trie of its own below.
Read from left to right the branches of a spine are those with a smaller byte from the top
down, the suffixes equal to the spine, and those with a larger byte from the bottom up.
"""

from __future__ import annotations

import numpy as np

from tasktrail.llm.anchors import LENGTH

WORD = 8
SHALLOW = 16
SMALLER, EQUAL, LARGER = 0, 1, 2


def _lead(differing: np.ndarray) -> np.ndarray:
    """The first byte at which two words differ, from their exclusive or (not zero)."""
    high = np.zeros(len(differing), np.int64)
    for shift in (32, 16, 8):
        upper = (differing >> np.uint64(shift)) != 0
        high[upper] += shift
        differing = np.where(upper, differing >> np.uint64(shift), differing)
    return WORD - 1 - high // 8


def _new(sets: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a set begins, parted further by the keys; all are sorted."""
    new = np.ones(len(sets), bool)
    if len(sets) > 1:
        new[1:] = sets[1:] != sets[:-1]
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def _several(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each suffix, and whether it has others beside it."""
    sets = np.cumsum(new) - 1
    return sets, np.bincount(sets, minlength=1)[sets] > 1 if len(sets) else new


class Suffixes:
    """Suffixes of a run of bytes; ``places`` are their first bytes.

    At least ``LENGTH`` bytes follow each place.
    """

    def __init__(self, data: bytes, places: np.ndarray):
        padded = data + bytes(WORD)
        self.bytes = np.frombuffer(padded, np.uint8)
        self.words = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
        self.places = places

    def _word(self, suffixes: np.ndarray, depth: int) -> np.ndarray:
        return self.words[self.places[suffixes] + depth].astype(np.uint64)

    def _shared(self, suffixes: np.ndarray, spine: np.ndarray) -> np.ndarray:
        """The depth at which each suffix leaves its spine, LENGTH if it does not."""
        shared = np.full(len(suffixes), LENGTH)
        open_ = np.flatnonzero(suffixes != spine)
        for at in range(SHALLOW, LENGTH, WORD):
            if not len(open_):
                break
            differing = self._word(suffixes[open_], at) ^ self._word(spine[open_], at)
            parted = differing != 0
            shared[open_[parted]] = np.minimum(at + _lead(differing[parted]), LENGTH)
            open_ = open_[~parted]
        return shared

    def order(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes by set and first LENGTH bytes, and what each shares with the one before.

        The first of a set shares -1. Equal suffixes stay in the order of their numbers
        or not; nothing depends on it.
        """
        ordered = np.argsort(sets, kind="stable")
        common = np.full(len(ordered), LENGTH, np.int16)
        new = _new(sets[ordered])
        common[new] = -1
        # Sets lie one after the other; a set keeps its places while it is parted.
        own, several = _several(new)
        at, own = np.flatnonzero(several), own[several]
        for depth in range(0, SHALLOW, WORD):
            words = self._word(ordered[at], depth)
            by = np.lexsort((words, own))
            ordered[at], words = ordered[at[by]], words[by]
            new = _new(own, words)
            leaves = np.flatnonzero(new[1:] & (own[1:] == own[:-1])) + 1
            common[at[leaves]] = depth + _lead(words[leaves] ^ words[leaves - 1])
            own, several = _several(new)
            at, own = at[several], own[several]
        while len(at):
            at, own = self._part_by_tries(ordered, common, at, own)
        return ordered, common

    def _part_by_tries(
        self, ordered: np.ndarray, common: np.ndarray, at: np.ndarray, own: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """One node level of all tries: places and sets of the branches with several suffixes."""
        suffixes = ordered[at]
        starts = np.flatnonzero(_new(own))
        spine = np.repeat(suffixes[starts], np.diff(np.append(starts, len(own))))
        shared = self._shared(suffixes, spine)
        byte = self.bytes[self.places[suffixes] + shared].astype(np.int64)
        equal = shared == LENGTH
        smaller = ~equal & (byte < self.bytes[self.places[spine] + shared])
        side = np.where(equal, EQUAL, np.where(smaller, SMALLER, LARGER))
        down = np.where(smaller, shared, LENGTH - shared)
        branch = (side * (LENGTH + 1) + down) << 8 | np.where(equal, 0, byte)
        by = np.lexsort((branch, own))
        ordered[at], branch, shared = suffixes[by], branch[by], shared[by]
        new = _new(own, branch)
        leaves = np.flatnonzero(new[1:] & (own[1:] == own[:-1])) + 1
        common[at[leaves]] = np.minimum(shared[leaves - 1], shared[leaves])
        own, several = _several(new)
        several &= shared < LENGTH
        return at[several], own[several]

    def repeated(self, sets: np.ndarray) -> np.ndarray:
        """Whether a neighbour in the order of the same set has the same first LENGTH bytes."""
        ordered, common = self.order(sets)
        with_last = common == LENGTH
        either = with_last.copy()
        either[:-1] |= with_last[1:]
        found = np.zeros(len(self.places), bool)
        found[ordered[either]] = True
        return found
