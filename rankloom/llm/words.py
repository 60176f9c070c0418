"""Ids of the words of texts: each different word is encoded once while it is known, all new ones of a batch together."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Sequence
from itertools import chain, count, islice

import numpy as np

# Characters or bytes of different words after which a worker begins anew, as after the words it may know.
KNOWN_LENGTH = 16 << 20
Encode = Callable[[list], tuple[np.ndarray, np.ndarray]]


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first``, one after the other."""
    ends = np.cumsum(size)
    at = np.repeat(first - (ends - size), size)
    at += np.arange(len(at))
    return flat[at]


class WordIds:
    """``encode`` gives the ids of a list of different words, one after the other, and how many each word has.

    Above ``most`` words a worker begins anew, so that what it holds is bounded."""

    def __init__(self, encode: Encode, most: int):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.place: defaultdict[Hashable, int] = defaultdict(count().__next__)
        self.flat, self.used, self.held = np.empty(1 << 20, np.int32), 0, 0
        self.first, self.size = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)

    def _keep(self, before: int) -> None:
        words = list(islice(reversed(self.place), len(self.place) - before))[::-1]
        ids, size = self.encode(words)
        used, known = self.used + len(ids), before + len(words)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), used - self.used), np.int32)])
        if known > len(self.first):
            more = max(len(self.first), known - before)
            self.first, self.size = (np.concatenate([a[:before], np.empty(more, a.dtype)]) for a in (self.first, self.size))
        self.flat[self.used : used] = ids
        self.first[before:known], self.size[before:known] = self.used + np.cumsum(size) - size, size
        self.used, self.held = used, self.held + sum(map(len, words))

    def each(self, words: list[Hashable]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        if len(self.place) > self.most or self.held > KNOWN_LENGTH:
            self._clear()
        before = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if len(self.place) > before:
            try:
                self._keep(before)
            except BaseException:
                self._clear()
                raise
        return gathered(self.flat, self.first[at], self.size[at]), self.size[at]

    def ids(self, texts: Sequence[Sequence[Hashable]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of all texts, and how many each text has."""
        ids, size = self.each(list(chain.from_iterable(texts)))
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return ids, np.diff(upto[np.cumsum([0, *map(len, texts)])])
