"""Pieces of text and their token ids, encoded once per worker.

Real text repeats its words, so a batch is turned into piece numbers, only pieces not seen
before are encoded (all at once), and the ids of whole texts are gathered from a flat array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from .common import gather

#: Pieces a worker keeps; beyond that it starts anew after the batch at hand.
PIECES = 1_000_000


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, piece) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class Lexicon:
    """``encode`` turns a list of pieces into (flat ids, ids per piece)."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = PIECES):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(0, dtype=np.uint32)
        self.lengths = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)

    def ids(self, texts: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (each a list of pieces), and where each text ends among them."""
        if len(self.numbers) > self.limit:
            self._clear()
        number = self.numbers.__getitem__
        runs = [np.fromiter(map(number, pieces), dtype=np.int32, count=len(pieces)) for pieces in texts]
        self._learn()
        at = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int32)
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        stops = ends[np.cumsum([len(r) for r in runs], dtype=np.int64)] if runs else np.zeros(0, dtype=np.int64)
        return gather(self.flat, self.starts[at], lengths), stops

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        flat, lengths = self.encode(fresh)
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])[:-1]
