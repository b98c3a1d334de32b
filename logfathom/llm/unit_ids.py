"""Ids of units of text that tokenizers encode on their own, each encoded once while remembered."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

#: Bytes that a memory takes, about; what a unit takes beside its own bytes; and the most bytes of a
#: unit that is looked up again.
MOST_BYTES, UNIT_BYTES, LONGEST = 64 << 20, 160, 64

Encoder = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class UnitIds:
    """A memory of the ids that some encoders give to units.

    An encoder returns the ids of all units in a row, and how many each has. Memory is bounded in
    bytes: when it is full everything is forgotten. Long units are not looked up again.
    """

    def __init__(self, *encoders: Encoder) -> None:
        self.encoders = encoders
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.taken = self.count = 0
        self.ids = [np.zeros(0, np.uint16) for _ in self.encoders]
        self.sizes = [np.zeros(0, np.int64) for _ in self.encoders]

    def find(self, units: list[bytes]) -> np.ndarray:
        """The number of each unit, which holds until the next call."""
        if self.taken > MOST_BYTES:
            self.forget()
        at = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        missing = np.nonzero(at < 0)[0].tolist()
        if missing:
            new = list(dict.fromkeys(map(units.__getitem__, missing)))
            for i, encode in enumerate(self.encoders):
                ids, sizes = encode(new)
                self.ids[i] = np.concatenate([self.ids[i], ids]) if len(self.ids[i]) else ids
                self.sizes[i] = np.concatenate([self.sizes[i], sizes])
                self.taken += ids.nbytes + sizes.nbytes
            numbers = dict(zip(new, range(self.count, self.count + len(new))))
            self.count += len(new)
            at[missing] = np.fromiter(map(numbers.__getitem__, map(units.__getitem__, missing)), np.int64, len(missing))
            kept = {unit: number for unit, number in numbers.items() if len(unit) <= LONGEST}
            self.place.update(kept)
            self.taken += sum(map(len, kept)) + UNIT_BYTES * len(kept)
        return at

    def gather(self, at: np.ndarray, encoder: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered units in a row, and how many each has."""
        sizes = self.sizes[encoder]
        counts = sizes[at]
        ends = np.cumsum(counts)
        where = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - counts), counts)
        where += np.arange(len(where))
        return self.ids[encoder][where], counts


def in_order(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units taken in another order."""
    begins, own = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return ids[np.repeat(begins - (np.cumsum(own) - own), own) + np.arange(len(ids))], own
