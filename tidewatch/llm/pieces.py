"""Encoding of texts by their distinct pieces."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Distinct pieces a worker keeps, and the longest kept (characters); the store is emptied when it is full.
KEEP, LONGEST = 400_000, 128


class PieceCache:
    """Ids of pieces (each as little-endian uint16 bytes), computed once per distinct piece while they fit.

    `ids` maps a list of distinct pieces to their ids; `join` the pieces of texts to the texts' ids.
    """

    def __init__(self, ids: Callable[[list[str]], list], keep: int = KEEP):
        self.ids, self.keep, self.store = ids, keep, {}

    def join(self, cut: list[list[str]]) -> list[bytes]:
        new = set()
        for pieces in cut:
            new.update(pieces)
        if len(self.store) > self.keep:
            self.store.clear()
        new = list(new.difference(self.store))
        if new:
            flat = self.ids(new)
            self.store.update(zip(new, [np.asarray(x, "<u2").tobytes() if not isinstance(x, bytes) else x for x in flat]))
        get = self.store.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        for piece in new:
            if len(piece) > LONGEST:
                del self.store[piece]
        return out
