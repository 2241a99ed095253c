"""All pieces of a vocabulary in many short strings at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PRIME = np.uint64(0x100000001B3)
#: Bits of the slots that lead from a hash to its piece; MANY: several pieces have the slot.
SLOT_BITS, NONE, MANY = 20, -1, -2


class PieceTable:
    """Pieces by length, as sorted hashes with their characters, and a slot for each hash."""

    def __init__(self, numbers: dict[str, int], longest: int):
        self.longest = longest
        self.tables = {}
        self.slots = np.full(1 << SLOT_BITS, NONE, np.int32)  # the place of a piece in the table of its length
        for k in range(1, longest + 1):
            own = sorted(p for p in numbers if len(p) == k)
            if own:
                chars = np.array(own, f"U{k}").view(np.uint32).reshape(len(own), k).astype(np.int64)
                h = np.zeros(len(own), np.uint64)
                for j in range(k):
                    h = h * PRIME + chars[:, j].astype(np.uint64)
                order = np.argsort(h)
                self.tables[k] = h[order], chars[order], np.array([numbers[p] for p in own])[order]
                slot = self._slot(h[order], k)
                taken = self.slots[slot] != NONE
                self.slots[slot] = np.where(taken, MANY, np.arange(len(own)))
                one, uses = np.unique(slot, return_counts=True)
                self.slots[one[uses > 1]] = MANY

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        return (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)

    def find(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, row, last column, piece) for all pieces in rows of characters; negative characters match nothing."""
        own = chars.astype(np.uint64)
        h = np.zeros_like(own)
        for k in range(1, min(self.longest, chars.shape[1]) + 1):
            h = own[:, k - 1 :] + PRIME * (h[:, :-1] if k > 1 else h)
            if k not in self.tables:
                continue
            slot = self.slots[self._slot(h, k)]
            w, e = np.nonzero(slot != NONE)
            hashes, letters, ids = self.tables[k]
            at, mine = slot[w, e], h[w, e]
            many = np.flatnonzero(at == MANY)
            if len(many):
                at[many] = np.searchsorted(hashes, mine[many])
            at = np.minimum(at, len(hashes) - 1)  # a slot may be that of a piece of another length
            good = hashes[at] == mine
            w, e, at = w[good], e[good] + k - 1, at[good]
            good = letters[at, 0] == chars[w, e - k + 1]
            for j in range(1, k):
                good &= letters[at, j] == chars[w, e - k + 1 + j]
            yield k, w[good], e[good], ids[at[good]]
