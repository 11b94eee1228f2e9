"""A double-array trie over whole-number symbols, built and walked in numpy for many sequences at once."""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 14
TRIES = 4


def ranks(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense numbers of the distinct rows of ``columns``, and how many there are."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), 0
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(out.max()) + 1


class DoubleArray:
    """BASE and CHECK: the child of the node at slot s by a symbol with code c is at BASE[s] + c if CHECK there is s.

    Codes are dense and given in the order in which symbols are met, level by level and parent by parent, so that the
    children of a node, most of which are met there first, have codes in a row and fill slots in a row.
    """

    def __init__(self, offsets: np.ndarray, symbols: np.ndarray, n_symbols: int) -> None:
        """The trie of the sequences ``symbols[offsets[i]:offsets[i + 1]]`` of numbers below ``n_symbols``."""
        self.codes = np.full(n_symbols, -1, np.int64)
        parents, codes, seen, total = [], [], 0, 1
        node, lengths = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets)
        for level in range(int(lengths.max(initial=0))):
            here = np.flatnonzero(lengths > level)
            pairs, back = np.unique(node[here] * n_symbols + symbols[offsets[here] + level], return_inverse=True)
            parent, symbol = np.divmod(pairs, n_symbols)
            fresh = symbol[self.codes[symbol] < 0]
            _, first = np.unique(fresh, return_index=True)
            fresh = fresh[np.sort(first)]
            self.codes[fresh] = seen + np.arange(len(fresh))
            seen += len(fresh)
            order = np.lexsort((self.codes[symbol], parent))
            place = np.empty(len(order), np.int64)
            place[order] = total + np.arange(len(order))
            node[here] = place[back]
            parents.append(parent[order])
            codes.append(self.codes[symbol][order])
            total += len(order)
        self._pack(np.concatenate([np.zeros(0, np.int64), *parents]), np.concatenate([np.zeros(0, np.int64), *codes]))

    def _pack(self, parent: np.ndarray, code: np.ndarray) -> None:
        """Slots for all nodes: sets of siblings first, only children in the gaps that are left."""
        begins = np.flatnonzero(np.diff(parent, prepend=-1))
        ends = np.append(begins[1:], len(parent))
        base_of, slot = np.zeros(len(parent) + 1, np.int64), np.zeros(len(parent) + 1, np.int64)
        used, high, low = np.zeros(2 * len(parent) + 2 * len(self.codes) + 16, bool), 1, 1
        used[0] = True
        for a, z in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
            own = code[a:z] - code[a]
            span = int(own[-1]) + 1
            if high + span > len(used):
                used = np.concatenate([used, np.zeros(len(used) + span, bool)])
            at = high if span == z - a else self._gap(used, low, high, own)
            used[at + own] = True
            high = max(high, at + span)
            slot[a + 1 : z + 1], base_of[parent[a]] = at + own, at - code[a]
            while low < high and used[low]:
                low += 1
        alone = begins[ends - begins == 1]
        gaps = np.flatnonzero(~used[:high])[: len(alone)]
        places = np.concatenate([gaps, high + np.arange(len(alone) - len(gaps))])
        slot[alone + 1], base_of[parent[alone]] = places, places - code[alone]
        size = int(slot.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[slot] = base_of
        self.check[slot[1:]] = slot[parent]

    @staticmethod
    def _gap(used: np.ndarray, low: int, high: int, own: np.ndarray) -> int:
        """A place where all of ``own`` fit, looked for in the first gaps; else the end."""
        for _ in range(TRIES):
            if low >= high:
                break
            stop = min(low + WINDOW, high)
            free = low + np.flatnonzero(~used[low:stop])
            free = free[free + own[-1] < len(used)]
            for k in range(0, len(free), 256):
                fits = ~used[free[k : k + 256, None] + own].any(1)
                if fits.any():
                    return int(free[k + int(fits.argmax())])
            low = stop
        return high

    def step(self, slots: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of ``slots`` by ``symbols``; -1 where there is none."""
        to = self.base[slots] + self.codes[symbols]
        inside = (to >= 0) & (to < len(self.check)) & (self.codes[symbols] >= 0)
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == slots), to, -1)
