"""Recompression: a run-length grammar of a sequence, and exact extensions by it.

Rounds alternate: block compression names every maximal run of one symbol by symbol and length,
pair compression deals the symbols to two halves at random and names every pair of a left one
followed by a right one.  A name depends only on what it stands for, so equal symbols of one level
stand for equal words, and equal stretches get equal symbols but for a few at their ends.

An extension of two places climbs to the parents where both begin one and these are equal, steps
over equal symbols (over a common number of a block's symbols at once) and goes down where they
differ; it ends where two words differ.  All queries take their steps together, as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from geotally.llm.bytewords import mix

#: Rounds of both compressions; each pair round ends about a quarter of the symbols, so this is beyond 2^40 words.
MAX_ROUNDS = 96


@dataclass
class Steps:
    """For one direction: whether a symbol is the first that it meets of its parent, how many symbols
    of its block begin there, and the child that it meets first."""

    outer: np.ndarray
    block: np.ndarray
    child: np.ndarray
    sign: int


class Grammar:
    """The levels of a sequence, one behind the other in flat arrays.

    ``symbols`` are numbers from 0; those from ``walls`` on are unique, stay alone on all levels, and
    one of them is at both ends, so no extension runs out.
    """

    def __init__(self, symbols: np.ndarray, walls: int) -> None:
        levels, links = [symbols.astype(np.int64)], []
        names = int(symbols.max()) + 1
        last_wall = names
        for turn in range(2 * MAX_ROUNDS):
            now = levels[-1]
            if turn % 2 == 0:
                begins = np.concatenate([[True], now[1:] != now[:-1]])
            else:
                free = (now < walls) | (now >= last_wall)
                left = free & ((mix(now.astype(np.uint64) + np.uint64((turn + 1) << 40)) & np.uint64(1)) == 0)
                begins = np.concatenate([[True], ~(left[:-1] & free[1:] & ~left[1:])])
            first = np.flatnonzero(begins)
            if len(first) == len(now):
                if turn % 2 and not (free[:-1] & free[1:]).any():
                    break  # every stretch between two walls is one symbol
                continue
            sizes = np.diff(np.append(first, len(now)))
            grown = now[first].copy()
            many = sizes > 1
            # A block is named by symbol and length, a pair by its two symbols.
            second = sizes[many] if turn % 2 == 0 else now[first[many] + 1]
            keys = grown[many] * (int(second.max()) + 1) + second
            _, named = np.unique(keys, return_inverse=True)
            grown[many] = names + named
            names += int(named.max()) + 1
            levels.append(grown)
            links.append((np.cumsum(begins) - 1, first, sizes, turn % 2 == 0))
        base = np.cumsum([0, *map(len, levels)])
        self.sym = np.concatenate(levels)
        self.floor = len(symbols)
        whole = len(self.sym)
        index = np.int32 if whole < 1 << 31 else np.int64
        self.parent = np.arange(whole, dtype=index)
        self.ahead = Steps(np.zeros(whole, bool), np.ones(whole, index), np.zeros(whole, index), 1)
        self.back = Steps(np.zeros(whole, bool), np.ones(whole, index), np.zeros(whole, index), -1)
        for k, (parents, first, sizes, blocks) in enumerate(links):
            own, above = slice(base[k], base[k + 1]), slice(base[k + 1], base[k + 2])
            self.parent[own] = base[k + 1] + parents
            last = first + sizes - 1
            self.ahead.outer[base[k] + first] = True
            self.back.outer[base[k] + last] = True
            self.ahead.child[above] = base[k] + first
            self.back.child[above] = base[k] + last
            if blocks:
                at = np.arange(base[k + 1] - base[k])
                self.ahead.block[own] = last[parents] - at + 1
                self.back.block[own] = at - first[parents] + 1

    def extend(self, x: np.ndarray, y: np.ndarray, steps: Steps) -> np.ndarray:
        """Number of equal symbols from each pair of places on, in a direction (both places count)."""
        start = x.astype(np.int64)
        x, y = start.copy(), y.astype(np.int64)
        live = np.arange(len(x))
        sym, parent = self.sym, self.parent
        while len(live):
            a, b = x[live], y[live]
            same = sym[a] == sym[b]
            pa, pb = parent[a], parent[b]
            up = same & steps.outer[a] & steps.outer[b] & (sym[pa] == sym[pb])
            jump = np.minimum(steps.block[a], steps.block[b]) * steps.sign
            down = ~same & (a >= self.floor)
            x[live] = np.where(up, pa, np.where(same, a + jump, np.where(down, steps.child[a], a)))
            y[live] = np.where(up, pb, np.where(same, b + jump, np.where(down, steps.child[b], b)))
            live = live[same | down]
        return np.abs(x - start)
