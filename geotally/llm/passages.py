"""Repeated passages: anchors, windows and word suffix automata.

Word level throughout: a word is its 64-bit hash, a passage a run of words.
"""

from __future__ import annotations

import numpy as np

from geotally.llm.bytewords import Words, mix

_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by doubling."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    block, width, step = words, 1, int(_STEP)
    left = size
    while left:
        if left & 1:  # append the block to what there is
            n = len(words) - have - width + 1
            out = block if out is None else out[:n] * np.uint64(step) + block[have : have + n]
            have += width
        left >>= 1
        if left:
            block = block[: len(block) - width] * np.uint64(step) + block[width:]
            width, step = 2 * width, step * step % 2**64
    return mix(out[: len(words) - size + 1])


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For every ``span`` values in a row, the place of the first of the least."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place, width = values, np.arange(len(values)), 1

    def least(a, pa, b, pb):
        second = b < a
        return np.where(second, b, a), np.where(second, pb, pa)

    while width < span:
        ahead = min(width, span - width)
        best, place = least(best[: len(best) - ahead], place[: len(place) - ahead], best[ahead:], place[ahead:])
        width += ahead
    return place[:n]


class Anchors:
    """Anchors of a slice of texts.

    Every window of ``window`` words has as its anchor the run of ``gram`` words with the
    least hash in it, the first of them; it depends on the window's words alone, so equal
    windows have equal anchors.  Windows in a row with one anchor are one entry: ``text`` (number
    in the slice), ``start`` (first window, in words of that text), ``count`` of windows,
    ``anchor`` (hash) and ``context`` (hash of all words of these windows and their place at
    the anchor).  ``at`` is the first window's place in the slice.
    """

    def __init__(self, w: Words, window: int, gram: int) -> None:
        words = w.hashes()
        owners = w.owners()
        self.windows = gram_hashes(words, window)
        n = len(self.windows)
        grams = gram_hashes(words, gram)
        place = least_places(grams, window - gram + 1)[:n]
        valid = owners[:n] == owners[window - 1 :] if n else np.zeros(0, bool)
        new = valid.copy()
        if n > 1:
            new[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]) & (owners[1:n] == owners[: n - 1]))
        self.at = np.flatnonzero(new)
        stops = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~new[1:], [False]])) if n else self.at
        self.count = stops - self.at + 1
        self.text = owners[self.at] if n else self.at
        self.start = self.at - w.bounds[self.text] if n else self.at
        self.anchor = grams[place[self.at]] if n else np.zeros(0, np.uint64)
        # The first and the last window hold all words of the context.
        self.context = mix(self.windows[self.at] * _STEP + self.windows[stops] + (self.count * 64 + place[self.at] - self.at).astype(np.uint64)) if n else np.zeros(0, np.uint64)


def runs(keys: np.ndarray, texts: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries in a row that have one key and touch, as one (periodic texts have very many)."""
    if not len(keys):
        return keys, texts, starts, counts
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]) | (starts[1:] != starts[:-1] + counts[:-1])])
    first = np.flatnonzero(new)
    return keys[first], texts[first], starts[first], np.add.reduceat(counts, first)


class SuffixAutomaton:
    """Suffix automaton of a sequence of words."""

    def __init__(self, words) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            at, last = last, new
            while at >= 0 and w not in nexts[at]:
                nexts[at][w] = new
                at = link[at]
            if at < 0:
                continue
            to = nexts[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
                continue
            copy = len(nexts)
            nexts.append(dict(nexts[to]))
            link.append(link[to])
            length.append(length[at] + 1)
            while at >= 0 and nexts[at].get(w) == to:
                nexts[at][w] = copy
                at = link[at]
            link[to] = link[new] = copy

    def spans(self, words, threshold: int) -> list[tuple[int, int]]:
        """Maximal runs of words covered by matches of at least ``threshold`` words.

        The matching statistic of a place is the length of the longest run of words that ends
        there and is in the automaton's sequence.
        """
        nexts, link, length = self.next, self.link, self.length
        found: list[tuple[int, int]] = []
        at = matched = 0
        for i, w in enumerate(words):
            while at and w not in nexts[at]:
                at = link[at]
                matched = length[at]
            to = nexts[at].get(w)
            if to is None:
                continue
            at, matched = to, matched + 1
            if matched >= threshold:
                start = i + 1 - matched
                if found and start <= found[-1][1]:
                    found[-1] = (min(start, found[-1][0]), i + 1)
                else:
                    found.append((start, i + 1))
        return found
