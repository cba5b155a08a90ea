"""Periodic runs of words: found on a harmonic grid, extended exactly by a run-length grammar.

Words become numbers (an exact dictionary of each slice of texts).  A run of period q and at least
four periods has three periods of places whose word is repeated q words on; among them is a
multiple of 2q that has more than q such places from it on.  So the candidates of q are the multiples
of 2q, n ln(n) / 2 for n words, and those where the next (up to four) words don't repeat are dropped.  The
texts with candidates get a grammar (see ``recompression``), and each candidate is extended
both ways by it; candidates within what an extension covers need none of their own.

Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.bytewords import IS_SPACE, Words, slices
from geotally.llm.recompression import Grammar

#: Words that must repeat at a candidate (fewer if the period is shorter), and candidates at a time.
PROBE_WORDS, PROBE_ROWS = 4, 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _candidates(text: np.ndarray, ends: np.ndarray, sizes: np.ndarray, periods: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and places of candidates, by period and place, in bounded batches.

    ``text`` has the longest texts first, each behind a wall; ``ends`` and ``sizes`` are in that order.
    """
    most = int(sizes[0]) // periods if len(sizes) else 0
    q = np.arange(1, most + 1)
    within = np.searchsorted(-sizes, -np.maximum(periods * q, min_words), "right")  # texts that are long enough
    q = q[within > 0]
    counts = np.maximum(0, -(-(ends[within[within > 0] - 1] - q) // (2 * q)))
    upto = np.cumsum(counts)
    first = 0
    while first < len(q):
        # A period with more candidates than a batch holds is a batch of its own.
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PROBE_ROWS, "right")))
        n = counts[first:last]
        period = np.repeat(q[first:last], n)
        place = (np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)) * 2 * period
        # So many places repeat from the candidate of a run on, at least.
        sure = np.maximum(min_words, periods * period) - 3 * period + 1
        for k in range(PROBE_WORDS):
            other = np.minimum(place + period + k, len(text) - 1)
            keep = (text[np.minimum(place + k, len(text) - 1)] == text[other]) | (sure <= k)
            period, place, sure = period[keep], place[keep], sure[keep]
        if len(period):
            yield period, place
        first = last


def _extended(grammar: Grammar, period: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods, starts and stops (of the repeated places) of all candidates; one that lies in what
    was found for its period is passed over."""
    found = []
    chain = np.cumsum(np.concatenate([[True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 2 * period[1:])]))
    while len(period):
        lead = np.concatenate([[True], chain[1:] != chain[:-1]])
        q, g = period[lead], place[lead]
        stop = g + grammar.extend(g, g + q, grammar.ahead)
        start = g - grammar.extend(g - 1, g + q - 1, grammar.back)
        found.append((q, start, stop))
        left = (place >= stop[np.cumsum(lead) - 1]) & ~lead
        period, place, chain = period[left], place[left], chain[left]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_runs(words: np.ndarray, bounds: np.ndarray, periods: int = 4, min_words: int = 6) -> tuple[np.ndarray, ...]:
    """Text, start (word of the text), length and smallest period of every run, by text, start and
    period.  ``words`` are numbers; text i has words ``bounds[i]`` to ``bounds[i + 1]``.

    A run has at least ``min_words`` words and ``periods`` periods (four at least).
    """
    if periods < 4:
        raise ValueError("the grid serves four periods or more")
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(periods, min_words)]
    none = np.zeros(0, np.int64)
    if not len(order):
        return none, none, none, none

    def laid_out(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words, a wall before each and behind the last, and where each begins."""
        n = sizes[texts]
        begins = 1 + np.cumsum(n + 1) - (n + 1)
        row = np.full(int(n.sum()) + len(texts) + 1, -1, np.int64)
        at = np.repeat(begins, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row[at] = words[np.repeat(bounds[texts], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        wall = np.flatnonzero(row < 0)
        row[wall] = int(words.max()) + 1 + np.arange(len(wall))
        return row, begins

    row, begins = laid_out(order)
    ends = begins + sizes[order]
    batches = list(_candidates(row, ends, sizes[order], periods, min_words))
    if not batches:
        return none, none, none, none
    period, place = (np.concatenate(x) for x in zip(*batches, strict=True))
    owner = np.searchsorted(begins, place, "right") - 1
    own = owner == np.searchsorted(begins, place + period, "right") - 1  # both words in one text
    period, place, owner = period[own], place[own], owner[own]
    if not len(period):
        return none, none, none, none
    # Only the texts with candidates get a grammar; they keep their order and move together.
    some = np.unique(owner)
    row, moved = laid_out(order[some])
    place = place - begins[owner] + moved[np.searchsorted(some, owner)]
    grammar = Grammar(row, int(words.max()) + 1)
    q, start, stop = _extended(grammar, period, place)
    length = stop - start + q
    keep = length >= np.maximum(min_words, periods * q)
    q, start, length = q[keep], start[keep], length[keep]
    # A multiple of a run's period gives the same stretch: the smallest stays.
    by = np.lexsort([q, length, start])
    q, start, length = q[by], start[by], length[by]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(q) else np.zeros(0, bool)
    q, start, length = q[new], start[new], length[new]
    text = np.searchsorted(moved, start, "right") - 1
    start, text = start - moved[text], order[some][text]
    by = np.lexsort([q, start, text])
    return text[by], start[by], length[by], q[by]


def _numbers(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word of a slice (equal for equal words only), the words' bytes without any
    space, and their sizes."""
    packed = w.data[~IS_SPACE[w.data]]
    sizes = w.ends - w.starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), packed, sizes


def _spaced(packed: np.ndarray, sizes: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words, one space behind each, as bytes, and where each text begins and ends there."""
    kept = packed[np.repeat(keep, sizes)] if not keep.all() else packed
    own = sizes[keep]
    out = np.full(len(kept) + len(own), 0x20, np.uint8)
    out[np.arange(len(kept)) + np.repeat(np.arange(len(own)), own)] = kept
    ends = np.concatenate([[0], np.cumsum(own + 1)])
    count = np.concatenate([[0], np.cumsum(keep)])[bounds]
    first, last = ends[count[:-1]], ends[count[1:]]
    return out, first, np.maximum(first, last - 1)


def collapse_runs(docs: DataFrame, *, periods: int = 4, min_words: int = 6, with_text: bool = True, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_words`` (long), ``runs`` and ``collapsed_sha256``, the text replaced by
    the collapsed one (or left out, without ``with_text``); columns of the new names are replaced.

    A run is a stretch of words with smallest period q (words q apart are equal) of at least
    ``min_words`` words and ``periods`` periods that no neighbouring word extends; ``runs`` are structs
    of start (from 0), length and period, by start and period.  Words that a run has behind its
    first q ones are dropped, the others are joined by single spaces (digest: SHA-256, lower-case
    hexadecimal).  A null or empty text has no words, no runs and the empty text's digest.  Repeated rows
    are worked on alike; an empty table gives an empty table.  A text is worked on as a whole in one
    task, with some 400 bytes for each word if it has candidates.
    """
    new = ("n_words", "runs", "collapsed_sha256")
    rest = [c for c in docs.columns if c != text_col and c not in new]
    # The other columns travel as one, so that none clashes with the names used here.
    narrow = docs.select(F.struct(*rest, F.lit(0).alias("__")).alias("row"), F.col(text_col).cast("string").alias("text"))
    row_type = narrow.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for w in slices(batch.column(1)):
                n = len(w.bounds) - 1
                numbers, packed, sizes = _numbers(w)
                text, start, length, period = find_runs(numbers, w.bounds, periods, min_words)
                change = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(change, w.bounds[text] + start + period, 1)
                np.add.at(change, w.bounds[text] + start + length, -1)
                out, first, last = _spaced(packed, sizes, np.cumsum(change[:-1]) == 0, w.bounds)
                whole = out.tobytes()
                kept = [whole[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                found = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
                )
                columns = [batch.column(0).slice(w.first, n), pa.array(np.diff(w.bounds).astype(np.int64)), found.cast(made), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                names = ["row", *new]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    out = narrow.mapInArrow(run, f"row {row_type}, n_words bigint, runs {RUNS}, collapsed_sha256 string" + (", text string" if with_text else ""))
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in new and (with_text or c != text_col)]
    return out.select(*columns, *new)


def longest(runs, field: str):
    """A field of the run with the greatest length (ties: smallest start, then period); null without any."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))[field]
