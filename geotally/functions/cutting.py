"""Segments cut to polygons of few corners, many pairs at once in arrays.

A pair of a segment and a polygon is worked on whole: no row for each of its crossings leaves the task.  The rules
are those of ``operators.polygons``; a batch is worked on in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Where grid lines are within a tile, so that corners of polygons don't lie on them.
OFFSET = 0.3819660112501051
#: Edges within this share of the coordinates' size of a line count as on it.
TOLERANCE = 1e-12
#: Kinds of pieces: in a polygon, along an edge of the same or the opposite direction.
KINDS = ("inside", "same", "opposite")
#: Edges, tiles and pairs that are looked at together.
SLICE = 1 << 18

ENDS = ("x1", "y1", "x2", "y2")


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, so many of each."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(int(counts.sum()))


def _slices(weights: np.ndarray) -> Iterator[slice]:
    """Ranges of neighbours that weigh about ``SLICE`` together (a single one may weigh more)."""
    total, start = np.cumsum(weights), 0
    while start < len(weights):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + SLICE, "right")))
        yield slice(start, stop)
        start = stop


def pieces(ends: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``pair``, ``low``, ``high`` and the number of the kind, by pair and place, for segments (``ends``, a row a pair) and the
    ``edges`` of each one's polygon, so many (``counts``) a pair."""
    n, first = len(ends), np.cumsum(counts) - counts
    of = np.repeat(np.arange(n), counts)
    x1, y1, x2, y2 = ends.T
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    ax, ay, bx, by = edges.T
    ex, ey, fx, fy = bx - ax, by - ay, ax - x1[of], ay - y1[of]  # from the segment's own start: large coordinates lose nothing
    sx, sy, sq, root = dx[of], dy[of], square[of], np.sqrt(square)[of]
    near = TOLERANCE * np.maximum(np.maximum(1.0, np.maximum(np.abs(x1), np.abs(y1)))[of], np.maximum(np.abs(ax), np.abs(ay)))
    gx, gy = fx + ex, fy + ey
    along = (np.abs(sx * fy - sy * fx) / root <= near) & (np.abs(sx * gy - sy * gx) / root <= near)
    turn = sx * ey - sy * ex
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        t, u = (fx * ey - fy * ex) / turn, (fx * sy - fy * sx) / turn
    crossing = (t >= -1e-9) & (t <= 1 + 1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9)
    a, b = (fx * sx + fy * sy) / sq, (gx * sx + gy * sy) / sq
    start, stop = np.clip(np.minimum(a, b), 0.0, 1.0), np.clip(np.maximum(a, b), 0.0, 1.0)
    runs = along & (start < stop)
    hit = runs | crossing
    both = hit & along
    every = np.arange(n)
    pair = np.concatenate((every, every, of[hit], of[both]))
    place = np.concatenate((np.zeros(n), np.ones(n), np.where(along, start, np.clip(t, 0.0, 1.0))[hit], stop[both]))
    order = np.lexsort((place, pair))
    pair, place = pair[order], place[order]
    ok = (pair[1:] == pair[:-1]) & (place[1:] - place[:-1] > 1e-12)
    pair, low, high = pair[:-1][ok], place[:-1][ok], place[1:][ok]
    middle = (low + high) / 2
    kind = np.full(len(pair), -1, np.int8)
    same = sx * ex + sy * ey > 0
    beside = np.zeros(n, bool)
    beside[of[runs]] = True

    def met(which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces, where their edges begin, and the edges."""
        for part in _slices(counts[pair[which]]):
            chosen = which[part]
            c = counts[pair[chosen]]
            yield chosen, c, _spread(first[pair[chosen]], c)

    for chosen, c, edge in met(np.flatnonzero(beside[pair])):
        at, begins = np.repeat(middle[chosen], c), np.cumsum(c) - c
        holds = runs[edge] & (start[edge] <= at) & (at <= stop[edge])
        kind[chosen[np.logical_or.reduceat(holds, begins)]] = 2
        kind[chosen[np.logical_or.reduceat(holds & same[edge], begins)]] = 1
    for chosen, c, edge in met(np.flatnonzero(kind < 0)):
        p, begins = pair[chosen], np.cumsum(c) - c
        mx, my = np.repeat(x1[p] + middle[chosen] * dx[p], c), np.repeat(y1[p] + middle[chosen] * dy[p], c)
        px, py, qx, qy = ax[edge] - mx, ay[edge] - my, bx[edge] - mx, by[edge] - my
        crosses = (py > 0) != (qy > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses &= px - py * (qx - px) / (qy - py) > 0
        kind[chosen[np.add.reduceat(crosses.astype(np.int64), begins) % 2 == 1]] = 0
    held = kind >= 0
    return pair[held], low[held], high[held], kind[held]


def joined(pair: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring pieces of one pair that touch become one part."""
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (low[1:] > high[:-1] + 1e-12)
    starts = np.flatnonzero(new)
    return pair[starts], low[starts], high[np.append(starts[1:], len(pair))[: len(starts)] - 1]


class Index:
    """Polygons by the tiles that their extents are in.  ``ids``; ``edges`` of all, so many (``counts``) a polygon."""

    def __init__(self, ids: pa.Array, edges: np.ndarray, counts: np.ndarray, size: float) -> None:
        some = np.flatnonzero(counts > 0)
        self.ids, self.edges, self.counts = ids.take(pa.array(some)), edges, counts[some]
        self.first = np.cumsum(self.counts) - self.counts
        if not len(some):
            return
        low = lambda c: np.minimum.reduceat(np.minimum(edges[:, c], edges[:, c + 2]), self.first)
        high = lambda c: np.maximum.reduceat(np.maximum(edges[:, c], edges[:, c + 2]), self.first)
        self.box = _padded(low(0), low(1), high(0), high(1))
        west, south, east, north = self.box
        while True:  # few large polygons don't fill small tiles
            self.size = size
            self.x0, self.y0, self.x1, self.y1 = (self.tile(c) for c in (west, south, east, north))
            wide, tall = self.x1 - self.x0 + 1, self.y1 - self.y0 + 1
            if float((wide.astype(float) * tall).sum()) <= 8 * len(some) + 1024:
                break
            size *= 2
        which = np.repeat(np.arange(len(some)), wide * tall)
        nth = _spread(np.zeros(len(some), np.int64), wide * tall)
        codes = _code(self.x0[which] + nth % wide[which], self.y0[which] + nth // wide[which])
        order = np.argsort(codes, kind="stable")
        self.members = which[order].astype(np.int32)
        self.codes, self.starts = np.unique(codes[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(codes))
        self.extent = self.x0.min(), self.y0.min(), self.x1.max(), self.y1.max()

    def tile(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(x / self.size - OFFSET), -(2.0**31), 2.0**31 - 1).astype(np.int64)

    def candidates(self, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of segments and of polygons whose extents meet; each pair once, in the first tile that both are in."""
        if not len(self.counts):
            return
        x1, y1, x2, y2 = ends.T
        west, south, east, north = self.extent
        margin, low, high = self.size * 1e-9, np.minimum(y1, y2), np.maximum(y1, y2)
        bottom, top = np.maximum(self.tile(low - margin), south), np.minimum(self.tile(high + margin), north)
        rows = np.maximum(top - bottom + 1, 0)
        for part in _slices(rows):
            of = np.repeat(np.arange(part.start, part.stop), rows[part])
            row = _spread(bottom[part], rows[part])
            level = lambda y, of=of: np.maximum(low[of], np.minimum(high[of], y))
            with np.errstate(divide="ignore", invalid="ignore"):
                at = lambda y, of=of: x1[of] + (y - y1[of]) / (y2[of] - y1[of]) * (x2[of] - x1[of])
                flat = y1[of] == y2[of]
                one = np.where(flat, x1[of], at(level((row + OFFSET) * self.size - margin)))
                two = np.where(flat, x2[of], at(level((row + 1 + OFFSET) * self.size + margin)))
            begin, end = self.tile(np.minimum(one, two) - margin), self.tile(np.maximum(one, two) + margin)
            # What the row before holds of the same segment.
            before = np.zeros(len(of), bool)
            before[1:] = of[1:] == of[:-1]
            from_, to = np.roll(begin, 1), np.roll(end, 1)
            left = np.maximum(begin, west)
            columns = np.maximum(np.minimum(end, east) - left + 1, 0)
            for strip in _slices(columns):
                line = np.repeat(np.arange(strip.start, strip.stop), columns[strip])
                column = _spread(left[strip], columns[strip])
                code = _code(column, row[line])
                found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                known = self.codes[found] == code
                line, column, found = line[known], column[known], found[known]
                many = self.stops[found] - self.starts[found]
                for some in _slices(many):
                    tile = np.repeat(np.arange(some.start, some.stop), many[some])
                    polygon = self.members[_spread(self.starts[found[some]], many[some])]
                    at_line = line[tile]
                    earlier = before[at_line] & (row[at_line] > self.y0[polygon]) & (from_[at_line] <= self.x1[polygon]) & (to[at_line] >= self.x0[polygon])
                    here = (column[tile] == np.maximum(begin[at_line], self.x0[polygon])) & ~earlier
                    segment, polygon = of[at_line[here]], polygon[here]
                    w, s, e, n = _padded(np.minimum(x1[segment], x2[segment]), low[segment], np.maximum(x1[segment], x2[segment]), high[segment])
                    meet = (w <= self.box[2][polygon]) & (self.box[0][polygon] <= e) & (s <= self.box[3][polygon]) & (self.box[1][polygon] <= n)
                    yield segment[meet], polygon[meet]


def _padded(west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, ...]:
    """Extents with room for what counts as the same place."""
    pad = 1e-6 * (east - west + north - south) + TOLERANCE * np.maximum(1.0, np.maximum(np.maximum(np.abs(west), np.abs(east)), np.maximum(np.abs(south), np.abs(north))))
    return west - pad, south - pad, east + pad, north + pad


def _code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (y << 32) + x


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a length, and their ends."""
    ends = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ENDS]) if batch.num_rows else np.zeros((0, 4))
    kept = np.flatnonzero(np.isfinite(ends).all(1) & ((ends[:, 0] != ends[:, 2]) | (ends[:, 1] != ends[:, 3])))
    return kept, np.ascontiguousarray(ends[kept])


def edge_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All edges and how many each row has, of lists of four numbers an edge (null: none)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64) // 4
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4), counts


def _rows(batch: pa.RecordBatch, keys: list[str], rows: np.ndarray, of: pa.Array, low, high, kind) -> pa.RecordBatch:
    given = [batch.column(k).take(pa.array(rows)) for k in keys]
    names = pa.array(KINDS).take(pa.array(kind)) if kind is not None else pa.nulls(len(rows), pa.string())
    return pa.RecordBatch.from_arrays([*given, of, pa.array(low, pa.float64()), pa.array(high, pa.float64()), names], names=[*keys, "of", "low", "high", "kind"])


def _cut(ends: np.ndarray, edges: np.ndarray, first: np.ndarray, counts: np.ndarray, kinds: tuple[int, ...], whole: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Numbers of pairs, ``low``, ``high`` and kinds, slice by slice; with ``whole`` touching pieces of all these kinds are one part."""
    for part in _slices(counts):
        pair, low, high, kind = pieces(ends[part], edges[_spread(first[part], counts[part])], counts[part])
        if len(kinds) < len(KINDS):
            right = np.isin(kind, kinds)
            pair, low, high, kind = pair[right], low[right], high[right], kind[right]
        if whole:
            pair, low, high = joined(pair, low, high)
            kind = np.zeros(len(pair), np.int8)
        yield pair + part.start, low, high, kind


def cut_by_index(index: Index, keys: list[str], kinds: tuple[int, ...], whole: bool, keep: bool):
    """For batches of segments: a row for each piece in a polygon of the index; with ``keep`` also each row itself, in no polygon."""

    def run(batches: Iterator[pa.RecordBatch], shared=index) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if keep:
                every = np.arange(batch.num_rows)
                yield _rows(batch, keys, every, pa.nulls(len(every), known.ids.type), pa.nulls(len(every), pa.float64()), pa.nulls(len(every), pa.float64()), None)
            kept, ends = _usable(batch)
            for segment, polygon in known.candidates(ends):
                for pair, low, high, kind in _cut(ends[segment], known.edges, known.first[polygon], known.counts[polygon], kinds, whole):
                    if len(pair):
                        yield _rows(batch, keys, kept[segment[pair]], known.ids.take(pa.array(polygon[pair])), low, high, kind)

    return run


def cut_pairs(keys: list[str], kinds: tuple[int, ...], whole: bool):
    """The same for batches of pairs, that have the polygon's ``of`` and ``edges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ends = _usable(batch)
            edges, counts = edge_arrays(batch.column("edges"))
            first = np.cumsum(counts) - counts
            some = counts[kept] > 0
            kept, ends = kept[some], ends[some]
            for pair, low, high, kind in _cut(ends, edges, first[kept], counts[kept], kinds, whole):
                if len(pair):
                    yield _rows(batch, keys, kept[pair], batch.column("of").take(pa.array(kept[pair])), low, high, kind)

    return run
