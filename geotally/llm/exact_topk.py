"""Exact top-k inner-product search by tiles.

The query set is taken in blocks of bounded size, each of which is broadcast.  Candidates stay
where they lie: a task packs its rows into tiles of a fixed number of vectors, multiplies each
tile with the block's tiles of queries, and keeps the best k of each query so far; of a tile
only the scores that reach a query's k-th are looked at.  The tasks' lists, one for each query,
are merged in a tree of fixed width.  No vector is shuffled but the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.common import cut, written


def quantised(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v`` (array of long, floor(scale * x) with x as double).

    Rows with a null id, a null vector or null or non-finite components take no part.
    """
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double"))
    )
    return df.where(F.coalesce(usable, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


#: Bytes of the queries that are broadcast at once.
BLOCK_BYTES = 64 << 20


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles where these hold them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    raise OverflowError("inner products don't fit in 64 bits")


class Best:
    """The best k candidates so far of each query of a tile: ``scores`` (falling) and ``ids``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.query_ids, self.vectors, self.k = ids, vectors, k
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.ids = [np.zeros(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # of a full list; ties may still count

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Let a tile of candidates compete."""
        scores = _scores(self.vectors, vectors)
        reached = (scores >= self.least[:, None]) & (ids[None, :] != self.query_ids[:, None])
        for i in np.flatnonzero(reached.any(axis=1)):
            own = scores[i, reached[i]]
            other = ids[reached[i]]
            if len(own) > self.k:  # all that tie with the k-th, then the exact order
                kept = own >= np.partition(own, len(own) - self.k)[len(own) - self.k]
                own, other = own[kept], other[kept]
            own, other = np.concatenate([self.scores[i], own]), np.concatenate([self.ids[i], other])
            order = np.lexsort((other, -own))[: self.k]
            self.scores[i], self.ids[i] = own[order], other[order]
            if len(order) == self.k:
                self.least[i] = self.scores[i][-1]


#: ``best`` ascending: by falling score, then by rising id.
BEST = "query_id long, part int, best array<struct<minus:long,vec_id:long>>"
_KIND = pa.list_(pa.struct([("minus", pa.int64()), ("vec_id", pa.int64())]))


def _matrices(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    ids, lists = table.column("vec_id").to_numpy(), table.column("v")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    return {int(d): (ids[sizes == d], flat[starts[sizes == d][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def _search(shared, k: int, query_rows: int, tile_rows: int):
    """The best k of a task's candidates for each query of a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        best = {d: [Best(ids[i : i + query_rows], m[i : i + query_rows], k) for i in range(0, len(ids), query_rows)] for d, (ids, m) in shared.value.items()}
        held: dict[int, list] = {}

        def compete(dim: int) -> None:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            for i in range(0, len(ids), tile_rows):
                for queries in best[dim]:
                    queries.take(ids[i : i + tile_rows], vectors[i : i + tile_rows])

        for batch in batches:
            for dim, tile in _matrices(batch).items():
                if dim in best:
                    held.setdefault(dim, []).append(tile)
                    if sum(len(ids) for ids, _ in held[dim]) >= tile_rows:
                        compete(dim)
        for dim in list(held):
            compete(dim)
        for queries in (q for tiles in best.values() for q in tiles):
            lists = [[{"minus": -int(s), "vec_id": int(i)} for s, i in zip(a, b, strict=True)] for a, b in zip(queries.scores, queries.ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(queries.query_ids), pa.array([part] * len(lists), pa.int32()), pa.array(lists, _KIND)], ["query_id", "part", "best"])

    return run


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    *,
    k: int = 10,
    query_rows: int = 256,
    tile_rows: int = 4096,
    fan_in: int = 16,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k best candidates of each query.

    Both tables come from ``quantised``.  Ties go to the smaller id.  Rows with the query's own
    id are no candidates of it.  Only vectors of equal length are compared.  A query id that is
    repeated gets one list (of one of its rows); a repeated candidate counts once a row.  A
    query with no candidate has no row; empty tables give an empty table; other columns are not
    read.  Inner products that may not fit in 64 bits raise OverflowError.

    Queries beyond ``block_bytes`` are searched in several blocks, one after the other.
    """
    asked = cut(queries.select("vec_id", "v").dropDuplicates(["vec_id"]))
    size = asked.agg(F.sum(8 * (F.size("v") + 2))).first()[0] or 0
    n_blocks = int(size // block_bytes) + 1
    rows = candidates.select("vec_id", "v")
    if n_blocks > 1:
        rows = written(rows, "vectors")
    found = []
    for n in range(n_blocks):
        block = _matrices(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == n).toArrow())
        shared = asked.sparkSession.sparkContext.broadcast(block)
        found.append(cut(rows.mapInArrow(_search(shared, k, query_rows, tile_rows), BEST).where(F.size("best") > 0)))
        shared.unpersist()
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    parts = (best.agg(F.max("part")).first()[0] or 0) + 1
    while True:  # the tree: fan_in lists of a query at a time
        parts = -(-parts // fan_in)
        best = (
            best.select("query_id", F.floor(F.col("part") / fan_in).alias("part"), "best").groupBy("query_id", "part")
            .agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        )
        if parts == 1:
            break
    return best.select("query_id", F.posexplode("best").alias("at", "found")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.minus")).alias("score")
    )
