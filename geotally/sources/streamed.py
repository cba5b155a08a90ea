"""Files larger than a row: digests in pieces, and one JSON array read by many tasks.

Tasks open files through Arrow's file systems (a local path or a URI that these know) and read them
in pieces of a megabyte, so memory doesn't grow with a file.  A JSON document is dealt to ranges of
bytes.  What a range does to the reader's state (outside or inside a string, behind a backslash;
how deep) is worked out for every state that it may begin in; the ranges' effects are composed in
order, one small row a range, and then each range knows where it begins and cuts out its items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20
#: States of a reader of JSON, and what changes them.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_TOKENS = re.compile(rb'["\\{}\[\]]')
_QUOTE, _ESCAPE, _OPEN, _CLOSE = 0x22, 0x5C, b"{[", b"}]"


def files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of each file in a folder (hidden ones left out)."""
    system, name = fs.FileSystem.from_uri(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(name, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((prefix + x.path, x.size) for x in found)


def _pieces(path: str, start: int, stop: int | None) -> Iterator[bytes]:
    """Bytes of a file from one place up to another (or its end), piece by piece."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as source:
        source.seek(start)
        while stop is None or start < stop:
            piece = source.read(PIECE_BYTES if stop is None else min(PIECE_BYTES, stop - start))
            if not piece:
                return
            start += len(piece)
            yield piece


def _one_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a partition for each row."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length`` and ``sha256`` of a file or of each file in a folder: a task a file, a megabyte at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha256()
                for piece in _pieces(name, 0, None):
                    digest.update(piece)
                yield pa.RecordBatch.from_pydict({"path": [name], "length": [size], "sha256": [digest.hexdigest()]})

    listed = files(path)
    return _one_each(spark, listed, "path string, length bigint").mapInArrow(run, "path string, length bigint, sha256 string")


def walk(piece: bytes, state: int, depth: int, events: list | None = None) -> tuple[int, int]:
    """The state and depth behind a piece; ``events`` gets place, byte and depth outside of each bracket."""
    after = 0
    if state == ESCAPED and piece:
        state, after = INSIDE, 1
    for found in _TOKENS.finditer(piece):
        at = found.start()
        if at < after:
            continue
        byte = piece[at]
        if state == INSIDE:
            if byte == _QUOTE:
                state = OUTSIDE
            elif byte == _ESCAPE:
                after = at + 2
        elif byte == _QUOTE:
            state = INSIDE
        elif byte in _OPEN:
            if events is not None:
                events.append((at, byte, depth))
            depth += 1
        elif byte in _CLOSE:
            depth -= 1
            if events is not None:
                events.append((at, byte, depth))
    return (ESCAPED if after > len(piece) else state), depth


def _items(path: str, start: int, stop: int, state: int, depth: int, level: int) -> Iterator[bytes]:
    """Texts of the objects at a level of brackets that begin in a range; the last may end behind it."""
    at, held = start, None
    for piece in _pieces(path, start, None):
        events: list = []
        state, depth = walk(piece, state, depth, events)
        begun = 0 if held is not None else None
        for place, byte, outer in events:
            if outer != level:
                continue
            if byte == 0x7B:  # {
                if at + place >= stop:
                    return
                held, begun = bytearray(), place
            elif byte == 0x7D and held is not None:  # }
                held += piece[begun : place + 1]
                yield bytes(held)
                held, begun = None, None
        if held is not None:
            held += piece[begun:]
        at += len(piece)
        if held is None and at >= stop:
            return


def json_items(spark: SparkSession, path: str, schema: str, *, level: int = 3, range_bytes: int = 64 << 20) -> DataFrame:
    """Rows of the objects at a ``level`` of brackets of a JSON document (3: ``{"result": {"results": [{...}, ...]}}``) or of each
    document in a folder, parsed by ``schema``; an object that the schema doesn't fit raises.

    A document is read by as many tasks as it has ranges; an object is in memory whole.
    """
    ranges = [(p, a, min(a + range_bytes, size)) for p, size in files(path) for a in range(0, size, range_bytes)]

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = [(s, 0) for s in (OUTSIDE, INSIDE, ESCAPED)]
                for piece in _pieces(name, start, stop):
                    now = [walk(piece, *x) for x in now]
                yield pa.RecordBatch.from_pydict({"path": [name], "start": [start], "states": [[s for s, _ in now]], "depths": [[d for _, d in now]]})

    table = _one_each(spark, ranges, "path string, start bigint, stop bigint")
    found = {(r.path, r.start): r for r in table.mapInArrow(effects, "path string, start bigint, states array<bigint>, depths array<bigint>").collect()}  # a row a range
    begins, now = [], (OUTSIDE, 0)
    for name, start, stop in ranges:
        state, depth = (OUTSIDE, 0) if start == 0 else now
        begins.append((name, start, stop, state, depth))
        own = found[name, start]
        now = own.states[state], depth + own.depths[state]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, size = [], 0
                for item in _items(*row, level):
                    out.append(item.decode())
                    size += len(item)
                    if size > 4 * PIECE_BYTES:
                        yield pa.RecordBatch.from_pydict({"item": out})
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pydict({"item": out})

    known = _one_each(spark, begins, "path string, start bigint, stop bigint, state int, depth int")
    texts = known.mapInArrow(cut_out, "item string")
    return texts.select(F.from_json("item", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
