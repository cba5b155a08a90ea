"""Which tables and columns a query reads, from its plan.

A checkpoint or a written table ends a plan; while ``tracked`` is on, what stands behind each one is kept under the
number of its data or the path of its files, so the walk goes on behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

Reads = frozenset[tuple[str, str]]
_BEHIND: dict[int | str, Reads] = {}
_on = False


@contextmanager
def tracked() -> Iterator[None]:
    """Checkpoints made within are walked through by ``reads``."""
    global _on
    _on, was = True, _on
    try:
        yield
    finally:
        _on = was
        if not was:
            _BEHIND.clear()


def _leaves(df: DataFrame) -> list:
    found = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def reads(df: DataFrame) -> Reads:
    """Pairs of a table's name and a column that the plan's scans read (a scan of no column: an empty name).

    Files are named by their folder or file without the extension.  Data that neither is a file nor
    was checkpointed while tracked reads nothing.
    """
    out: set[tuple[str, str]] = set()
    for leaf in _leaves(df):
        kind = leaf.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            roots = leaf.relation().location().rootPaths()
            columns = list(leaf.requiredSchema().fieldNames()) or [""]
            for root in (roots.apply(i) for i in range(roots.size())):
                out |= _BEHIND.get(root.toString(), {(root.getName().rsplit(".", 1)[0], c) for c in columns})
        elif kind == "RDDScanExec":
            out |= _BEHIND.get(leaf.rdd().id(), frozenset())
    return frozenset(out)


def remember(before: DataFrame, after: DataFrame) -> None:
    """Keep what the plan of a checkpoint or a written table read (called where lineage is cut)."""
    if _on:
        own = reads(before)
        for leaf in _leaves(after):
            kind = leaf.getClass().getSimpleName()
            if kind == "RDDScanExec":
                _BEHIND[leaf.rdd().id()] = own
            elif kind == "FileSourceScanExec":
                roots = leaf.relation().location().rootPaths()
                _BEHIND.update({roots.apply(i).toString(): own for i in range(roots.size())})
