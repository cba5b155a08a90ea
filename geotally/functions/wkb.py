"""Canonical well-known binary of geometries (little-endian, no extensions), for hashes of content."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The types of the binary form.
POINT, LINE, POLYGON, MULTIPOLYGON = 1, 2, 3, 6


def _head(kind: int, n: int) -> bytes:
    return struct.pack("<BII", 1, kind, n)


def _coordinates(points) -> bytes:
    """Count and coordinates of a row of points; zero is never negative."""
    flat = np.array([(p["x"], p["y"]) for p in points], "<f8") + 0.0
    return struct.pack("<I", len(points)) + flat.tobytes()


def _polygon(rings) -> bytes:
    return _head(POLYGON, len(rings)) + b"".join(map(_coordinates, rings))


def _each(values: pd.Series, form) -> pd.Series:
    return values.map(lambda v: None if v is None else form(v)).astype(object)


@F.pandas_udf(BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    """A point's binary form; null if a coordinate is."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else struct.pack("<BIdd", 1, POINT, a + 0.0, b + 0.0) for a, b in zip(x, y, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def line_wkb(line: pd.Series) -> pd.Series:
    """A line's (array of points)."""
    return _each(line, lambda v: struct.pack("<BI", 1, LINE) + _coordinates(v))


@F.pandas_udf(BinaryType())
def polygon_wkb(rings: pd.Series) -> pd.Series:
    """A polygon's (array of rings)."""
    return _each(rings, _polygon)


@F.pandas_udf(BinaryType())
def multipolygon_wkb(parts: pd.Series) -> pd.Series:
    """A polygon's of several parts (array of polygons)."""
    return _each(parts, lambda v: _head(MULTIPOLYGON, len(v)) + b"".join(map(_polygon, v)))
