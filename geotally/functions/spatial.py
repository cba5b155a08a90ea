"""Spatial functions on longitude and latitude columns (degrees), as column expressions where
arithmetic suffices, and vectorised functions for cell ids and map projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

EARTH_RADIUS_M = 6_371_010.0


def distance_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), F.lit(2)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box_overlaps(west: Column, south: Column, east: Column, north: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a box meets (west, south, east, north)."""
    w, s, e, n = box
    return (west <= e) & (east >= w) & (south <= n) & (north >= s)


def parse_box(raw: str) -> tuple[float, float, float, float]:
    """Four numbers west,south,east,north in range and in order, else an error."""
    parts = [float(x) for x in raw.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    w, s, e, n = parts
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError("a box is west,south,east,north within range")
    return w, s, e, n


def polyline_length(points: Column) -> Column:
    """Planar length of an array of structs x, y."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def elementary_edges(points: Column) -> Column:
    """Array of (edge, x1, y1, x2, y2) of a polyline; none for fewer than two points."""
    n = F.size(points)
    each = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(i.alias("edge"), F.element_at(points, i)["x"].alias("x1"), F.element_at(points, i)["y"].alias("y1"), F.element_at(points, i + 1)["x"].alias("x2"), F.element_at(points, i + 1)["y"].alias("y2")),
    )
    return F.when(n >= 2, each).otherwise(F.slice(F.transform(F.sequence(F.lit(1), F.lit(1)), lambda i: F.struct(i.alias("edge"), *[F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])), 1, 0))


def clip_parameters(x1: Column, y1: Column, x2: Column, y2: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Part of a segment inside a box: struct low, high (0 to 1 along it), null if it has none (Liang-Barsky)."""
    dx, dy = x2 - x1, y2 - y1
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    miss = F.lit(False)
    for d, a, b in ((dx, west - x1, east - x1), (dy, south - y1, north - y1)):
        lows.append(F.when(d > 0, F.try_divide(a, d)).when(d < 0, F.try_divide(b, d)).otherwise(0.0))
        highs.append(F.when(d > 0, F.try_divide(b, d)).when(d < 0, F.try_divide(a, d)).otherwise(1.0))
        miss = miss | ((d == 0) & ((a > 0) | (b < 0)))
    low, high = F.greatest(*lows), F.least(*highs)
    return F.when(~miss & (low < high), F.struct(low.alias("low"), high.alias("high")))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over an array of structs x, y (closed or not)."""
    n = F.size(ring)
    crossings = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(
            ((F.get(ring, i)["y"] > lat) != (F.get(ring, (i + 1) % n)["y"] > lat))
            & (lon < F.get(ring, i)["x"] + F.try_divide((lat - F.get(ring, i)["y"]) * (F.get(ring, (i + 1) % n)["x"] - F.get(ring, i)["x"]), F.get(ring, (i + 1) % n)["y"] - F.get(ring, i)["y"])),
            1,
        ).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda s, x: s + x) % 2 == 1


def on_ring(lon: Column, lat: Column, ring: Column, tolerance: float = 1e-12) -> Column:
    """Whether a place is on an edge of the ring (closed or not), within a share of the coordinates' size."""
    n = F.size(ring)

    def touches(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        # From the place itself: large coordinates lose nothing.
        ax, ay, bx, by = a["x"] - lon, a["y"] - lat, b["x"] - lon, b["y"] - lat
        near = tolerance * F.greatest(F.lit(1.0), F.abs(lon), F.abs(lat))
        beside = F.abs(ax * by - ay * bx) <= near * F.hypot(bx - ax, by - ay)
        return beside & (F.least(ax, bx) <= near) & (F.greatest(ax, bx) >= -near) & (F.least(ay, by) <= near) & (F.greatest(ay, by) >= -near)

    return F.exists(F.sequence(F.lit(0), n - 1), touches)


def _s2_ids(lon: np.ndarray, lat: np.ndarray, level: int) -> np.ndarray:
    """Ids of the public S2 cell scheme: cube face, quadratic projection, Hilbert order."""
    p, l = np.radians(lat), np.radians(lon)
    xyz = np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)])
    axis = np.abs(xyz).argmax(axis=0)
    at = np.arange(len(lon))
    face = axis + 3 * (xyz[axis, at] < 0)
    x, y, z = xyz
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    place = []
    for w in (u, v):
        st = np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.maximum(w, 0)), 1 - 0.5 * np.sqrt(1 - 3 * np.minimum(w, 0)))
        place.append(np.clip(np.floor(st * (1 << 30)), 0, (1 << 30) - 1).astype(np.int64))
    i, j = place
    # Each level turns the curve: whether the axes are swapped and whether they are inverted.
    swap, invert, position = (face & 1).astype(np.int64), np.zeros(len(lon), np.int64), np.zeros(len(lon), np.int64)
    for k in range(29, 29 - level, -1):
        a, b = (i >> k) & 1, (j >> k) & 1
        a, b = np.where(swap == 1, b, a), np.where(swap == 1, a, b)
        a, b = a ^ invert, b ^ invert
        quarter = np.where(a == 0, b, 3 - b)  # 00, 01, 11, 10 along the curve
        position = position * 4 + quarter
        swap = swap ^ ((quarter == 0) | (quarter == 3))
        invert = invert ^ (quarter == 3)
    bits = (face.astype(np.uint64) << np.uint64(61)) | (position.astype(np.uint64) << np.uint64(61 - 2 * level)) | (np.uint64(1) << np.uint64(60 - 2 * level))
    return bits.view(np.int64)


def s2_cell(level: int):
    """A function (lon, lat) giving the signed cell id of a level; null for null or out-of-range places."""

    @F.pandas_udf(LongType())
    def cell(lon: pd.Series, lat: pd.Series) -> pd.Series:
        ok = (lon.abs() <= 180) & (lat.abs() <= 90)
        ids = _s2_ids(lon.where(ok, 0.0).to_numpy(float), lat.where(ok, 0.0).to_numpy(float), level)
        return pd.Series(ids, dtype="Int64").where(ok.reset_index(drop=True))

    return cell


def cell_token(cell: Column) -> Column:
    """Hexadecimal id without trailing zeros."""
    return F.regexp_replace(F.lpad(F.lower(F.hex(cell)), 16, "0"), "0+$", "")


@F.pandas_udf(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())]))
def tm2_to_degrees(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Inverse transverse Mercator (GRS80, central meridian 121 degrees, scale 0.9999, false easting
    250 km) by the public Krueger series."""
    n = 1 / 298.257222101 / (2 - 1 / 298.257222101)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y.to_numpy(float) / (0.9999 * a), (x.to_numpy(float) - 250_000.0) / (0.9999 * a)
    xp = xi - sum(b * np.sin(2 * (k + 1) * xi) * np.cosh(2 * (k + 1) * eta) for k, b in enumerate(beta))
    ep = eta - sum(b * np.cos(2 * (k + 1) * xi) * np.sinh(2 * (k + 1) * eta) for k, b in enumerate(beta))
    chi = np.arcsin(np.sin(xp) / np.cosh(ep))
    lat = chi + sum(d * np.sin(2 * (k + 1) * chi) for k, d in enumerate(delta))
    return pd.DataFrame({"lon": 121.0 + np.degrees(np.arctan2(np.sinh(ep), np.cos(xp))), "lat": np.degrees(lat)})


def kernel_density(lon: Column, lat: Column, cores: list[tuple[float, float, float]], spread: float = 5.2, scale: float = 111.0) -> Column:
    """Sum of weighted Gaussian kernels at the cores (lon, lat, weight)."""
    parts = [w * F.exp(-(F.pow((lon - x) * scale, F.lit(2)) + F.pow((lat - y) * scale, F.lit(2))) / spread) for x, y, w in cores]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


#: GRS80 (fixed values): semi-major axis and first eccentricity.
SEMI_MAJOR_M, ECCENTRICITY = 6_378_137.0, 0.0818191910428158


def box_area_m2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area of a box of longitudes and latitudes on the GRS80 ellipsoid, by authalic latitudes."""
    e = ECCENTRICITY

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)

    return F.radians(east - west) * SEMI_MAJOR_M**2 * (1 - e * e) / 2 * (q(north) - q(south))


def area_under(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, *, straight: bool = False) -> Column:
    """Signed area in square metres between an edge and the equator on the GRS80 ellipsoid, from the
    first place to the second eastward positive: a clockwise ring's area is the sum of its edges'.

    An edge is a great circle of the sphere of equal area (a geodesic to a few parts in a thousand of
    its own bend), or ``straight`` in degrees (parallels and meridians of a box; for edges of up to a degree).
    """
    e = ECCENTRICITY
    pole = 1 / (1 - e * e) + F.log(F.lit((1 + e) / (1 - e))) / (2 * e)

    def sine(lat: Column) -> Column:
        """Sine of the authalic latitude."""
        s = F.sin(F.radians(lat))
        return (s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)) / pole

    wide = F.radians(lon_b - lon_a)
    if straight:
        # Gauss's rule with three points.
        places = [(0.5 - 0.6**0.5 / 2, 5 / 18), (0.5, 8 / 18), (0.5 + 0.6**0.5 / 2, 5 / 18)]
        mean = sum((w * sine(lat_a + t * (lat_b - lat_a)) for t, w in places[1:]), places[0][1] * sine(lat_a + places[0][0] * (lat_b - lat_a)))
        excess = wide * mean
    else:
        half = lambda lat: F.tan(F.asin(sine(lat)) / 2)
        a, b = half(lat_a), half(lat_b)
        excess = 2 * F.atan2(F.tan(wide / 2) * (a + b), 1 + a * b)
    return excess * SEMI_MAJOR_M**2 * (1 - e * e) / 2 * pole


def _s2_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and the four corners of cells (any levels): arrays lon and lat of shape (n, 5)."""
    bits = ids.view(np.uint64)
    low = bits & (~bits + np.uint64(1))
    level = 30 - (np.log2(low.astype(np.float64)) / 2).astype(np.int64)
    face = (bits >> np.uint64(61)).astype(np.int64)
    i = j = np.zeros(len(ids), np.int64)
    swap, invert = (face & 1), np.zeros(len(ids), np.int64)
    for k in range(1, 31):
        inside = k <= level
        quarter = ((bits >> np.uint64(61 - 2 * k)) & np.uint64(3)).astype(np.int64)
        a, b = quarter >> 1, ((quarter + 1) >> 1) & 1  # 00, 01, 11, 10 along the curve
        a, b = a ^ invert, b ^ invert
        a, b = np.where(swap == 1, b, a), np.where(swap == 1, a, b)
        i, j = np.where(inside, 2 * i + a, i), np.where(inside, 2 * j + b, j)
        swap = np.where(inside, swap ^ ((quarter == 0) | (quarter == 3)), swap)
        invert = np.where(inside, invert ^ (quarter == 3), invert)
    side = 1.0 / (1 << level).astype(float)
    s = (i[:, None] + np.array([0.5, 0, 1, 1, 0])) * side[:, None]
    t = (j[:, None] + np.array([0.5, 0, 0, 1, 1])) * side[:, None]
    u, v = (np.where(w >= 0.5, (4 * w * w - 1) / 3, (1 - 4 * (1 - w) ** 2) / 3) for w in (s, t))
    one = np.ones_like(u)
    axes = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)]
    x, y, z = (np.choose(face[:, None], [a[k] for a in axes]) for k in range(3))
    return np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.hypot(x, y)))


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("lon", "lat", "west", "south", "east", "north")]))
def s2_bounds(cell: pd.Series) -> pd.DataFrame:
    """Centre of a cell and the box of its corners (for cells away from the poles and 180 degrees)."""
    lon, lat = _s2_places(cell.to_numpy(np.int64))
    return pd.DataFrame({"lon": lon[:, 0], "lat": lat[:, 0], "west": lon[:, 1:].min(axis=1), "south": lat[:, 1:].min(axis=1), "east": lon[:, 1:].max(axis=1), "north": lat[:, 1:].max(axis=1)})


@F.pandas_udf(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))
def s2_ring(cell: pd.Series) -> pd.Series:
    """The corners of a cell as a closed ring, counter-clockwise (for cells away from the poles and 180 degrees)."""
    lon, lat = _s2_places(cell.to_numpy(np.int64))
    order = [1, 2, 3, 4, 1]
    return pd.Series([[{"x": x, "y": y} for x, y in zip(a, b, strict=True)] for a, b in zip(lon[:, order].tolist(), lat[:, order].tolist(), strict=True)])


def twd97_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Geographic coordinates of the island's 1997 datum (EPSG:3824) as WGS84 ones (EPSG:4326): the
    same to a few centimetres, and taken as the same."""
    return lon, lat


def s2_covering(spark, box: tuple[float, float, float, float], level: int) -> DataFrame:
    """``s2_cell`` and the bounds of every cell of a level whose bounds meet a box (west, south, east,
    north; away from the poles and 180 degrees).

    The box is sampled with steps of under half a cell's least side, beyond its edges by one cell.
    """
    west, south, east, north = box
    step = 0.4 * 90.0 / (1 << level) * 0.5
    margin = 4 * 90.0 / (1 << level)
    wide = step / max(0.01, float(np.cos(np.radians(max(abs(south), abs(north))))))
    columns, rows = int((east - west + 2 * margin) / wide) + 2, int((north - south + 2 * margin) / step) + 2
    places = spark.range(columns * rows).select((west - margin + (F.col("id") % columns) * wide).alias("lon"), (south - margin + F.floor(F.col("id") / columns) * step).alias("lat"))
    cells = places.select(s2_cell(level)("lon", "lat").alias("s2_cell")).distinct()
    placed = cells.select("s2_cell", s2_bounds("s2_cell").alias("b")).select("s2_cell", "b.*")
    return placed.where(box_overlaps(F.col("west"), F.col("south"), F.col("east"), F.col("north"), box))
