"""Lines and polygons as column expressions: text forms, measures along lines, clipping, areas.

A point is a struct of x and y, a line an array of points, a ring a closed line, a polygon an
array of rings (the outer one first).  Geometry is planar; invalid text is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_PAIR = rf"^\s*({_NUMBER})\s+({_NUMBER})\s*$"

#: The types of the text form.
TYPES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")


def _with(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry_type(wkt: Column) -> Column:
    """The type that a text names (null for others)."""
    name = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    return F.when(name.isin(*TYPES), name)


def is_empty(wkt: Column) -> Column:
    """Whether a text is a known type without any point."""
    return F.when(geometry_type(wkt).isNotNull(), wkt.rlike(r"(?i)^\s*[a-z]+\s+EMPTY\s*$"))


def _points(body: Column) -> Column:
    """Points of "x y, x y" (null if any is none)."""
    number = lambda p, i: F.regexp_extract(p, _PAIR, i).try_cast("double")
    found = F.transform(F.split(body, ","), lambda p: point(number(p, 1), number(p, 2)))
    return _with(found, lambda f: F.when(F.forall(f, lambda q: q["x"].isNotNull() & q["y"].isNotNull()), f))


def _body(wkt: Column, name: str, brackets: int) -> Column:
    inside = r"\(\s*" * brackets + r"([^()].*[^()])\s*" + r"\)\s*" * brackets
    found = F.regexp_extract(wkt, rf"(?is)^\s*{name}\s*{inside}$", 1)
    return _with(found, lambda f: F.when(f != "", f))


def line_from_wkt(wkt: Column) -> Column:
    """A line of at least two points."""
    return _with(_points(_body(wkt, "LINESTRING", 1)), lambda points: F.when(F.size(points) >= 2, points))


def lines_from_wkt(wkt: Column) -> Column:
    """The lines of a MULTILINESTRING, or the one of a LINESTRING."""
    parts = F.transform(F.split(_body(wkt, "MULTILINESTRING", 2), r"\)\s*,\s*\("), _points)
    many = F.when(F.forall(parts, lambda p: p.isNotNull() & (F.size(p) >= 2)), parts)
    one = line_from_wkt(wkt)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def _rings(rings: Column) -> Column:
    """The rings, if all are closed and have four points or more."""
    closed = lambda r: r.isNotNull() & (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))
    return F.when(F.forall(rings, closed), rings)


def polygon_from_wkt(wkt: Column) -> Column:
    """The rings of a POLYGON."""
    return _rings(F.transform(F.split(_body(wkt, "POLYGON", 2), r"\)\s*,\s*\("), _points))


def _split_rings(body: Column) -> Column:
    return _rings(F.transform(F.split(body, r"\)\s*,\s*\("), _points))


def polygons_from_wkt(wkt: Column) -> Column:
    """The polygons (arrays of rings) of a MULTIPOLYGON, or the one of a POLYGON."""
    parts = F.transform(F.split(_body(wkt, "MULTIPOLYGON", 3), r"\)\s*\)\s*,\s*\(\s*\("), _split_rings)
    many = F.when(F.forall(parts, lambda p: p.isNotNull()), parts)
    one = polygon_from_wkt(wkt)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def points_from_wkt(wkt: Column) -> Column:
    """The points of a MULTIPOINT (in brackets of their own or not), or the one of a POINT."""
    bare = F.regexp_replace(F.coalesce(_body(wkt, "MULTIPOINT", 2), _body(wkt, "MULTIPOINT", 1)), r"[()]", "")
    one = _points(_body(wkt, "POINT", 1))
    return F.coalesce(_points(bare), F.when(F.size(one) == 1, one))


def _pairs(coordinates: Column) -> Column:
    whole = F.forall(coordinates, lambda c: (F.size(c) >= 2) & F.get(c, 0).isNotNull() & F.get(c, 1).isNotNull())
    return F.when(whole, F.transform(coordinates, lambda c: point(F.get(c, 0), F.get(c, 1))))


def geojson_type(text: Column) -> Column:
    return F.get_json_object(text, "$.type")


def line_from_geojson(text: Column) -> Column:
    points = _pairs(F.from_json(F.get_json_object(text, "$.coordinates"), "array<array<double>>"))
    return F.when((geojson_type(text) == "LineString") & (F.size(points) >= 2), points)


def polygon_from_geojson(text: Column) -> Column:
    """The rings of a Polygon, or of the first polygon of a MultiPolygon; other types are null."""
    return F.get(polygons_from_geojson(text), 0)


def polygons_from_geojson(text: Column) -> Column:
    """The polygons of a MultiPolygon, or the one of a Polygon; other types are null."""
    coordinates = F.get_json_object(text, "$.coordinates")
    one = _rings(F.transform(F.from_json(coordinates, "array<array<array<double>>>"), _pairs))
    parts = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), lambda p: _rings(F.transform(p, _pairs)))
    kind = geojson_type(text)
    return F.when((kind == "Polygon") & one.isNotNull(), F.array(one)).when((kind == "MultiPolygon") & F.forall(parts, lambda p: p.isNotNull()), parts)


def oriented(rings: Column) -> Column:
    """A polygon's rings, the first counter-clockwise, the others (holes) clockwise."""
    return F.transform(rings, lambda r, i: F.when((signed_area(_moved(r)) >= 0) == (i == 0), r).otherwise(F.reverse(r)))


def _moved(ring: Column) -> Column:
    """A ring near the origin, where products of coordinates lose nothing."""
    return F.transform(ring, lambda p: point(p["x"] - F.element_at(ring, 1)["x"], p["y"] - F.element_at(ring, 1)["y"]))


def _number(x: Column, places: int) -> Column:
    return F.bround(x.cast(f"decimal(28,{places + 6})"), places).cast(f"decimal(28,{places})").cast("string")


def line_as_wkt(line: Column, places: int = 6) -> Column:
    """Text of a line with fixed places."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda p: F.concat(_number(p["x"], places), F.lit(" "), _number(p["y"], places))), ", "), F.lit(")"))


def polygon_as_geojson(rings: Column, places: int = 6) -> Column:
    """GeoJSON text of a polygon with fixed places."""
    pair = lambda p: F.concat(F.lit("["), _number(p["x"], places), F.lit(","), _number(p["y"], places), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, pair), ","), F.lit("]"))
    return F.concat(F.lit('{"type":"Polygon","coordinates":['), F.array_join(F.transform(rings, ring), ","), F.lit("]}"))


def vertex_mean(ring: Column) -> Column:
    """The mean of a ring's points, the closing one left out."""
    own = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    mean = lambda c: F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, p: s + p[c]), F.size(own).cast("double"))
    return point(mean("x"), mean("y"))


# --- measures along lines -----------------------------------------------------------------------

def measured(line: Column) -> Column:
    """Points with ``m``, the length of the line up to each."""
    first = F.element_at(line, 1)
    start = F.array(F.struct(first["x"].alias("x"), first["y"].alias("y"), F.lit(0.0).alias("m")))

    def add(found: Column, p: Column) -> Column:
        last = F.element_at(found, -1)
        return F.concat(found, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), (last["m"] + F.hypot(p["x"] - last["x"], p["y"] - last["y"])).alias("m"))))

    return F.when(F.size(line) >= 1, F.aggregate(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), start, add))


def locate(measured_line: Column, x: Column, y: Column) -> Column:
    """Share of the line's length at the place nearest to a point (the first of equally near ones);
    null for a line without length."""
    p = measured_line
    total = F.element_at(p, -1)["m"]

    def place(i: Column) -> Column:
        a, b = F.element_at(p, i), F.element_at(p, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.struct(F.round(F.hypot(x - (a["x"] + t * dx), y - (a["y"] + t * dy)), 9).alias("d"), (a["m"] + t * (b["m"] - a["m"])).alias("m"))

    nearest = F.array_min(F.transform(F.sequence(F.lit(1), F.size(p) - 1), place))
    return F.when((F.size(p) >= 2) & (total > 0), nearest["m"] / total)


def interpolate(measured_line: Column, m: Column) -> Column:
    """The point at length ``m`` of a line."""
    p = measured_line
    i = F.greatest(F.lit(1), F.least(F.size(p) - 1, F.size(F.filter(p, lambda q: q["m"] < m))))

    def between(s: Column) -> Column:
        a, b = s["a"], s["b"]
        t = F.coalesce(F.try_divide(m - a["m"], b["m"] - a["m"]), F.lit(0.0))
        return point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))

    return _with(F.struct(F.element_at(p, i).alias("a"), F.element_at(p, i + 1).alias("b")), between)


def substring(measured_line: Column, start: Column, stop: Column) -> Column:
    """The part of a line between two shares of its length."""
    p = measured_line
    a, b = start * F.element_at(p, -1)["m"], stop * F.element_at(p, -1)["m"]
    between = F.transform(F.filter(p, lambda q: (q["m"] > a) & (q["m"] < b)), lambda q: point(q["x"], q["y"]))
    return F.when((F.size(p) >= 2) & (start <= stop), F.concat(F.array(interpolate(p, a)), between, F.array(interpolate(p, b))))


# --- polygons -----------------------------------------------------------------------------------

def edges(ring: Column) -> Column:
    """Array of ax, ay, bx, by, in the order of a closed ring."""
    return F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )


def signed_area(ring: Column) -> Column:
    """Area of a closed ring, positive if it runs counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def centroid(ring: Column) -> Column:
    """Centroid of a closed ring's area; null if that is zero."""
    sums = F.aggregate(
        edges(ring), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, e: F.struct(
            (s["a"] + (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("a"), (s["x"] + (e["ax"] + e["bx"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("x"),
            (s["y"] + (e["ay"] + e["by"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("y"),
        ),
    )
    return F.when(sums["a"] != 0, point(F.try_divide(sums["x"], 3 * sums["a"]), F.try_divide(sums["y"], 3 * sums["a"])))


def clip_parameters(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """Part of a segment inside a convex counter-clockwise ring: struct low, high (0 to 1 along the
    segment), null if it has none.  A part along an edge is inside."""
    dx, dy = x2 - x1, y2 - y1
    sides = F.transform(
        edges(ring),
        lambda e: F.struct(
            ((e["bx"] - e["ax"]) * (y1 - e["ay"]) - (e["by"] - e["ay"]) * (x1 - e["ax"])).alias("at"),
            ((e["bx"] - e["ax"]) * dy - (e["by"] - e["ay"]) * dx).alias("rise"),
        ),
    )
    cut = lambda s: F.try_divide(-s["at"], s["rise"])
    low = F.greatest(F.lit(0.0), F.array_max(F.transform(sides, lambda s: F.when(s["rise"] > 0, cut(s)))))
    high = F.least(F.lit(1.0), F.array_min(F.transform(sides, lambda s: F.when(s["rise"] < 0, cut(s)))))
    miss = F.exists(sides, lambda s: (s["rise"] == 0) & (s["at"] < 0))
    return F.when(~miss & (low < high), F.struct(low.alias("low"), high.alias("high")))


def clip_ring(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed ring cut to a box (side by side); null if nothing with an area is left."""
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.cast("double").alias("c")) for a, b, c in ((1.0, 0.0, -west), (-1.0, 0.0, east), (0.0, 1.0, -south), (0.0, -1.0, north))])
    none = F.array().cast(f"array<{POINT}>")

    def cut(now: Column, side: Column) -> Column:
        depth = lambda p: side["a"] * p["x"] + side["b"] * p["y"] + side["c"]

        def step(i: Column) -> Column:
            p, q = F.element_at(now, i), F.element_at(now, i % F.size(now) + 1)
            return _with(F.struct(p.alias("p"), q.alias("q"), depth(p).alias("d"), depth(q).alias("e")), kept)

        def kept(s: Column) -> Column:
            p, q, d, e = s["p"], s["q"], s["d"], s["e"]
            t = F.coalesce(F.try_divide(d, d - e), F.lit(0.0))
            crossing = F.array(point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"])))
            return F.when((d >= 0) & (e >= 0), F.array(q)).when(d >= 0, crossing).when(e >= 0, F.concat(crossing, F.array(q))).otherwise(none)

        return F.when(F.size(now) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(now)), step))).otherwise(none)

    open_ring = F.slice(ring, 1, F.size(ring) - 1).cast(f"array<{POINT}>")
    closed = lambda left: F.when(F.size(left) >= 3, F.concat(left, F.slice(left, 1, 1)))
    return _with(_with(F.aggregate(sides, open_ring, cut), closed), lambda r: F.when(signed_area(r) != 0, r))


def ring_distance(x: Column, y: Column, ring: Column, x_scale: Column, y_scale: Column) -> Column:
    """Distance of a point to a convex counter-clockwise ring, zero inside, in scaled units."""
    def apart(e: Column) -> Column:
        ax, ay, bx, by = (e["ax"] - x) * x_scale, (e["ay"] - y) * y_scale, (e["bx"] - x) * x_scale, (e["by"] - y) * y_scale
        dx, dy = bx - ax, by - ay
        t = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.hypot(ax + t * dx, ay + t * dy)

    inside = F.forall(edges(ring), lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]) >= 0)
    return F.when(inside, F.lit(0.0)).otherwise(F.array_min(F.transform(edges(ring), apart)))
