"""Lines, polygons and their joins against brute force."""

import math
import random

from pyspark.sql import functions as F

from geotally.functions import geometry as g
from geotally.operators.spatial_joins import points_near_boxes

RING = "array<struct<x:double,y:double>>"
RINGS = f"array<{RING}>"


def kite(rng, cx, cy, size):
    r = [size * (0.3 + rng.random()) for _ in range(4)]
    corners = [(cx + r[0], cy), (cx, cy + r[1]), (cx - r[2], cy), (cx, cy - r[3])]
    return [*corners, corners[0]]


def inside(ring, x, y):
    return all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))


def segment_distance(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = 0 if dx == dy == 0 else max(0, min(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def test_text_forms(spark):
    rows = [
        ("LINESTRING(0 0, 1 1e1)", 2, None), (" linestring ( -1.5 .5 ,2 3,4 5 ) ", 3, None), ("LINESTRING(0 0)", None, None), ("LINESTRING(0 0, x 1)", None, None), ("LINESTRING EMPTY", None, None),
        ("POLYGON((0 0, 1 0, 1 1, 0 0))", None, 1), ("POLYGON((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", None, 2), ("POLYGON((0 0, 1 0, 1 1))", None, None), ("POLYGON((0 0, 1 0, 1 1, 0 1))", None, None), (None, None, None), ("", None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, t string").orderBy("i")
    line, polygon = g.line_from_wkt(F.col("t")), g.polygon_from_wkt(F.col("t"))
    got = df.select("i", line.alias("l"), polygon.alias("p"), g.geometry_type(F.col("t")).alias("k"), g.is_empty(F.col("t")).alias("e")).orderBy("i").collect()
    assert [(r.l and len(r.l), r.p and len(r.p)) for r in got] == [(a, b) for _, a, b in rows]
    assert [r.k for r in got] == ["LINESTRING"] * 5 + ["POLYGON"] * 4 + [None, None] and [bool(r.e) for r in got] == [i == 4 for i in range(11)]
    many = spark.createDataFrame([("MULTILINESTRING((0 0, 1 1), (2 2, 3 3, 4 4))",), ("LINESTRING(0 0, 1 1)",), ("MULTILINESTRING((0 0))",)], "t string")
    assert [r.n for r in many.select(F.size(g.lines_from_wkt(F.col("t"))).alias("n")).collect()] == [2, 1, None]
    texts = ['{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[9,9],[8,9],[8,8],[9,9]]]]}', '{"type":"Point","coordinates":[1,2]}', "no json", '{"type":"Polygon","coordinates":[[[0,0],[1,null],[1,1],[0,0]]]}', None]
    rings = spark.createDataFrame([(t,) for t in texts], "t string").select(g.polygon_from_geojson(F.col("t")).alias("p"), g.line_from_geojson(F.lit('{"type":"LineString","coordinates":[[0,0],[1,2,3]]}')).alias("l")).collect()
    assert [r.p and len(r.p[0]) for r in rings] == [4, 4, None, None, None, None] and rings[0].l[1].y == 2
    back = spark.createDataFrame([([(0.12345, -1.0), (2.0, 3.5)],)], f"l {RING}").select(g.line_as_wkt(F.col("l"), 3).alias("t"), g.polygon_as_geojson(F.array("l"), 1).alias("j"))
    assert tuple(back.first()) == ("LINESTRING(0.123 -1.000, 2.000 3.500)", '{"type":"Polygon","coordinates":[[[0.1,-1.0],[2.0,3.5]]]}')


def test_measures_along_a_line(spark):
    df = spark.createDataFrame([([(121.5, 25.0), (121.51, 25.0), (121.52, 25.01)],), ([(1.0, 1.0), (1.0, 1.0)],)], f"l {RING}").select(g.measured(F.col("l")).alias("m"))
    first_edge = spark.createDataFrame([([(121.5, 25.0), (121.51, 25.0)],)], f"l {RING}").select(g.measured(F.col("l")).alias("m"))
    cut = first_edge.select(g.substring(F.col("m"), F.lit(0.25), F.lit(0.75)).alias("s")).first().s
    places = first_edge.select(*[g.locate(F.col("m"), F.lit(p.x), F.lit(p.y)).alias(f"at{i}") for i, p in enumerate(cut)]).first()
    assert len(cut) == 2 and abs(places.at0 - 0.25) < 1e-9 and abs(places.at1 - 0.75) < 1e-9
    whole, none = df.select(g.substring(F.col("m"), F.lit(0.1), F.lit(0.9)).alias("s"), g.locate(F.col("m"), F.lit(121.6), F.lit(25.2)).alias("end")).collect()
    assert len(whole.s) == 3 and whole.end == 1.0 and none.end is None


def test_rings_cut_to_boxes(spark):
    rng = random.Random(2)
    polygons = [(i, kite(rng, rng.uniform(0, 10), rng.uniform(0, 10), 4)) for i in range(30)]
    df = spark.createDataFrame(polygons, f"i int, ring {RING}")
    cut = df.select("i", g.clip_ring(F.col("ring"), F.lit(2), F.lit(3), F.lit(8), F.lit(7)).alias("ring"), g.signed_area(F.col("ring")).alias("whole"))
    found = {r.i: r for r in cut.select("i", "whole", g.signed_area(F.col("ring")).alias("area"), g.centroid(F.col("ring")).alias("c")).collect()}
    n = 160
    for i, ring in polygons:
        grid = [(2 + 6 * (a + 0.5) / n, 3 + 4 * (b + 0.5) / n) for a in range(n) for b in range(n)]
        hits = [p for p in grid if inside(ring, *p)]
        area = 24 * len(hits) / n / n
        assert abs((found[i].area or 0) - area) < 0.15 and (found[i].area or 0) <= found[i].whole + 1e-9
        if area > 1:
            assert abs(found[i].c.x - sum(x for x, _ in hits) / len(hits)) < 0.05 and abs(found[i].c.y - sum(y for _, y in hits) / len(hits)) < 0.05


def test_points_near_boxes_at_any_latitude(spark):
    boxes = spark.createDataFrame([(1, 10.0, 80.0, 10.1, 80.1), (2, 179.95, 10.0, 179.999, 10.1), (3, -179.999, -60.1, -179.9, -60.0), (4, 0.0, 89.99, 1.0, 89.999)], "box_id int, west double, south double, east double, north double")
    points = [(1, 10.115, 80.05), (2, 10.13, 80.05), (3, -179.9995, 10.05), (4, 179.9995, -60.05), (5, 170.0, 89.9995), (6, 0.5, 89.995), (7, 10.05, 80.05)]
    df = spark.createDataFrame(points, "point_id int, lon double, lat double")

    def metres(a, b, c, d):
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * 6371010.0 * math.asin(math.sqrt(h))

    want = set()
    for p, lon, lat in points:
        for r in boxes.collect():
            d = min(metres(lon, lat, min(r.east + t, max(r.west + t, lon)), min(r.north, max(r.south, lat))) for t in (-360, 0, 360))
            if d <= 300:
                want.add((p, r.box_id))
    assert {(1, 1), (3, 2), (4, 3), (6, 4), (7, 1)} <= want and (2, 1) not in want
    for size in (0.02, 0.5):
        found = [(r.point_id, r.box_id) for r in points_near_boxes(df, boxes, 300.0, size).collect()]
        assert len(found) == len(set(found)) and set(found) == want, size
