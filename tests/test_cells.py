"""Areas on the ellipsoid, cells cut to boundaries, validity, and the census of lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geotally.functions import geometry as g
from geotally.functions import spatial
from geotally.operators.census import TERMINAL, census, visited_links
from geotally.operators.polygons import cut_areas, polygon_edges, validity

RINGS = "array<array<struct<x:double,y:double>>>"


def whole_area(df, key, straight):
    """Area of polygons by all their edges."""
    under = spatial.area_under(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), straight=straight)
    return {r[0]: r[1] for r in polygon_edges(df, key).groupBy(key).agg(-F.sum(under)).collect()}


def test_area_under_edges(spark):
    rows = [(i, *b) for i, b in enumerate([(121.5, 25.0, 121.504, 25.003), (0.0, 0.0, 1.0, 1.0), (10.0, -60.2, 10.01, -60.19), (-179.0, 70.0, -178.9, 70.2)])]
    boxes = spark.createDataFrame(rows, "k int, w double, s double, e double, n double")
    corners = [("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s")]
    rings = boxes.select("k", F.array(F.array(*[g.point(F.col(x), F.col(y)) for x, y in corners])).alias("rings"))
    want = {r.k: r.a for r in boxes.select("k", spatial.box_area_m2(*map(F.col, "wsen")).alias("a")).collect()}
    straight, geodesic = whole_area(rings, "k", True), whole_area(rings, "k", False)
    for k, area in want.items():
        assert abs(straight[k] / area - 1) < 1e-9
        # Great circles leave the parallels: by the square of the box's width.
        assert abs(geodesic[k] / area - 1) < 1e-6 + 1e-4 * (rows[k][3] - rows[k][1]) ** 2
    hemisphere = spark.createDataFrame([(1, [[(0.0, 0.0), (90.0, 0.0), (0.0, 90.0), (0.0, 0.0)]])], f"k int, rings {RINGS}")
    assert abs(whole_area(hemisphere, "k", False)[1] / (510_065_621_724_078.9 / 8) - 1) < 1e-8  # an eighth of the ellipsoid


def test_cells_of_a_covering_add_up_to_the_boundary(spark):
    dented = [(121.50, 25.00), (121.53, 25.005), (121.515, 25.02), (121.54, 25.04), (121.49, 25.035), (121.50, 25.00)]
    hole = [(121.505, 25.01), (121.507, 25.015), (121.512, 25.016), (121.511, 25.009), (121.505, 25.01)]
    far = [(121.56, 25.01), (121.57, 25.01), (121.565, 25.02), (121.56, 25.01)]
    table = spark.createDataFrame([(1, [[dented[::-1], hole], [far]])], f"k int, parts array<{RINGS}>")
    boundary = table.select("k", F.flatten(F.transform("parts", g.oriented)).alias("rings"))
    covering = spatial.s2_covering(spark, (121.49, 25.0, 121.57, 25.04), 15).select("s2_cell")
    cells = covering.select("s2_cell", F.array(spatial.s2_ring("s2_cell")).alias("rings"))
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    for straight in (True, False):
        parts = cut_areas(cells, "s2_cell", boundary, "k", 0.004, straight=straight).collect()
        whole = whole_area(boundary, "k", straight)[1]
        # With geodesics the edges' pieces bend a little less than the edges.
        assert abs(sum(r.area_m2 for r in parts) / whole - 1) < (1e-9 if straight else 1e-4)
    full = whole_area(cells, "s2_cell", True)
    inside = [r for r in parts if r.area_m2 > full[r.s2_cell] * (1 - 1e-6)]
    assert len(inside) > 20 and len(parts) < len(full) and all(r.area_m2 <= full[r.s2_cell] * (1 + 1e-6) for r in parts)
    assert all(121.48 < r.lon < 121.58 and 24.99 < r.lat < 25.05 for r in parts)


def test_cells_beside_and_along_a_boundary(spark):
    square = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]
    cells = spark.createDataFrame([(1, square(0.0, 0.0, 1.0)), (2, square(1.0, 0.0, 1.0)), (3, square(-1.0, 0.0, 1.0)), (4, square(0.25, 0.25, 0.5)), (5, square(0.0, 1.0, 1.0)), (6, square(0.5, 0.5, 1.0))], f"c int, rings {RINGS}")
    boundary = spark.createDataFrame([(1, square(0.0, 0.0, 1.0))], f"k int, rings {RINGS}")
    found = {r.c: (r.lon, r.lat) for r in cut_areas(cells, "c", boundary, "k", 0.4, straight=True).collect()}
    assert found.keys() == {1, 4, 6}
    for c, middle in ((1, 0.5), (4, 0.5), (6, 0.75)):
        assert all(abs(v - middle) < 1e-9 for v in found[c])


def test_several_parts_from_text(spark):
    texts = ["MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2), (2.5 2.1, 2.6 2.1, 2.6 2.2, 2.5 2.1)))", "POLYGON((0 0, 1 0, 1 1, 0 0))", "MULTIPOLYGON(((0 0, 1 0)))", "MULTIPOINT((0 0), (1 2))", "MULTIPOINT(0 0, 1 2, 3 4)", "POINT(5 6)", "POINT(5)", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", g.polygons_from_wkt(F.col("t")).alias("p"), g.points_from_wkt(F.col("t")).alias("q")).orderBy("i").collect()
    assert [r.p and [len(x) for x in r.p] for r in found] == [[1, 2], [1], None, None, None, None, None, None]
    assert [r.q and len(r.q) for r in found] == [None, None, None, 2, 3, 1, None, None]
    json = spark.createDataFrame([('{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[9,9],[8,9],[8,8],[9,9]]]]}',)], "t string")
    assert [len(x) for x in json.select(g.polygons_from_geojson(F.col("t")).alias("p")).first().p] == [1, 1]


def test_validity(spark):
    """Faults at any tile size; rings that touch in a place are no fault."""
    from geotally.plans.geometry import FAULTS

    texts = [*FAULTS, ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (0 2, 2 1, 2 3, 0 2))", None), ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 9 1, 9 2, 1 2, 1 1))", "CROSSING"), ("POLYGON((0 0, 4 0, 2 0, 2 4, 0 0))", "CROSSING")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string").select("i", g.polygons_from_wkt(F.col("t")).alias("parts"))
    for size in (0.7, 30.0):
        assert {r.i: r.fault for r in validity(df, "i", size).collect()} == {i: f for i, (_, f) in enumerate(texts)}
    n = 3000
    ring = [(100 * math.cos(2 * math.pi * i / n), 100 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    bad = [*ring[:1000], ring[1001], ring[1000], *ring[1002:]]
    many = spark.createDataFrame([(1, [[[*ring, ring[0]]]]), (2, [[[*bad, bad[0]]]])], f"i int, parts array<{RINGS}>")
    assert {r.i: r.fault for r in validity(many, "i", 5.0).collect()} == {1: None, 2: "CROSSING"}


def test_census(spark):
    square = lambda x, y: [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]
    cells = spark.createDataFrame([(i, square(float(i % 3), float(i // 3))) for i in range(6) if i != 4], f"cell_id int, rings {RINGS}")
    lines = [
        ("off", False, "LINESTRING(0.2 0.2, 0.8 0.8)", 0), ("null", True, None, 1), ("point", True, "POINT(1 1)", 2), ("multi", True, "MULTILINESTRING((0 0, 1 1), (2 2, 3 3))", 2), ("none", True, "CIRCLE(1)", 2),
        ("empty", True, "LINESTRING EMPTY", 3), ("one", True, "LINESTRING(1 1)", 3), ("flat", True, "LINESTRING(0.2 0.2, 0.2 0.2, 0.5 0.5)", 4), ("hole", True, "LINESTRING(0.5 1.5, 2.5 1.5)", 5),
        ("outside", True, "LINESTRING(0.5 0.5, -0.5 0.5)", 5), ("edge", True, "LINESTRING(1 0.2, 1 0.8)", 6), ("rim", True, "LINESTRING(0.1 0, 0.9 0)", 8), ("twice", True, "LINESTRING(0.1 0.1, 0.9 0.1)", 7), ("twice", True, "LINESTRING(0.1 0.1, 0.9 0.1)", 7),
        ("along", True, "LINESTRING(0.5 0.5, 2.5 0.6, 2.4 0.2, 0.2 0.3)", 8), ("up", True, "LINESTRING(0.5 0.5, 0.6 1.5, 0.5 0.7)", 8), (None, True, "LINESTRING(0.5 0.5, 0.6 0.5)", 8), ("unknown", None, "LINESTRING(0 0, 1 1)", 0),
    ]
    sources = spark.createDataFrame([x[:3] for x in lines], "source_key string, is_active boolean, wkt string")
    for size in (0.3, 10.0):
        classes, visits = census(sources, cells, size)
        found = {r.source_key: r.terminal_class for r in classes.collect()}
        assert found | {None: None} == {k: TERMINAL[c] for k, _, _, c in lines} | {None: None}
        links = sorted((r.source_key, r.from_cell, r.to_cell) for r in visited_links(visits).collect() if r.source_key)
        assert links == [("along", 0, 1), ("along", 1, 2), ("up", 0, 3)]


def test_census_against_steps_along_the_lines(spark):
    """Random lines over a wall of squares: covered and visited as small steps say."""
    rng = random.Random(5)
    cells = {(x, y): 10 * x + y for x in range(6) for y in range(6) if rng.random() < 0.9}
    rows = [(k, [[(float(a), float(b)) for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))]]) for (x, y), k in cells.items()]
    table = spark.createDataFrame(rows, f"cell_id int, rings {RINGS}")
    lines = []
    for i in range(120):
        x, y, points = rng.uniform(1, 5), rng.uniform(1, 5), []
        for _ in range(rng.randint(2, 4)):
            points.append((x, y))
            x, y = x + rng.uniform(-1.5, 1.5), y + rng.uniform(-1.5, 1.5)
        lines.append((i, points))
    sources = spark.createDataFrame([(str(i), True, "LINESTRING(" + ", ".join(f"{x!r} {y!r}" for x, y in p) + ")") for i, p in lines], "source_key string, is_active boolean, wkt string")
    classes, visits = census(sources, table, 0.8)
    found = {r.source_key: r.terminal_class for r in classes.collect()}
    links = {}
    for r in visited_links(visits).collect():
        links.setdefault(r.source_key, set()).add((r.from_cell, r.to_cell))
    admitted = 0
    for i, points in lines:
        steps = [(a + t / 5000 * (c - a), b + t / 5000 * (d - b)) for (a, b), (c, d) in zip(points, points[1:]) for t in range(5001)]
        seen = [cells.get((math.floor(x), math.floor(y))) for x, y in steps]
        if None in seen:
            assert found[str(i)] == TERMINAL[5]
            continue
        admitted += 1
        assert found[str(i)] == TERMINAL[8]
        walked = {tuple(sorted(p)) for p in zip(seen, seen[1:]) if p[0] != p[1]}
        assert walked <= links.get(str(i), set()) and len(links.get(str(i), set()) - walked) <= 1  # a corner cut between two steps
    assert admitted > 20


def counted(df):
    """Shuffles and joins of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("Exchange" in x for x in lines), sum("Join" in x for x in lines)


def census_of_two(spark):
    cells = spark.createDataFrame([(i, [[(float(x), 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0), (float(x), 1.0), (float(x), 0.0)]]) for i, x in ((1, 0), (2, 1))], f"cell_id int, rings {RINGS}")
    lines = [("in", "LINESTRING(0.2 0.2, 1.8 0.2, 1.8 0.4)"), ("out", "LINESTRING(0.2 0.2, 2.2 0.2)"), ("late", "LINESTRING(0.5 0.5, 0.6 0.5, 5 5)"), ("far", "LINESTRING(7 7, 8 8)")]
    return census(spark.createDataFrame([(k, True, w) for k, w in lines], "source_key string, is_active boolean, wkt string"), cells, 1.0)


@pytest.fixture
def unwritten(monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def fail(*_, **__):
        raise AssertionError("a step was written")

    monkeypatch.setattr(DataFrame, "checkpoint", fail)


def test_classes_deal_parts_once(spark, unwritten):
    """Parts and what sources say of themselves are dealt by source once; nothing is written or joined."""
    classes, _ = census_of_two(spark)
    assert counted(classes) == (1, 0)
    assert {r.source_key: r.terminal_class for r in classes.collect()} == {"in": TERMINAL[8], "out": TERMINAL[5], "late": TERMINAL[5], "far": TERMINAL[5]}


def test_visits_deal_parts_once(spark, unwritten):
    _, visits = census_of_two(spark)
    assert counted(visits) == (1, 0)
    got = sorted((r.source_key, r.edge, r.cell_id, round(r.low, 6), round(r.high, 6)) for r in visits.collect())
    assert got == [("in", 1, 1, 0.0, 0.5), ("in", 1, 2, 0.5, 1.0), ("in", 2, 2, 0.0, 1.0)]


def test_census_by_joins_of_tiles_is_the_same(spark, monkeypatch):
    from geotally.operators import polygons

    want = [sorted(map(tuple, df.collect())) for df in census_of_two(spark)]
    monkeypatch.setattr(polygons, "INDEX_EDGES", 0)
    assert [sorted(map(tuple, df.collect())) for df in census_of_two(spark)] == want
    monkeypatch.setattr(polygons, "CORNERS", 0)
    assert [sorted(map(tuple, df.collect())) for df in census_of_two(spark)] == want


def test_pipe_links_write_texts_once(spark, unwritten, monkeypatch):
    """The texts are one written table for classes, visits and lengths; no step is a checkpoint."""
    from geotally import catalog
    from geotally.plans import pipes

    kinds, write = [], pipes.written
    monkeypatch.setattr(pipes, "written", lambda df, kind: kinds.append(kind) or write(df, kind))
    assert catalog.QUERIES["pipe_links"](spark, "/root/testdata/sf0.001").count() > 0
    assert kinds == ["pipes"]
