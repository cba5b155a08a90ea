"""Spatial queries over points and boxes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.functions import spatial
from geotally.operators.spatial_joins import nearest_of_few, points_in_boxes, points_near_boxes
from geotally.plans.base import Tables
from geotally.plans.registry import query

SIZE = 0.02

SQL_POINTS = "pts AS (SELECT o_orderkey AS point_id, o_custkey AS cell_id, 121.45 + (o_orderkey * 7919 % 20000) / 1e5 AS lon, 25.0 + (o_orderkey * 104729 % 20000) / 1e5 AS lat FROM orders)"
SQL_BOXES = """boxes AS (SELECT s_suppkey AS box_id, 121.45 + (s_suppkey * 4801 % 20000) / 1e5 AS west, 25.0 + (s_suppkey * 3301 % 20000) / 1e5 AS south,
  121.45 + (s_suppkey * 4801 % 20000) / 1e5 + 0.004 AS east, 25.0 + (s_suppkey * 3301 % 20000) / 1e5 + 0.003 AS north FROM supplier)"""


def boxes(t: Tables) -> DataFrame:
    west = 121.45 + (F.col("s_suppkey") * 4801 % 20000) / 1e5
    south = 25.0 + (F.col("s_suppkey") * 3301 % 20000) / 1e5
    return t.supplier.select(F.col("s_suppkey").alias("box_id"), west.alias("west"), south.alias("south"), (west + 0.004).alias("east"), (south + 0.003).alias("north"))


@query(f"WITH {SQL_POINTS}, {SQL_BOXES} SELECT point_id, box_id FROM pts JOIN boxes ON lon BETWEEN west AND east AND lat BETWEEN south AND north")
def hit_test_range_join(t: Tables) -> DataFrame:
    """Points in boxes, through grid tiles."""
    return points_in_boxes(t.points().drop("cell_id"), boxes(t), SIZE).select("point_id", "box_id")


def _sql_metres(lon: str, lat: str, x: str, y: str) -> str:
    return f"2 * 6371010.0 * asin(least(1.0, sqrt(pow(sin(radians({y} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({y})) * pow(sin(radians({x} - {lon}) / 2), 2))))"


@query(f"""WITH {SQL_POINTS}, {SQL_BOXES}, apart AS (SELECT box_id, point_id, {_sql_metres("lon", "lat", "least(east, greatest(west, lon))", "least(north, greatest(south, lat))")} AS m FROM boxes, pts)
SELECT box_id, w.metres, count(DISTINCT point_id) AS n_points FROM boxes CROSS JOIN (VALUES (0), (150), (300)) w(metres) LEFT JOIN apart USING (box_id) WHERE m <= metres GROUP BY 1, 2
UNION ALL SELECT box_id, w.metres, 0 FROM boxes CROSS JOIN (VALUES (0), (150), (300)) w(metres) WHERE NOT EXISTS (SELECT 1 FROM apart a WHERE a.box_id = boxes.box_id AND m <= w.metres)""")
def window_counts_distance(t: Tables) -> DataFrame:
    """Points within three distances of each box; boxes without any stay with zero."""
    sides = ["west", "south", "east", "north"]
    # Points of one place are one row with their number, and equal boxes are one.
    places = t.points().groupBy("lon", "lat").agg(F.countDistinct("point_id").alias("points"))
    near = points_near_boxes(places, boxes(t).select(*sides).distinct(), 300.0, SIZE)
    windows = boxes(t).withColumn("metres", F.explode(F.array(*map(F.lit, (0, 150, 300)))))
    counted = near.select(*sides, "points", F.explode(F.filter(F.array(*map(F.lit, (0, 150, 300))), lambda m: F.col("metres_apart") <= m)).alias("metres")).groupBy(*sides, "metres").agg(F.sum("points").alias("n"))
    return windows.join(counted, [*sides, "metres"], "left").select("box_id", "metres", F.coalesce("n", F.lit(0)).alias("n_points"))


@query(f"""WITH {SQL_POINTS}, centres AS (SELECT n_nationkey AS k, 121.45 + (n_nationkey * 37 % 25) / 125.0 AS clon, 25.0 + (n_nationkey * 11 % 25) / 125.0 AS clat FROM nation)
SELECT point_id, arg_min(k, (round(pow(clon - lon, 2) + pow(clat - lat, 2), 12), k)) AS nearest FROM pts, centres GROUP BY point_id""")
def nearest_centroid(t: Tables) -> DataFrame:
    """Each point's nearest district."""
    centres = t.nation.select(F.col("n_nationkey").alias("k"), (121.45 + (F.col("n_nationkey") * 37 % 25) / 125.0).alias("clon"), (25.0 + (F.col("n_nationkey") * 11 % 25) / 125.0).alias("clat"))
    return nearest_of_few(t.points().select("point_id", "lon", "lat"), centres, key="k").select("point_id", "nearest")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER w AS edge, l_partkey % 1000 AS x1, l_suppkey AS y1,
  lead(l_partkey % 1000) OVER w AS x2, lead(l_suppkey) OVER w AS y2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice))
SELECT l_orderkey AS source_id, edge::INTEGER AS edge, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS length FROM v WHERE x2 IS NOT NULL""")
def elementary_edges(t: Tables) -> DataFrame:
    """Edges of each source's line of points; a line of one point has none."""
    place = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("source_id")).agg(F.array_sort(F.collect_list(place)).alias("p"))
    points = F.transform("p", lambda p: F.struct((p["l_partkey"] % 1000).cast("double").alias("x"), p["l_suppkey"].cast("double").alias("y")))
    edges = lines.select("source_id", points.alias("points")).select("source_id", F.inline(spatial.elementary_edges(F.col("points"))))
    return edges.withColumn("length", F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6))


SQL_CLIP = """segs AS (SELECT o_orderkey AS source_id, (o_orderkey * 31 % 1000)::DOUBLE AS x1, (o_orderkey * 17 % 1000)::DOUBLE AS y1, (o_orderkey * 31 % 1000 + o_custkey % 60 - 30)::DOUBLE AS x2, (o_orderkey * 17 % 1000 + o_custkey % 47 - 23)::DOUBLE AS y2 FROM orders),
grid AS (SELECT source_id, x1, y1, x2, y2, gx, gy FROM (SELECT *, unnest(range(floor(least(x1, x2) / 50)::INT, floor(greatest(x1, x2) / 50)::INT + 1)) AS gx FROM segs), LATERAL (SELECT unnest(range(floor(least(y1, y2) / 50)::INT, floor(greatest(y1, y2) / 50)::INT + 1)) AS gy)),
t AS (SELECT *, greatest(0.0, CASE WHEN x2 > x1 THEN (gx * 50 - x1) / (x2 - x1) WHEN x2 < x1 THEN (gx * 50 + 50 - x1) / (x2 - x1) ELSE 0 END, CASE WHEN y2 > y1 THEN (gy * 50 - y1) / (y2 - y1) WHEN y2 < y1 THEN (gy * 50 + 50 - y1) / (y2 - y1) ELSE 0 END) AS low,
  least(1.0, CASE WHEN x2 > x1 THEN (gx * 50 + 50 - x1) / (x2 - x1) WHEN x2 < x1 THEN (gx * 50 - x1) / (x2 - x1) ELSE 1 END, CASE WHEN y2 > y1 THEN (gy * 50 + 50 - y1) / (y2 - y1) WHEN y2 < y1 THEN (gy * 50 - y1) / (y2 - y1) ELSE 1 END) AS high FROM grid)"""


@query(f"WITH {SQL_CLIP} SELECT source_id, gx::BIGINT AS gx, gy::BIGINT AS gy, round(low, 9) AS low, round(high, 9) AS high FROM t WHERE low < high")
def clipped_fragments(t: Tables) -> DataFrame:
    """Segments cut to grid cells: the part of each inside a cell, as parameters along it."""
    size = 50.0
    x, y = F.col("o_orderkey") * 31 % 1000, F.col("o_orderkey") * 17 % 1000
    segments = t.orders.select(F.col("o_orderkey").alias("source_id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + F.col("o_custkey") % 60 - 30).cast("double").alias("x2"), (y + F.col("o_custkey") % 47 - 23).cast("double").alias("y2"))
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    cells = segments.withColumn("gx", F.explode(span("x1", "x2"))).withColumn("gy", F.explode(span("y1", "y2")))
    part = spatial.clip_parameters(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("gx") * size, F.col("gy") * size, (F.col("gx") + 1) * size, (F.col("gy") + 1) * size)
    return cells.withColumn("part", part).where("part IS NOT NULL").select("source_id", "gx", "gy", F.round("part.low", 9).alias("low"), F.round("part.high", 9).alias("high"))


@query(f"WITH {SQL_POINTS} SELECT point_id, round(0.9 * exp(-(pow((lon - 121.52) * 111.0, 2) + pow((lat - 25.04) * 111.0, 2)) / 5.2) + 0.6 * exp(-(pow((lon - 121.6) * 111.0, 2) + pow((lat - 25.12) * 111.0, 2)) / 5.2), 9) AS density FROM pts")
def kernel_density(t: Tables) -> DataFrame:
    """Weighted kernels at a few cores."""
    return t.points().select("point_id", F.round(spatial.kernel_density(F.col("lon"), F.col("lat"), [(121.52, 25.04, 0.9), (121.6, 25.12, 0.6)]), 9).alias("density"))


@query()
def s2_cells(t: Tables) -> DataFrame:
    """Orders by their level-15 cell (cell ids are beyond SQL; tests have known ids)."""
    cell = spatial.s2_cell(15)
    placed = t.points().select("point_id", cell("lon", "lat").alias("s2_cell"))
    return placed.groupBy("s2_cell").agg(F.count("*").alias("n_points")).withColumn("token", spatial.cell_token(F.col("s2_cell")))


@query()
def projected_points(t: Tables) -> DataFrame:
    """Plane coordinates to degrees (tests have known places)."""
    plane = t.orders.select(F.col("o_orderkey").alias("point_id"), (300_000.0 + F.col("o_orderkey") * 7919 % 20000).alias("x"), (2_760_000.0 + F.col("o_orderkey") * 104729 % 20000).alias("y"))
    return plane.select("point_id", spatial.tm2_to_degrees("x", "y").alias("at")).select("point_id", F.round("at.lon", 9).alias("lon"), F.round("at.lat", 9).alias("lat"))


@query(f"""WITH {SQL_POINTS} SELECT point_id FROM pts WHERE lat > 25.02 AND lat < 25.12 AND lon > 121.48 + (lat - 25.02) * 0.5 AND lon < 121.6""")
def point_in_polygon(t: Tables) -> DataFrame:
    """Points inside a ring, by the even-odd rule; those on the ring are not inside."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((121.48, 25.02), (121.6, 25.02), (121.6, 25.12), (121.53, 25.12))])
    lon, lat = F.col("lon"), F.col("lat")
    return t.points().where(spatial.inside_ring(lon, lat, ring) & ~spatial.on_ring(lon, lat, ring)).select("point_id")


@query(f"""WITH {SQL_BOXES}, q AS (SELECT *, 0.0818191910428158 AS e, sin(radians(north)) AS n, sin(radians(south)) AS s FROM boxes)
SELECT box_id, round(radians(east - west) * 6378137.0 * 6378137.0 * (1 - e * e) / 2 * ((n / (1 - e * e * n * n) + ln((1 + e * n) / (1 - e * n)) / (2 * e)) - (s / (1 - e * e * s * s) + ln((1 + e * s) / (1 - e * s)) / (2 * e))), 1) AS area_m2 FROM q""")
def box_areas(t: Tables) -> DataFrame:
    """Ellipsoidal areas of boxes."""
    return boxes(t).select("box_id", F.round(spatial.box_area_m2(F.col("west"), F.col("south"), F.col("east"), F.col("north")), 1).alias("area_m2"))


@query()
def s2_cell_bounds(t: Tables) -> DataFrame:
    """Centres and bounds of the cells that have orders, with their areas (tests have the geometry)."""
    cells = t.points().select(spatial.s2_cell(15)("lon", "lat").alias("s2_cell")).distinct()
    placed = cells.select("s2_cell", spatial.s2_bounds("s2_cell").alias("b")).select("s2_cell", "b.*")
    return placed.withColumn("box_area_m2", spatial.box_area_m2(F.col("west"), F.col("south"), F.col("east"), F.col("north")))


@query()
def grid_covering(t: Tables) -> DataFrame:
    """The level-13 cells that cover the box of all points, with their points (tests have a brute-force
    covering); every point is in one of them."""
    at = t.points()
    sides = at.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    if sides[0] is None:
        sides = (0.0, 0.0, 0.0, 0.0)
    counts = at.select(spatial.s2_cell(13)("lon", "lat").alias("of_cell")).groupBy("of_cell").agg(F.count("*").alias("n"))
    covering = spatial.s2_covering(t.spark, tuple(sides), 13)
    return covering.join(counts, F.col("s2_cell") == F.col("of_cell"), "left").select("s2_cell", spatial.cell_token(F.col("s2_cell")).alias("token"), F.coalesce("n", F.lit(0)).alias("n_points"))
