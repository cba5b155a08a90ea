"""Spatial joins by grid keys: candidates meet in an equal join, the exact test is its condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotally.functions.spatial import distance_m


def _tiles(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def boxes_by_tile(boxes: DataFrame, size: float, margin: float = 0.0, *, names: tuple[str, str, str, str] = ("west", "south", "east", "north")) -> DataFrame:
    """Each box (with a margin) once for each grid tile that it meets: columns tile_x, tile_y.

    The tile size should not be far under the boxes', so that a box meets few tiles.
    """
    w, s, e, n = (F.col(c) for c in names)
    across = boxes.withColumn("tile_x", F.explode(_tiles(w - margin, e + margin, size)))
    return across.withColumn("tile_y", F.explode(_tiles(s - margin, n + margin, size)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pairs of a point and a box that it is in (edges count).

    Distinct places are tested against distinct boxes; rows of either table that share one are joined to what it
    met, so work that makes no result doesn't grow with them.  Joins by tile are merge joins by hint: Spark's
    sizes leave out the factor of an explode.
    """
    sides = ["west", "south", "east", "north"]
    places = points.select(F.col(lon).alias("__lon"), F.col(lat).alias("__lat")).distinct()
    tiled = places.withColumns({"tile_x": F.floor(F.col("__lon") / size), "tile_y": F.floor(F.col("__lat") / size)})
    other = boxes_by_tile(boxes.select(*sides).distinct(), size).withColumnsRenamed({"tile_x": "__x", "tile_y": "__y"})
    inside = F.col("__lon").between(F.col("west"), F.col("east")) & F.col("__lat").between(F.col("south"), F.col("north"))
    met = tiled.hint("merge").join(other, (F.col("tile_x") == F.col("__x")) & (F.col("tile_y") == F.col("__y")) & inside).select("__lon", "__lat", *[F.col(c).alias(f"__{c}") for c in sides])
    boxed = met.hint("merge").join(boxes, [F.col(f"__{c}") == F.col(c) for c in sides]).select("__lon", "__lat", *boxes.columns)
    return points.hint("merge").join(boxed, (F.col(lon) == F.col("__lon")) & (F.col(lat) == F.col("__lat"))).drop("__lon", "__lat")


def box_distance_m(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Distance of a point to a box (zero inside), to its nearest place in degrees."""
    return distance_m(lon, lat, F.least(east, F.greatest(west, lon)), F.least(north, F.greatest(south, lat)))


def points_near_boxes(points: DataFrame, boxes: DataFrame, metres: float, size: float, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pairs of a point and a box no further than ``metres`` apart, with ``metres_apart``.

    A box is looked for at its latitudes, with a margin in longitude that grows towards the poles
    (all longitudes where a pole is within reach), and across 180 degrees.
    """
    tall = metres / 111_000.0
    outermost = F.greatest(F.abs("south"), F.abs("north")) + tall
    wide = F.when(outermost < 89.9, tall / F.cos(F.radians(outermost))).otherwise(360.0)
    turned = boxes.withColumn("__turn", F.explode(F.array(*map(F.lit, (-360.0, 0.0, 360.0)))))
    west, east = F.col("west") + F.col("__turn"), F.col("east") + F.col("__turn")
    low, high = F.greatest(west - wide, F.lit(-180.0)), F.least(east + wide, F.lit(180.0))
    placed = turned.withColumns({"__w": west, "__e": east, "__low": low, "__high": high}).where("__low <= __high")
    across = placed.withColumn("__x", F.explode(_tiles(F.col("__low"), F.col("__high"), size)))
    other = across.withColumn("__y", F.explode(_tiles(F.col("south") - tall, F.col("north") + tall, size)))
    tiled = points.withColumns({"tile_x": F.floor(F.col(lon) / size), "tile_y": F.floor(F.col(lat) / size)})
    apart = box_distance_m(F.col(lon), F.col(lat), F.col("__w"), F.col("south"), F.col("__e"), F.col("north"))
    joined = tiled.hint("merge").join(other, (F.col("tile_x") == F.col("__x")) & (F.col("tile_y") == F.col("__y")) & (apart <= metres))
    # A box is reached the shorter way round, the others don't count.
    gap = lambda turn: F.greatest(F.col("west") + turn - F.col(lon), F.col(lon) - F.col("east") - turn, F.lit(0.0))
    shorter = F.array_min(F.array(*[F.struct(gap(F.lit(x)).alias("gap"), F.lit(x).alias("turn")) for x in (-360.0, 0.0, 360.0)]))["turn"]
    return joined.where(F.col("__turn") == shorter).withColumn("metres_apart", apart).drop("tile_x", "tile_y", "__x", "__y", "__w", "__e", "__low", "__high", "__turn")


def nearest_of_few(points: DataFrame, centres: DataFrame, *, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each point's nearest of a few centres (broadcast as one array; the first by key of those that
    are as near to twelve places of the squared distance).

    For centres of a bounded number, such as districts: at most 10,000, else an error.
    """
    few = centres.select(F.struct(F.col(key).alias("k"), F.col("clon").alias("x"), F.col("clat").alias("y")).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("centres"))
    checked = few.where(F.assert_true(F.size("centres") <= 10_000, "too many centres").isNull())
    far = lambda c: F.round(F.pow(c["x"] - F.col(lon), F.lit(2)) + F.pow(c["y"] - F.col(lat), F.lit(2)), 12)
    best = F.array_min(F.transform("centres", lambda c: F.struct(far(c).alias("d"), c["k"].alias("k"))))
    return points.crossJoin(F.broadcast(checked)).withColumn("nearest", best["k"]).drop("centres")  # one row
