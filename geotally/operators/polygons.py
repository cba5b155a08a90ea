"""Joins of lines, points and polygons of any shape through grid tiles.

A polygon is an array of rings (``rings``): the outer ones of all its parts and their holes, in any
direction; inside is what an odd number of edges separates from the outside, and the boundary
belongs to it.  Edges are dealt to the tiles that they pass through one by one, so a ring of very
many corners is no single row.  For each polygon and row of tiles a running count of crossings says
which lower left corners of tiles are inside; a point is then inside if its tile's corner is, turned
by each edge of that tile alone that the way from corner to point crosses.  Grid lines lie
at an odd share of a tile, where coordinates of data don't.

Joins by tile are merge joins by hint: Spark's sizes leave out the factor of an explode, and what is dealt to tiles
would be broadcast though it is large (the joins themselves then run in as few tasks as the other table has files).

Segments are cut to polygons of few corners pair by pair, in arrays within a task (``functions.cutting``): a row for
each crossing, as edges dealt one by one give it, is many times what comes out.  All such polygons of a table whose edges were
counted and are no more than ``INDEX_EDGES`` are an index that each task has; of larger tables each polygon is a row
for each tile of its extent, joined by tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from geotally.functions import cutting, geometry
from geotally.functions.cutting import OFFSET, TOLERANCE
from geotally.functions.spatial import EARTH_RADIUS_M, area_under
from geotally.storage import cut

#: Polygons of more corners are dealt edge by edge.
CORNERS = 64
#: Polygons of so many edges in all are an index in each task (32 bytes an edge).
INDEX_EDGES = 1 << 21
#: Beyond that, polygons that fill more tiles are dealt edge by edge as well.
TILES = 64
#: Directions of edges are dealt to so many classes; neighbouring ones meet.
DIRECTIONS = 64

_ENDS = ("ax", "ay", "bx", "by")


def _tile(x: Column, size: float) -> Column:
    return F.floor(x / size - OFFSET)


def _line(tile: Column, size: float) -> Column:
    """Where a tile begins."""
    return (tile + OFFSET) * size


def polygon_edges(polygons: DataFrame, key: str) -> DataFrame:
    """``key``, ``ax``, ``ay``, ``bx``, ``by``: the edges of all rings that have a length, a row each."""
    edges = polygons.where("rings IS NOT NULL").select(key, F.explode("rings").alias("ring")).where(F.size("ring") >= 2).select(key, F.inline(geometry.edges(F.col("ring"))))
    return edges.where("ax <> bx OR ay <> by")


def through_tiles(df: DataFrame, ends: tuple[str, str, str, str], size: float, *, wide: Column | float = 0.0, tall: Column | float = 0.0) -> DataFrame:
    """All columns with ``tile_x`` and ``tile_y``: a row for each tile that a segment passes, or comes within
    ``wide`` and ``tall`` of, and perhaps some next to them."""
    wide, tall = (w if isinstance(w, Column) else F.lit(float(w)) for w in (wide, tall))
    rows = df.withColumn("tile_y", F.explode(F.sequence(*_rows_of(ends, size, tall))))
    return rows.withColumn("tile_x", F.explode(F.sequence(*_columns_of(ends, size, F.col("tile_y"), wide, tall))))


def _rows_of(ends: tuple[str, str, str, str], size: float, tall: Column) -> tuple[Column, Column]:
    """The first and the last row of tiles of a segment."""
    _, ay, _, by = map(F.col, ends)
    return _tile(F.least(ay, by) - tall - size * 1e-9, size), _tile(F.greatest(ay, by) + tall + size * 1e-9, size)


def _columns_of(ends: tuple[str, str, str, str], size: float, row: Column, wide: Column, tall: Column) -> tuple[Column, Column]:
    """The first and the last tile of a segment in a row of tiles."""
    ax, ay, bx, by = map(F.col, ends)
    low, high = F.least(ay, by), F.greatest(ay, by)
    margin = tall + size * 1e-9
    at = lambda y: F.coalesce(ax + F.try_divide(y - ay, by - ay) * (bx - ax), ax)
    bottom = F.greatest(low, F.least(high, _line(row, size) - margin))
    top = F.greatest(low, F.least(high, _line(row + 1, size) + margin))
    flat = ay == by
    one, two = F.when(flat, ax).otherwise(at(bottom)), F.when(flat, bx).otherwise(at(top))
    return _tile(F.least(one, two) - wide - size * 1e-9, size), _tile(F.greatest(one, two) + wide + size * 1e-9, size)


def parity_rows(edges: DataFrame, key: str, size: float) -> DataFrame:
    """Rows that decide what is inside, by tile: the edges in it, and one without an edge if its lower
    left corner is inside."""
    ax, ay, bx, by = map(F.col, _ENDS)
    own = through_tiles(edges, _ENDS, size).select(F.col(key).alias("of"), "tile_x", "tile_y", *_ENDS)
    rows = edges.withColumn("row", F.explode(F.sequence(_tile(F.least(ay, by), size), _tile(F.greatest(ay, by), size) + 1)))
    y = _line(F.col("row"), size)
    crossed = rows.where((ay > y) != (by > y)).select(F.col(key).alias("of"), "row", _tile(ax + (y - ay) / (by - ay) * (bx - ax), size).alias("column"))
    odd = crossed.groupBy("of", "row", "column").agg((F.count("*") % 2).alias("turns")).where("turns = 1")
    along = Window.partitionBy("of", "row").orderBy("column")  # the crossings of one polygon with one row
    gaps = odd.select("of", "row", "column", (F.row_number().over(along) % 2).alias("inside"), F.lead("column").over(along).alias("next")).where("inside = 1 AND next IS NOT NULL")
    none = [F.lit(None).cast("double").alias(c) for c in _ENDS]
    corners = gaps.select("of", F.explode(F.sequence(F.col("column") + 1, F.col("next"))).alias("tile_x"), F.col("row").alias("tile_y"), *none)
    return own.unionByName(corners)


def _across(size: float) -> Column:
    """Where an edge meets the lower side of its tile."""
    ax, ay, bx, by = map(F.col, _ENDS)
    return ax + F.try_divide(_line(F.col("tile_y"), size) - ay, by - ay) * (bx - ax)


def _turns(x: Column, y: Column, size: float) -> Column:
    """How often a row of ``parity_rows`` turns a point of its tile from outside to inside or back."""
    ax, ay, bx, by = map(F.col, _ENDS)
    bottom, across = _line(F.col("tile_y"), size), _across(size)
    below = ((ay > bottom) != (by > bottom)) & (_tile(across, size) >= F.col("tile_x")) & (across <= x)
    up = ay + F.try_divide(x - ax, bx - ax) * (by - ay)
    beside = ((ax > x) != (bx > x)) & (up > bottom) & (up < y)
    count = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.when(ax.isNull(), 1).otherwise(count(below) + count(beside))


def _on_edge(x: Column, y: Column) -> Column:
    """Whether a point is exactly on a row's edge."""
    ax, ay, bx, by = map(F.col, _ENDS)
    flat = (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0
    return F.coalesce(flat & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by)), F.lit(False)).cast("int")


def _inside(points: DataFrame, keys: list[str], x: str, y: str, parity: DataFrame, size: float, *, polygon: str | None = None, boundary: bool = True) -> DataFrame:
    """``keys`` and ``of``: the polygons that each point is in (of a point with a ``polygon``, only that)."""
    placed = points.select(F.struct(*keys).alias("__keys"), *([F.col(polygon).alias("__own")] if polygon else []), F.col(x).alias("__x"), F.col(y).alias("__y"), _tile(F.col(x), size).alias("__tx"), _tile(F.col(y), size).alias("__ty"))
    on = [F.col("__tx") == F.col("tile_x"), F.col("__ty") == F.col("tile_y")] + ([F.col("__own") == F.col("of")] if polygon else [])
    px, py = F.col("__x"), F.col("__y")
    # Most edges of a tile say nothing about a point: an edge turns what is behind the place where it leaves the tile
    # below, or between its ends.  Other pairs don't leave the join.
    behind = F.when((F.col("ay") > _line(F.col("tile_y"), size)) != (F.col("by") > _line(F.col("tile_y"), size)), _across(size))
    reach = parity.withColumns({"__behind": behind, "__low": F.least("ax", "bx"), "__high": F.greatest("ax", "bx")})
    told = placed.hint("merge").join(reach, [*on, F.col("ax").isNull() | (F.col("__behind") <= px) | px.between(F.col("__low"), F.col("__high"))])
    counted = told.groupBy("__keys", "of").agg(F.sum(_turns(px, py, size)).alias("turns"), F.max(_on_edge(px, py) if boundary else F.lit(0)).alias("edge"))
    return counted.where("turns % 2 = 1 OR edge = 1").select("__keys.*", "of")


def points_in_polygons(points: DataFrame, point_key: str, polygons: DataFrame, key: str, size: float, *, x: str = "x", y: str = "y") -> DataFrame:
    """``point_key`` and ``key``: which points are in which polygons (``rings``), their boundaries included.

    Points with a null coordinate are in none; a polygon that is null or empty has none.
    """
    parity = parity_rows(polygon_edges(polygons, key), key, size)
    found = _inside(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [point_key], x, y, parity, size)
    return found.withColumnRenamed("of", key)


def segments_in_polygons(segments: DataFrame, keys: list[str], polygons: DataFrame, key: str, size: float, *, boundary: str = "all", keep: bool = False) -> DataFrame:
    """``keys`` (of a segment), ``key`` (of a polygon), ``low`` and ``high``: the parts of each segment
    (``x1``, ``y1``, ``x2``, ``y2``) in each polygon (``rings``), as shares of the segment's length.

    A part along an edge is inside, as the boundary belongs to a polygon; with ``boundary`` "none" it
    isn't, with "same" only if the edge runs in the segment's direction.  Parts that touch are
    one; parts without length are left out; a segment of no length has none; a null polygon or end
    meets nothing.  The segment is cut wherever it meets an edge, and each piece is in the polygon if it
    runs along an edge or its middle is inside, so a crossing at a corner counts once or twice
    without harm.  With ``keep`` each row of ``segments`` also comes itself, with a null polygon.
    """
    kinds = {"all": ("inside", "same", "opposite"), "same": ("inside", "same"), "none": ("inside",)}[boundary]
    pieces, named = _pieces(segments, keys, polygons, key, size, kinds, whole=True, keep=keep)
    return pieces.select(*[F.col(n).alias(k) for n, k in zip(named, keys, strict=True)], F.col("of").alias(key), "low", "high")


def distinct_shapes(polygons: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The distinct polygons (``rings``) under their smallest key, and ``key`` with ``shape``, that smallest key, of all."""
    shapes = cut(polygons.where(F.col("rings").isNotNull()).groupBy("rings").agg(F.min(key).alias(key)))
    members = polygons.select(F.col(key).alias("__member"), "rings").join(shapes, "rings").select(F.col("__member").alias(key), F.col(key).alias("shape"))
    return shapes, members


def _pieces(segments: DataFrame, keys: list[str], polygons: DataFrame, key: str, size: float, kinds: tuple[str, ...] = cutting.KINDS, *, whole: bool = False, keep: bool = False) -> tuple[DataFrame, list[str]]:
    """Pieces of segments in polygons (``of``) between the places where they meet edges, with their ``kind``:
    "inside", or along an edge of the "same" or the "opposite" direction; and the names of the keys.  With ``whole``
    pieces of these kinds that touch are one; with ``keep`` each segment's row also comes itself, with a null ``of``."""
    named = [f"__k{i}" for i in range(len(keys))]
    every = segments.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], *[F.col(c).cast("double").alias(c) for c in cutting.ENDS])
    corners = F.aggregate("rings", F.lit(0), lambda n, r: n + F.coalesce(F.size(r), F.lit(0)))
    points = F.flatten(F.filter("rings", lambda r: r.isNotNull()))
    along = [F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])]
    sides = [side(c) for side in (F.array_min, F.array_max) for c in along]
    tiles = [_tile(c, size) for c in sides]
    filled = (tiles[2] - tiles[0] + 1).cast("double") * (tiles[3] - tiles[1] + 1)
    small, compact = F.coalesce(corners <= CORNERS, F.lit(False)), F.coalesce(filled <= TILES, F.lit(False))
    known = polygons.where("rings IS NOT NULL")
    n = known.agg(F.sum(F.when(small, corners)).alias("edges"), F.count_if(~small).alias("large"), F.count_if(small & ~compact).alias("wide")).first()
    types = [every.schema[n].dataType for n in named]
    schema = StructType([*map(StructField, named, types), StructField("of", polygons.schema[key].dataType), StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("kind", StringType())])
    numbers = tuple(cutting.KINDS.index(k) for k in kinds)
    flat_edges = F.flatten(F.transform(F.filter(F.flatten(F.transform(F.filter("rings", lambda r: F.size(r) >= 2), geometry.edges)), _has_length), lambda e: F.array(*[e[c] for c in _ENDS])))
    by_index = (n.edges or 0) <= INDEX_EDGES
    few = small if by_index else small & compact
    made = known.where(few).select(F.col(key).alias("of"), flat_edges.alias("edges"), *([] if by_index else [c.alias(a) for c, a in zip(sides, ("w", "s", "e", "n"), strict=True)]))
    if by_index:
        table = made.toArrow()
        index = cutting.Index(table["of"].combine_chunks(), *cutting.edge_arrays(table["edges"]), size)
        shared = every.sparkSession.sparkContext.broadcast(index)
        out = every.mapInArrow(cutting.cut_by_index(shared, named, numbers, whole, keep), schema)
    else:
        out = _pairs(every, named, made, size).mapInArrow(cutting.cut_pairs(named, numbers, whole), schema)
        if keep:
            out = out.unionByName(every.select(*named), allowMissingColumns=True)
    if n.large or (n.wide and not by_index):
        dealt, _ = _pieces_by_edge(every, named, known.where(~few), key, size)
        dealt = dealt.where(F.col("kind").isin(*kinds))
        out = out.unionByName(merged_parts(dealt.drop("kind"), [*named, "of"]).withColumn("kind", F.lit(kinds[0])) if whole else dealt)
    return out, named


def _has_length(e: Column) -> Column:
    return e["ax"].isNotNull() & e["ay"].isNotNull() & e["bx"].isNotNull() & e["by"].isNotNull() & ((e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def _pairs(segments: DataFrame, named: list[str], polygons: DataFrame, size: float) -> DataFrame:
    """Segments with the polygons (``of``, ``edges`` and their extent ``w``, ``s``, ``e``, ``n``) whose extents they meet.

    A pair that shares several tiles counts in the first one: a segment's tiles in a row are side by side and those of the next
    row go on from there, so the row before says whether there was one.
    """
    none = F.lit(0.0)
    has = "x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)"
    first, last = _rows_of(cutting.ENDS, size, none)
    rows = segments.where(has).withColumn("first", first).withColumn("tile_y", F.explode(F.sequence("first", last)))
    begin, end = _columns_of(cutting.ENDS, size, F.col("tile_y"), none, none)
    earlier_begin, earlier_end = _columns_of(cutting.ENDS, size, F.col("tile_y") - 1, none, none)
    before = F.col("tile_y") > F.col("first")
    spans = rows.select("*", begin.alias("begin"), F.when(before, earlier_begin).alias("from"), F.when(before, earlier_end).alias("to"), F.explode(F.sequence(begin, end)).alias("tile_x"))
    pad = lambda w, s, e, n: 1e-6 * (e - w + n - s) + TOLERANCE * F.greatest(F.lit(1.0), F.abs(w), F.abs(e), F.abs(s), F.abs(n))
    own = pad(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    room = pad(*map(F.col, "wsen"))
    wider = polygons.select("of", "edges", *[(F.col(c) + s * room).alias(c) for c, s in zip("wsen", (-1, -1, 1, 1), strict=True)])
    ranged = wider.withColumns({"px": _tile(F.col("w"), size), "to_x": _tile(F.col("e"), size), "py": _tile(F.col("s"), size), "to_y": _tile(F.col("n"), size)})
    dealt = ranged.withColumn("ty", F.explode(F.sequence("py", "to_y"))).withColumn("tx", F.explode(F.sequence("px", "to_x")))
    earlier = F.coalesce((F.col("tile_y") > F.col("py")) & (F.col("from") <= F.col("to_x")) & (F.col("to") >= F.col("px")), F.lit(False))
    meet = (F.least("x1", "x2") - own <= F.col("e")) & (F.col("w") <= F.greatest("x1", "x2") + own) & (F.least("y1", "y2") - own <= F.col("n")) & (F.col("s") <= F.greatest("y1", "y2") + own)
    on = [F.col("tile_x") == F.col("tx"), F.col("tile_y") == F.col("ty"), F.col("tile_x") == F.greatest("begin", "px"), ~earlier, meet]
    return spans.hint("merge").join(dealt, on).select(*named, *cutting.ENDS, "of", "edges")


def _pieces_by_edge(segments: DataFrame, keys: list[str], polygons: DataFrame, key: str, size: float) -> tuple[DataFrame, list[str]]:
    """The same of all kinds for polygons of any number of corners, whose edges are dealt one by one."""
    named = [f"__k{i}" for i in range(len(keys))]
    own = segments.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    own = own.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)")
    # Written once: what is read several times below.
    edges = polygon_edges(polygons, key)
    parity = cut(parity_rows(edges, key, size))
    met = through_tiles(own, ("x1", "y1", "x2", "y2"), size).withColumnsRenamed({"tile_x": "__tx", "tile_y": "__ty"})
    passed = through_tiles(edges, _ENDS, size).withColumnRenamed(key, "of")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    fx, fy = F.col("ax") - F.col("x1"), F.col("ay") - F.col("y1")  # from the segment's own start: large coordinates lose nothing
    near = TOLERANCE * F.greatest(F.lit(1.0), F.abs("x1"), F.abs("y1"), F.abs("ax"), F.abs("ay"))
    apart = lambda px, py: F.abs(dx * py - dy * px) / F.sqrt(square)
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    # The join tests extents only: a condition of a few operations is compiled, one with all the geometry is not, and
    # most pairs of a tile end here.  What follows is behind a generator, or Spark would move it into the condition.
    pad = lambda a, b, c, d: 1e-6 * (F.abs(F.col(a) - F.col(c)) + F.abs(F.col(b) - F.col(d))) + TOLERANCE * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    slack = F.col("__pad") + F.col("pad")
    meet = lambda a, b, c, d: (F.least(a, b) <= F.greatest(c, d) + slack) & (F.least(c, d) <= F.greatest(a, b) + slack)
    extents = meet("x1", "x2", "ax", "bx") & meet("y1", "y2", "ay", "by")
    beside = met.withColumn("__pad", pad("x1", "y1", "x2", "y2")).hint("merge").join(passed.withColumn("pad", pad(*_ENDS)), [F.col("__tx") == F.col("tile_x"), F.col("__ty") == F.col("tile_y"), extents])
    given = {"dx": dx, "dy": dy, "ex": ex, "ey": ey, "fx": fx, "fy": fy}
    dx, dy, ex, ey, fx, fy = map(F.col, given)
    turn, square = dx * ey - dy * ex, dx * dx + dy * dy
    along = (apart(fx, fy) <= near) & (apart(fx + ex, fy + ey) <= near)
    worked = {"t": F.try_divide(fx * ey - fy * ex, turn), "u": F.try_divide(fx * dy - fy * dx, turn), "a": (fx * dx + fy * dy) / square, "b": ((fx + ex) * dx + (fy + ey) * dy) / square, "along": along, "same": dx * ex + dy * ey > 0}
    t, u, a, b, along = map(F.col, ("t", "u", "a", "b", "along"))
    start, stop = clamp(F.least(a, b)), clamp(F.greatest(a, b))
    crossing = t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9)
    line = [*named, "x1", "y1", "x2", "y2", "of"]
    place = F.struct(F.when(along, start).otherwise(clamp(t)).alias("t"), F.when(along, stop).alias("along_to"), F.when(along, F.col("same")).alias("same"))
    found = F.when((along & (start < stop)) | F.coalesce(crossing, F.lit(False)), F.array(place))
    # A pair in several tiles gives the same rows again: they are a set.
    touched = cut(beside.withColumns(given).withColumns(worked).select(*line, F.inline(found)).distinct())
    ends = F.array(F.lit(0.0), F.lit(1.0), F.col("t"), F.coalesce("along_to", F.col("t")))
    ordered = Window.partitionBy(*named, "of").orderBy("t")  # the crossings of one segment with one polygon
    places = touched.select(*line, F.explode(ends).alias("t")).distinct()
    pieces = places.select(*line, F.col("t").alias("low"), F.lead("t").over(ordered).alias("high")).where("high - low > 1e-12")
    runs = touched.where("along_to IS NOT NULL").groupBy(*named, "of").agg(F.collect_set(F.struct(F.col("t").alias("a"), F.col("along_to").alias("b"), "same")).alias("runs"))
    same = [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in (*named, "of")]
    marked = pieces.join(runs.withColumnsRenamed({c: f"r{c}" for c in (*named, "of")}), same, "left").withColumn("middle", (F.col("low") + F.col("high")) / 2)
    holds = lambda r: (r["a"] <= F.col("middle")) & (F.col("middle") <= r["b"])
    on_edge = F.coalesce(F.exists("runs", holds), F.lit(False))
    kind = F.when(~on_edge, "inside").when(F.exists("runs", lambda r: holds(r) & r["same"]), "same").otherwise("opposite")
    pieces = cut(marked.select(*named, "of", "low", "high", kind.alias("kind"), (F.col("x1") + F.col("middle") * (F.col("x2") - F.col("x1"))).alias("mx"), (F.col("y1") + F.col("middle") * (F.col("y2") - F.col("y1"))).alias("my")))
    kept = [*named, "low", "high"]
    within = _inside(pieces.where("kind = 'inside'").withColumnRenamed("of", "with"), kept, "mx", "my", parity, size, polygon="with", boundary=False)
    whole = _inside(own.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}), named, "mx", "my", parity, size, boundary=False)
    alone = whole.join(touched.select(*[F.col(c).alias(f"r{c}") for c in (*named, "of")]).distinct(), same, "left_anti")
    span = [*named, "of", "low", "high"]
    alike = within.select(*span, F.lit("inside").alias("kind")).unionByName(alone.select(*named, "of", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit("inside").alias("kind")))
    return pieces.where("kind <> 'inside'").select(*span, "kind").unionByName(alike), named


def merged_parts(parts: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``keys``, ``low``, ``high``: parts of one key that touch or overlap become one."""
    ordered = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = parts.select(*keys, "low", "high", F.when(F.col("low") <= reach + tolerance, 0).otherwise(1).alias("new"))
    grouped = apart.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def points_near_polygons(points: DataFrame, point_key: str, polygons: DataFrame, key: str, metres: float, size: float, *, beyond: float = 10.0) -> DataFrame:
    """``point_key``, ``key``, ``metres_apart``: points (``lon``, ``lat``) no further than ``metres`` from a
    polygon (``rings``); zero inside and on the boundary.

    Distances are those of the plane that touches the sphere at the point (for distances of a
    few kilometres, up to 89 degrees of latitude).  A polygon over the line of 180 degrees goes on behind it,
    up to ``beyond`` degrees: points so near that line are looked for on both sides.  Each edge is dealt to the tiles within
    reach, and the nearest edge counts.
    """
    degree = EARTH_RADIUS_M * 3.141592653589793 / 180
    tall = metres / degree
    edges = polygon_edges(polygons, key)
    outermost = F.least(F.lit(89.0), F.greatest(F.abs("ay"), F.abs("by")) + tall)
    reach = through_tiles(edges, _ENDS, size, wide=tall / F.cos(F.radians(outermost)) + 1e-9, tall=tall + 1e-9).withColumnRenamed(key, "of")
    known = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col(point_key).alias("__p"), F.explode(_both_sides(F.col("lon"), F.col("lat"), tall, beyond)).alias("x"), F.col("lat").alias("y"))
    placed = known.select("*", _tile(F.col("x"), size).alias("__tx"), _tile(F.col("y"), size).alias("__ty"))
    across = F.cos(F.radians("y")) * degree
    ax, ay, bx, by = ((F.col(c) - F.col(o)) * s for c, o, s in zip(_ENDS, ("x", "y", "x", "y"), (across, F.lit(degree)) * 2, strict=True))
    ex, ey = bx - ax, by - ay
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(-(ax * ex + ay * ey), ex * ex + ey * ey), F.lit(0.0))))
    apart = F.hypot(ax + w * ex, ay + w * ey)
    near = placed.hint("merge").join(reach, [F.col("__tx") == F.col("tile_x"), F.col("__ty") == F.col("tile_y"), apart <= metres]).select("__p", "of", apart.alias("m"))
    inside = _inside(known, ["__p"], "x", "y", parity_rows(edges, key, size), size).select("__p", "of", F.lit(0.0).alias("m"))
    return near.unionByName(inside).groupBy(F.col("__p").alias(point_key), F.col("of").alias(key)).agg(F.min("m").alias("metres_apart"))


def _both_sides(lon: Column, lat: Column, tall: float, beyond: float) -> Column:
    """A longitude, and the same place on the other side of 180 degrees if that may be within reach."""
    wide = beyond + tall / F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + tall)))
    return F.when(F.abs(lon) >= 180 - wide, F.array(lon, F.when(lon > 0, lon - 360).otherwise(lon + 360))).otherwise(F.array(lon))


def shared_boundaries(polygons: DataFrame, key: str, size: float, tolerance: float = TOLERANCE) -> DataFrame:
    """``left``, ``right`` (left < right) and ``shared``: the length of the boundary that two polygons
    (``rings``) have in common, if it is more than zero.

    Edges meet in the tiles that they pass and in their class of direction or one next to it (edges
    too short to have a sure direction are in all).  The join's condition is exact: both ends of the shorter
    edge lie on the longer one's line within ``tolerance`` (a share of the coordinates' size), measured
    from that edge's own end, and their extents overlap by more than that.  A pair of edges that meets in
    several tiles counts in the one that the middle of the common part is in.
    """
    edges = polygon_edges(polygons, key)
    near = F.greatest(F.lit(1.0), F.abs("ax"), F.abs("ay"), F.abs("bx"), F.abs("by")) * tolerance
    sized = edges.select(F.col(key).alias("of"), *_ENDS, F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("length"), near.alias("near"))
    angle = F.pmod(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), F.lit(3.141592653589793))
    direction = F.least(F.lit(DIRECTIONS - 1), F.floor(angle / 3.141592653589793 * DIRECTIONS)).cast("int")
    unsure = F.col("length") < 4 * DIRECTIONS * F.col("near")
    all_of_them = F.sequence(F.lit(0), F.lit(DIRECTIONS - 1))
    tiles = through_tiles(sized, _ENDS, size, wide=F.col("near"), tall=F.col("near"))
    spread = lambda sure: F.explode(F.when(unsure, all_of_them).otherwise(sure))
    beside = F.array_distinct(F.array(*[F.pmod(direction + k, F.lit(DIRECTIONS)).cast("int") for k in (-1, 0, 1)]))
    one = tiles.select("*", spread(F.array(direction)).alias("class"), (~unsure).alias("sure"))
    two = tiles.select("*", spread(beside).alias("class"), direction.alias("own"))
    a, b = (df.withColumnsRenamed({c: f"{s}_{c}" for c in df.columns}) for df, s in ((one, "a"), (two, "b")))

    def line(side: str, other: str) -> tuple[Column, Column, Column]:
        """How far the other edge is from this one's line, and where its ends are along it."""
        ux, uy = (F.col(f"{side}_bx") - F.col(f"{side}_ax")) / F.col(f"{side}_length"), (F.col(f"{side}_by") - F.col(f"{side}_ay")) / F.col(f"{side}_length")
        ends = [(F.col(f"{other}_{e}x") - F.col(f"{side}_ax"), F.col(f"{other}_{e}y") - F.col(f"{side}_ay")) for e in "ab"]
        places = [ux * x + uy * y for x, y in ends]
        return F.greatest(*[F.abs(ux * y - uy * x) for x, y in ends]), F.least(*places), F.greatest(*places)

    # The longer edge's line is the surer one.
    off, start, stop = line("a", "b")
    off = F.when(F.col("a_length") >= F.col("b_length"), off).otherwise(line("b", "a")[0])
    limit = F.greatest("a_near", "b_near")
    low, high = F.greatest(F.lit(0.0), start), F.least(F.col("a_length"), stop)
    share = (low + high) / 2 / F.col("a_length")
    here = [_tile(F.col(f"a_a{c}") + share * (F.col(f"a_b{c}") - F.col(f"a_a{c}")), size) == F.col(f"a_tile_{c}") for c in "xy"]
    # An unsure edge is in all classes: its pair counts in the second edge's own one.
    once = F.col("a_sure") | (F.col("a_class") == F.col("b_own"))
    on = [F.col("a_tile_x") == F.col("b_tile_x"), F.col("a_tile_y") == F.col("b_tile_y"), F.col("a_class") == F.col("b_class"), F.col("a_of") < F.col("b_of")]
    # Extents first, which is cheaper and ends most pairs; nothing that the exact conditions let through is further apart.
    slack = 4 * limit + 1e-9 * (F.col("a_length") + F.col("b_length"))
    meet = [(F.least(f"{s}_a{c}", f"{s}_b{c}") <= F.greatest(f"{o}_a{c}", f"{o}_b{c}") + slack) for c in "xy" for s, o in ("ab", "ba")]
    pairs = a.hint("merge").join(b, [*on, *meet, off <= limit, high - low > limit, *here, once])
    return pairs.groupBy(F.col("a_of").alias("left"), F.col("b_of").alias("right")).agg(F.sum(high - low).alias("shared"))


def cut_areas(cells: DataFrame, cell: str, boundary: DataFrame, key: str, size: float, *, straight: bool = False) -> DataFrame:
    """``cell``, ``area_m2`` (on the ellipsoid, see ``area_under``), ``lon`` and ``lat`` (planar centroid) of each cell's
    part within a boundary; cells outside have no row.

    Both have ``rings``, shells counter-clockwise and holes clockwise (see ``geometry.oriented``).  The part is
    not put together: its area is a sum over its outline, which is what lies of the boundary in the
    cell and of the cell's edges in the boundary, so boundaries of any number of corners stay dealt.
    Edges are cut straight in degrees; each piece is then a geodesic, or straight (areas of a partition then
    add up exactly, otherwise to what long edges bend: 2e-5 for edges of 4 km).
    """
    ends = ["x1", "y1", "x2", "y2"]
    named = lambda df, k: polygon_edges(df, k).withColumnsRenamed(dict(zip(_ENDS, ends, strict=True)))
    inner = segments_in_polygons(named(boundary, key), [key, *ends], cells, cell, size, boundary="same").select(F.col(cell).alias("of"), *ends, "low", "high")
    rim = segments_in_polygons(named(cells, cell), [cell, *ends], boundary, key, size, boundary="none").select(F.col(cell).alias("of"), *ends, "low", "high")
    origin = cells.select(F.col(cell).alias("__of"), F.col("rings")[0][0]["x"].alias("ox"), F.col("rings")[0][0]["y"].alias("oy"))
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    pieces = inner.unionByName(rim).select("of", at("x1", "x2", "low").alias("ax"), at("y1", "y2", "low").alias("ay"), at("x1", "x2", "high").alias("bx"), at("y1", "y2", "high").alias("by"))
    under = area_under(*map(F.col, _ENDS), straight=straight)
    ax, ay, bx, by = F.col("ax") - F.col("ox"), F.col("ay") - F.col("oy"), F.col("bx") - F.col("ox"), F.col("by") - F.col("oy")
    cross = ax * by - bx * ay
    sums = pieces.join(origin, F.col("of") == F.col("__of")).groupBy(F.col("of").alias(cell), "ox", "oy").agg((-F.sum(under)).alias("area_m2"), F.sum(cross).alias("__c"), F.sum((ax + bx) * cross).alias("__x"), F.sum((ay + by) * cross).alias("__y"))
    return sums.where("area_m2 > 1e-6 AND __c > 0").select(cell, "area_m2", (F.col("ox") + F.col("__x") / (3 * F.col("__c"))).alias("lon"), (F.col("oy") + F.col("__y") / (3 * F.col("__c"))).alias("lat"))


def union_outline(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """``ax``, ``ay``, ``bx``, ``by``: the outline of the union of all polygons (``rings``, shells counter-clockwise,
    holes clockwise), the union on the left of each piece.

    What remains of a polygon's edges is what no other polygon covers: not inside another one, not along an edge
    of the opposite direction; of edges that run alike the smallest key's stays.  Polygons may overlap.
    """
    ends = ["x1", "y1", "x2", "y2"]
    edges = polygon_edges(polygons, key).withColumnsRenamed(dict(zip(_ENDS, ends, strict=True)))
    pieces, named = _pieces(edges, [key, *ends], polygons, key, size)
    own = F.col(named[0])
    covered = pieces.where((F.col("of") != own) & ((F.col("kind") != "same") | (F.col("of") < own))).select(*named, "low", "high")
    # Every edge begins with a part of no length, so one pass over an edge's parts finds what is before, between and behind them.
    begun = edges.select(*[F.col(c).alias(n) for c, n in zip([key, *ends], named, strict=True)], F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    ordered = Window.partitionBy(*named).orderBy("low", "high")
    reach = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    left = covered.unionByName(begun).select(*named, reach.alias("from"), F.lead("low", 1, 1.0).over(ordered).alias("to")).where(F.col("to") > F.col("from") + 1e-12)
    x1, y1, x2, y2 = (F.col(n) for n in named[1:])
    at = lambda a, b, t: F.when(F.col(t) == 1.0, b).otherwise(a + F.col(t) * (b - a))
    return left.select(at(x1, x2, "from").alias("ax"), at(y1, y2, "from").alias("ay"), at(x1, x2, "to").alias("bx"), at(y1, y2, "to").alias("by"))


def outline_rings(pieces: DataFrame, places: int = 6) -> DataFrame:
    """The pieces with ``ring`` (a number for each closed line) and ``at`` (the piece's number in it, from 0).

    Ends are one place if they agree to so many ``places``.  Where several pieces leave a place, the one that
    turns most to the left goes on, so what is enclosed stays on the left.  Rings are found by pointer
    jumping: after k rounds a piece knows the first of the 2^k pieces from it on, so rounds grow with
    the logarithm of the longest ring and no ring is ever in one task.
    """
    point = lambda a, b: F.struct(F.round(a, places).alias("x"), F.round(b, places).alias("y"))
    known = cut(cut(pieces).withColumn("id", F.monotonically_increasing_id()))
    angle = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    enters = known.select("id", point("bx", "by").alias("end"), angle.alias("in"))
    leaves = known.select(F.col("id").alias("next"), point("ax", "ay").alias("start"), angle.alias("out"))
    turn = F.pmod(F.col("in") + 3.141592653589793 - F.col("out") - 1e-9, F.lit(2 * 3.141592653589793))
    state = cut(enters.join(leaves, F.col("end") == F.col("start")).groupBy("id").agg(F.min_by("next", turn).alias("jump")).select("id", "jump", F.col("id").alias("best"), F.lit(0).cast("long").alias("away")))
    span, before = 1, None
    while True:
        ahead = state.select(F.col("id").alias("__id"), F.col("jump").alias("__jump"), F.col("best").alias("__best"), F.col("away").alias("__away"))
        closer = F.col("__best") < F.col("best")
        state = cut(state.join(ahead, F.col("jump") == F.col("__id")).select("id", F.col("__jump").alias("jump"), F.least("best", "__best").alias("best"), F.when(closer, F.col("__away") + span).otherwise(F.col("away")).alias("away")))
        now = state.agg(F.sum(F.xxhash64("id", "best").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        span, before = 2 * span, now
    sizes = state.groupBy(F.col("best").alias("ring")).agg(F.count("*").alias("n"))
    placed = state.join(sizes, F.col("best") == F.col("ring")).select(F.col("id").alias("__id"), "ring", ((F.col("n") - F.col("away")) % F.col("n")).alias("at"))
    return known.join(placed, F.col("id") == F.col("__id")).drop("id", "__id")


def validity(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """``key`` and ``fault``: what makes a polygon (``parts``, an array of arrays of rings) invalid, null if
    nothing does.

    Faults, the first that holds: ``NONE`` (no geometry), ``CROSSING`` (two edges cross or lie on each other, or a ring
    touches itself; rings may touch each other in places), ``HOLE_OUTSIDE`` (a hole that isn't within its
    shell, or is within another hole), ``NESTED`` (a part within another one).  Edges meet their
    own polygon's in the tiles that they pass.
    """
    rings = polygons.select(F.col(key).alias("of"), F.posexplode("parts").alias("part", "rings")).select("of", "part", F.posexplode("rings").alias("ring", "line"))
    edges = rings.select("of", "part", "ring", F.size("line").alias("n"), F.posexplode(geometry.edges(F.col("line"))).alias("at", "e")).select("of", "part", "ring", "n", "at", "e.*").where("ax <> bx OR ay <> by")
    tiles = cut(through_tiles(edges, _ENDS, size))
    a, b = (tiles.withColumnsRenamed({c: f"{s}_{c}" for c in tiles.columns}) for s in "ab")
    same_ring = (F.col("a_part") == F.col("b_part")) & (F.col("a_ring") == F.col("b_ring"))
    after = F.when(same_ring, F.col("a_at") < F.col("b_at")).otherwise(F.struct("a_part", "a_ring") < F.struct("b_part", "b_ring"))
    p = {f"{s}{e}": (F.col(f"{s}_{e}x") - F.col("a_ax"), F.col(f"{s}_{e}y") - F.col("a_ay")) for s in "ab" for e in "ab"}
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    minus = lambda u, v: (u[0] - v[0], u[1] - v[1])
    d, f = minus(p["ab"], p["aa"]), minus(p["bb"], p["ba"])
    sides_b = [cross(d, minus(q, p["aa"])) for q in (p["ba"], p["bb"])]
    sides_a = [cross(f, minus(q, p["ba"])) for q in (p["aa"], p["ab"])]
    proper = (sides_b[0] * sides_b[1] < 0) & (sides_a[0] * sides_a[1] < 0)
    flat = (sides_b[0] == 0) & (sides_b[1] == 0)
    along = lambda q: q[0] * d[0] + q[1] * d[1]
    square = along(d)
    low, high = F.greatest(F.lit(0.0), F.least(along(p["ba"]), along(p["bb"]))), F.least(square, F.greatest(along(p["ba"]), along(p["bb"])))
    overlap = flat & (low < high)
    # Touching in a place: an end of one on the other.
    within = lambda q, start, step: (cross(step, minus(q, start)) == 0) & ((minus(q, start)[0] * step[0] + minus(q, start)[1] * step[1]).between(0.0, step[0] * step[0] + step[1] * step[1]))
    touch = within(p["ba"], p["aa"], d) | within(p["bb"], p["aa"], d) | within(p["aa"], p["ba"], f) | within(p["ab"], p["ba"], f)
    gap = F.col("b_at") - F.col("a_at")
    neighbours = (gap == 1) | (gap == F.col("a_n") - 2)
    met = a.hint("merge").join(b, [F.col("a_of") == F.col("b_of"), F.col("a_tile_x") == F.col("b_tile_x"), F.col("a_tile_y") == F.col("b_tile_y"), after, proper | overlap | (same_ring & ~neighbours & touch)])
    crossing = met.select(F.col("a_of").alias("of")).distinct().withColumn("rank", F.lit(1))

    # A place on each ring away from its corners: rings that don't cross are wholly inside or outside each other.
    place = edges.groupBy("of", "part", "ring").agg(F.max_by(F.struct(((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y")), F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("m"))
    ringed = rings.select(F.struct("of", "part", "ring").alias("id"), F.array("line").alias("rings"))
    inside = _inside(place.select(F.struct("of", "part", "ring").alias("id"), "m.x", "m.y"), ["id"], "x", "y", parity_rows(polygon_edges(ringed, "id"), "id", size), size, boundary=False)
    pairs = inside.where((F.col("id.of") == F.col("of.of")) & (F.col("id") != F.col("of")))
    own_shell = (F.col("id.part") == F.col("of.part")) & (F.col("of.ring") == 0)
    counted = pairs.groupBy("id").agg(F.bool_or(own_shell).alias("in_shell"), F.bool_or((F.col("id.part") == F.col("of.part")) & (F.col("of.ring") > 0)).alias("in_hole"), (F.count_if(F.col("id.part") != F.col("of.part")) % 2).alias("nested"))
    ranked = place.select(F.struct("of", "part", "ring").alias("r")).join(counted, F.col("r") == F.col("id"), "left")
    hole = (F.col("r.ring") > 0) & (~F.coalesce("in_shell", F.lit(False)) | F.coalesce("in_hole", F.lit(False)))
    nesting = ranked.select(F.col("r.of").alias("of"), F.when(hole, 2).when((F.col("r.ring") == 0) & (F.col("nested") == 1), 3).alias("rank")).where("rank IS NOT NULL")
    worst = crossing.unionByName(nesting).groupBy("of").agg(F.min("rank").alias("rank"))
    names = F.when(F.col("rank") == 1, "CROSSING").when(F.col("rank") == 2, "HOLE_OUTSIDE").when(F.col("rank") == 3, "NESTED")
    return polygons.select(F.col(key), F.col("parts").isNull().alias("none")).join(worst, F.col(key) == F.col("of"), "left").select(key, F.when(F.col("none"), "NONE").otherwise(names).alias("fault"))


def covered_share(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``covered``: the share of each segment that the union of its parts (``low``,
    ``high``) covers.  A segment's parts are as many as the polygons it meets."""
    ordered = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.coalesce(F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    new = parts.withColumn("gain", F.greatest(F.lit(0.0), F.col("high") - F.greatest("low", before)))
    return new.groupBy(*keys).agg(F.sum("gain").alias("covered"))
