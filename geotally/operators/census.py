"""Census of lines over cells: every source gets one class, admitted ones their way from cell to cell.

Lines become elementary edges, edges are cut to the cells where they are, and one pass over the sorted ends of an
edge's parts (a window by edge) finds gaps and overlaps together: a part that begins behind what
the parts before it reach leaves a gap, one that begins before it shares a boundary of some length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions import geometry
from geotally.functions.cutting import ENDS
from geotally.operators.links import visits_to_links
from geotally.operators.polygons import segments_in_polygons

# The terminal classes of a source in the order of their precedence.
TERMINAL = (
    "SOURCE_ROW_INACTIVE", "GEOMETRY_NULL", "GEOMETRY_TYPE_UNSUPPORTED", "GEOMETRY_EMPTY_OR_INVALID", "COLLAPSED_ELEMENTARY_EDGE",
    "OUTSIDE_OR_GAPPED_CELL_UNIVERSE", "POSITIVE_LENGTH_BOUNDARY_OVERLAP", "NONUNIQUE_TRAVERSAL", "ADMITTED",
)

#: Shares of an edge that differ by less are one place.
SAME_PLACE = 1e-12
EDGE = "struct<edge:int,x1:double,y1:double,x2:double,y2:double,says:int,n:int,kind:string>"


def first_match(*rules: Column) -> Column:
    """The first class whose condition holds (null counts as not holding), else the last class."""
    out = None
    for name, condition in zip(TERMINAL, rules, strict=False):
        holds = F.coalesce(condition, F.lit(False))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(TERMINAL[-1])


def swept(parts: DataFrame, key: str, cell: str) -> DataFrame:
    """The parts (``key``, ``edge``, ``low``, ``high``, ``cell``) with what each says of its edge: ``gap`` (it leaves some before it, or as the
    last one behind it, uncovered), ``overlap`` (it shares more than a place with those before it), ``again`` (it was
    there before, as rows of one source repeat) and ``begins`` (it is the edge's first)."""
    ordered = Window.partitionBy(key, "edge").orderBy("low", "high", cell)
    reach = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    before = lambda c: F.lag(c).over(ordered)
    seen = parts.withColumns({"reach": reach, "next": F.lead("low").over(ordered), "again": F.coalesce((before("low") == F.col("low")) & (before("high") == F.col("high")) & (before(cell) == F.col(cell)), F.lit(False))})
    reached, last = F.coalesce("reach", F.lit(0.0)), F.col("next").isNull() & (F.greatest("high", "reach") < 1 - SAME_PLACE)
    gap, overlap = (F.col("low") > reached + SAME_PLACE) | last, (F.col("low") < reached - SAME_PLACE) & ~F.col("again")
    return seen.withColumns({"gap": gap, "overlap": overlap, "begins": F.col("reach").isNull()}).drop("reach", "next")


def census(sources: DataFrame, cells: DataFrame, size: float, *, key: str = "source_key", cell: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Classes (``key``, ``terminal_class``) of all sources, and the visits of the admitted ones (``key``,
    ``edge``, ``low``, ``high``, ``cell``).

    ``sources``: ``key``, ``is_active`` and ``wkt``; ``cells``: ``cell`` and ``rings``.  A source that is active and
    whose geometry is a line is followed: edges without length, edges that leave the cells, ones that run along a
    boundary of two cells, and repeated ones decide its class in that order.  Sources without a
    key or with a null activity are inactive.

    A source's own row (edge 0) goes with its edges, so parts and what the source says of itself are dealt by source
    once; nothing is written, and who asks for classes alone makes no visits.
    """
    line = geometry.line_from_wkt(F.col("wkt"))
    kind = geometry.geometry_type(F.col("wkt"))
    read = sources.select(key, (F.coalesce("is_active", F.lit(False)) & F.col(key).isNotNull()).alias("active"), F.col("wkt").isNull().alias("none"), kind.alias("kind"), line.alias("line"))
    edges = read.select("*", F.when(F.col("active") & F.col("line").isNotNull(), geometry.edges(F.col("line"))).alias("edges"))
    flat = lambda e: (e["ax"] == e["bx"]) & (e["ay"] == e["by"])
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((~F.col("active"), F.col("none"), F.col("line").isNull(), F.exists("edges", flat)))), F.lit(0))
    no = [F.lit(None).cast("double").alias(c) for c in ENDS]
    itself = F.array(F.struct(F.lit(0).alias("edge"), *no, bits.alias("says"), F.coalesce(F.size("edges"), F.lit(0)).alias("n"), F.col("kind").alias("kind")))
    each = F.transform("edges", lambda e, i: F.struct((i + 1).alias("edge"), *[e[a].alias(c) for a, c in zip(("ax", "ay", "bx", "by"), ENDS, strict=True)], F.lit(None).cast("int").alias("says"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("kind")))
    rows = edges.select(key, F.inline(F.concat(itself, F.coalesce(each, F.array().cast(f"array<{EDGE}>")))))
    met = segments_in_polygons(rows, [key, "edge", "says", "n", "kind"], cells, cell, size, keep=True)
    # Of what is kept, only the sources' own rows; an edge that meets no cell leaves none.
    dealt = met.where(F.col(cell).isNotNull() | (F.col("edge") == 0)).repartition(key)
    told = swept(dealt, key, cell)
    part = F.col("edge") > 0
    unsupported = F.coalesce(F.col("kind") != "LINESTRING", F.lit(True))
    named = first_match(*map(F.col, ("inactive", "none")), unsupported, *map(F.col, ("unread", "collapsed", "gapped", "overlapping", "repeated")))

    def facts(over: Callable[[Column], Column]) -> dict[str, Column]:
        """What the rows of one source say together, as aggregates or over a window."""
        said = {n: over(F.bool_or(F.col("says").bitwiseAND(F.lit(1 << i)) != 0)) for i, n in enumerate(("inactive", "none", "unread", "collapsed"))}
        found = {n: F.coalesce(over(F.bool_or(part & F.col(c))), F.lit(False)) for n, c in (("gap_seen", "gap"), ("overlapping", "overlap"), ("repeated", "again"))}
        missed = over(F.count_if(part & F.col("begins"))) < over(F.max("n"))
        return said | {"kind": over(F.max("kind")), "gapped": found.pop("gap_seen") | missed} | found

    classes = told.groupBy(key).agg(*[c.alias(n) for n, c in facts(lambda c: c).items()]).select(key, named.alias("terminal_class"))
    source = Window.partitionBy(key)  # the parts of one source
    visits = told.withColumns(facts(lambda c: c.over(source))).where((named == TERMINAL[-1]) & part).select(key, "edge", "low", "high", cell)
    return classes, visits


def visited_links(visits: DataFrame, *, key: str = "source_key", cell: str = "cell_id") -> DataFrame:
    """``key``, ``from_cell``, ``to_cell``: cells that a line passes one after the other."""
    return visits_to_links(visits, key, cell, ["edge", "low", "high"])
