"""Pipes: the lines of each order's places over a wall of cells, from text to classes and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.operators.census import TERMINAL, census, visited_links
from geotally.plans.base import Tables, bricks
from geotally.plans.registry import query
from geotally.storage import release, written

COLUMNS, SIZE = 8, 1.0

# A pipe's points lie around the brick of its first supplier, a quarter of a brick apart; some run along boundaries, some beyond the wall.
SQL_PIPES = f"""bases AS (SELECT l_orderkey AS k, min(l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY 1
), places AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i,
         s % {COLUMNS} + 0.5::DOUBLE + (l_partkey % 9 - 4) * 0.25::DOUBLE AS x, s // {COLUMNS} + 0.5 * (s % 2) + 0.5::DOUBLE + (l_partkey // 9 % 9 - 4) * 0.25::DOUBLE AS y FROM lineitem JOIN bases ON k = l_orderkey
), sources AS (
  SELECT o_orderkey AS source_key, NOT (o_orderstatus = 'F' AND o_totalprice < 100000) AS is_active, CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN 'POINT' WHEN o_orderpriority = '5-LOW' THEN 'MULTI'
    WHEN o_orderpriority = '2-HIGH' AND o_totalprice < 50000 THEN 'EMPTY' ELSE 'LINE' END AS kind FROM orders LEFT JOIN bases ON k = o_orderkey
), edges AS (
  SELECT source_key, edge, x1, y1, x2, y2 FROM (SELECT k AS source_key, i AS edge, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM places WINDOW w AS (PARTITION BY k ORDER BY i))
  JOIN sources USING (source_key) WHERE x2 IS NOT NULL AND kind = 'LINE' AND is_active
), cells AS (SELECT s_suppkey AS cell_id, (s_suppkey % {COLUMNS})::DOUBLE AS w, s_suppkey // {COLUMNS} + 0.5::DOUBLE * (s_suppkey % 2) AS s FROM supplier WHERE s_acctbal >= 0
), clipped AS (
  SELECT source_key, edge, cell_id, greatest(0.0, CASE WHEN x2 <> x1 THEN least((w - x1) / (x2 - x1), (w + 1 - x1) / (x2 - x1)) ELSE 0 END, CASE WHEN y2 <> y1 THEN least((s - y1) / (y2 - y1), (s + 1 - y1) / (y2 - y1)) ELSE 0 END) AS low,
         least(1.0, CASE WHEN x2 <> x1 THEN greatest((w - x1) / (x2 - x1), (w + 1 - x1) / (x2 - x1)) ELSE 1 END, CASE WHEN y2 <> y1 THEN greatest((s - y1) / (y2 - y1), (s + 1 - y1) / (y2 - y1)) ELSE 1 END) AS high
  FROM edges JOIN cells ON greatest(x1, x2) >= w AND least(x1, x2) <= w + 1 AND greatest(y1, y2) >= s AND least(y1, y2) <= s + 1 AND (x1 <> x2 OR y1 <> y2)
), parts AS (SELECT * FROM clipped WHERE high - low > 0.000000000001
), ends AS (SELECT *, coalesce(max(high) OVER (PARTITION BY source_key, edge ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS reach FROM parts
), swept AS (SELECT source_key, edge, bool_or(low > reach + 0.000000000001) OR max(high) < 1 - 0.000000000001 AS gapped, bool_or(low < reach - 0.000000000001) AS overlapping FROM ends GROUP BY 1, 2
), rules AS (
  SELECT edges.source_key, bool_or(x1 = x2 AND y1 = y2) AS collapsed, bool_or(coalesce(gapped, x1 <> x2 OR y1 <> y2)) AS gapped, bool_or(coalesce(overlapping, false)) AS overlapping
  FROM edges LEFT JOIN swept ON swept.source_key = edges.source_key AND swept.edge = edges.edge GROUP BY 1
), classes AS (
  SELECT sources.source_key, CASE WHEN NOT is_active THEN '{TERMINAL[0]}' WHEN kind IS NULL THEN '{TERMINAL[1]}' WHEN kind IN ('POINT', 'MULTI') THEN '{TERMINAL[2]}' WHEN kind = 'EMPTY' THEN '{TERMINAL[3]}'
    WHEN collapsed THEN '{TERMINAL[4]}' WHEN gapped THEN '{TERMINAL[5]}' WHEN overlapping THEN '{TERMINAL[6]}' ELSE '{TERMINAL[8]}' END AS terminal_class
  FROM sources LEFT JOIN rules ON rules.source_key = sources.source_key
)"""


def pipes(t: Tables) -> DataFrame:
    """``source_key``, ``is_active`` and ``wkt``, the line of an order's places as text (other types for some)."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("ls"), F.min("l_suppkey").alias("s"))  # the lines of one order
    base_x, base_y = F.col("s") % COLUMNS + F.lit(0.5), F.floor(F.col("s") / COLUMNS) + 0.5 * (F.col("s") % 2) + F.lit(0.5)
    pair = lambda p: F.concat_ws(" ", (base_x + (p["l_partkey"] % 9 - 4) * F.lit(0.25)).cast("string"), (base_y + (F.floor(p["l_partkey"] / 9) % 9 - 4) * F.lit(0.25)).cast("string"))
    body = lines.select("l_orderkey", F.size("ls").alias("n"), F.array_join(F.transform("ls", pair), ", ").alias("body"))
    joined = t.orders.join(body, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    text = (
        F.when(F.col("n").isNull(), F.lit(None)).when(F.col("n") == 1, F.concat(F.lit("POINT("), "body", F.lit(")"))).when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("MULTILINESTRING(("), "body", F.lit("))")))
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") < 50000), "LINESTRING EMPTY").otherwise(F.concat(F.lit("LINESTRING("), "body", F.lit(")")))
    )
    return joined.select(F.col("o_orderkey").alias("source_key"), (~((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000))).alias("is_active"), text.alias("wkt"))


def pipe_census(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes and visits, and the texts that they are of."""
    # Written, and the lines' shuffle let go, before the parts of the lines are dealt.
    sources = written(pipes(t), "pipes")
    release(t.spark)
    return *census(sources, bricks(t.supplier.where("s_acctbal >= 0"), "s_suppkey", COLUMNS), SIZE), sources


@query(f"WITH {SQL_PIPES} SELECT source_key, terminal_class FROM classes")
def terminal_classes(t: Tables) -> DataFrame:
    """Exactly one of nine classes for every source, from its geometry over the cells."""
    return pipe_census(t)[0]


@query(f"WITH {SQL_PIPES} SELECT source_key, edge::INTEGER AS edge, cell_id, round(low, 9) AS low, round(high, 9) AS high FROM parts JOIN classes USING (source_key) WHERE terminal_class = '{TERMINAL[-1]}'")
def pipe_fragments(t: Tables) -> DataFrame:
    """The parts of all admitted lines in the cells, in the order of the line."""
    return pipe_census(t)[1].select("source_key", "edge", "cell_id", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""WITH {SQL_PIPES}, walked AS (
  SELECT source_key, edge, low, high, cell_id, lag(cell_id) OVER (PARTITION BY source_key ORDER BY edge, low, high, cell_id) AS before FROM parts JOIN classes USING (source_key) WHERE terminal_class = '{TERMINAL[-1]}'
), moved AS (SELECT * FROM walked WHERE before IS NULL OR before <> cell_id
), next_ones AS (SELECT source_key, cell_id, lead(cell_id) OVER (PARTITION BY source_key ORDER BY edge, low, high, cell_id) AS after FROM moved
), links AS (SELECT DISTINCT source_key, least(cell_id, after) AS from_cell, greatest(cell_id, after) AS to_cell FROM next_ones WHERE after IS NOT NULL AND after <> cell_id
), lengths AS (SELECT source_key, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS length FROM edges GROUP BY 1)
SELECT from_cell, to_cell, count(*) AS n_sources, round(sum(length), 6) AS total_length FROM links JOIN lengths USING (source_key) GROUP BY 1, 2""")
def pipe_links(t: Tables) -> DataFrame:
    """Links between cells that lines pass one after the other, with the lines' number and whole length."""
    _, visits, sources = pipe_census(t)
    from geotally.functions.geometry import line_from_wkt
    from geotally.functions.spatial import polyline_length

    # The text is read once: as an argument it would be read again wherever the length names the line.
    lengths = sources.select("source_key", F.get(F.transform(F.array(line_from_wkt(F.col("wkt"))), polyline_length), 0).alias("length"))
    return visited_links(visits).join(lengths, "source_key").groupBy("from_cell", "to_cell").agg(F.count("*").alias("n_sources"), F.round(F.sum("length"), 6).alias("total_length"))
