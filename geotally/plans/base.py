"""The domain that the registered queries run on, derived from the given tables.

Cells are customers with an area; a dense layer counts their orders, a partial layer takes
the share of purchases among a user's events, an overlay counts errors.  Suppliers are the
cells of the network: an order's lines, in order, visit them.  ``SQL`` has the same relations
as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.functions import exact


class Tables:
    """The given tables and the relations made of them, for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cells(self) -> DataFrame:
        """cell_id, area (whole numbers, so sums are exact in any order), nation_id, segment."""
        area = (1000 + (F.col("c_custkey") * 37 % 500) * 10).cast("double")
        return self.customer.select(F.col("c_custkey").alias("cell_id"), area.alias("area"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"))

    def cell_features(self) -> DataFrame:
        """Per cell: dense count and density (zero where none), partial share and overlay (null where none)."""
        sites = self.orders.groupBy(F.col("o_custkey").alias("cell_id")).agg(F.count("*").alias("sites"))
        users = self.events.groupBy(F.col("user_id").alias("cell_id")).agg(
            F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count("*").alias("n_events"),
            F.countDistinct(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("errors"),
        )
        return (
            self.cells().join(sites, "cell_id", "left").join(users, "cell_id", "left")
            .select(
                "cell_id", "area", "nation_id", "segment", F.coalesce("sites", F.lit(0)).alias("sites"),
                (F.coalesce("sites", F.lit(0)) * 1e6 / F.col("area")).alias("dense"),
                F.try_divide(F.col("purchases").cast("double"), F.col("n_events").cast("double")).alias("partial"),
                F.when(F.col("errors") > 0, F.col("errors").cast("double")).alias("overlay"),
            )
        )

    def layers(self) -> DataFrame:
        """One row per cell and layer: variant, cell_id, area, value."""
        values = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("value")) for v in ("dense", "partial", "overlay")])
        return self.cell_features().select("cell_id", "area", F.inline(values))

    def supplier_metrics(self) -> DataFrame:
        """Five metrics of each supplier from its lines; decimals, so sums are exact.

        Lines are summed by supplier and quantity first: a median of rows as such keeps them all in
        objects, and Spark sorts them once a task has more than a hundred suppliers.
        """
        taxed = F.col("l_tax") > 0.02
        # Sums of decimals that don't fit a long are many times slower: cents that are plain to see are summed as longs, others apart.
        cents = lambda c: F.when(F.abs(c) < 1e7, exact.quick_units(F.col(c), 2))
        plain = lambda c, rows: F.sum(F.when(rows, cents(c)))
        other = lambda c, rows: F.sum(F.when(rows & cents(c).isNull(), F.col(c)).cast("decimal(18,2)"))
        money = {"discount": ("l_discount", F.lit(True)), "price": ("l_extendedprice", taxed), "taxed": ("l_quantity", taxed)}
        days = F.datediff(F.lit("2002-01-01").cast("date"), F.col("l_shipdate").cast("date"))
        counted = self.lineitem.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_quantity").alias("quantity")).agg(
            F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(days).alias("days"),
            *[plain(*x).alias(k) for k, x in money.items()], *[other(*x).alias(f"other_{k}") for k, x in money.items()],
        )
        n = F.sum("n").cast("double")

        def total(c: str) -> Column:
            if c not in money:
                return F.sum(c).cast("double")
            rest = F.sum(f"other_{c}")
            whole = F.coalesce(F.sum(c).cast("decimal(20,0)"), F.lit(0)) * F.lit("0.01").cast("decimal(2,2)") + F.coalesce(rest, F.lit(0))
            return F.when(F.sum(c).isNotNull() | rest.isNotNull(), whole).cast("double")

        return counted.groupBy("cell_id").agg(
            F.sum("n").alias("n_lines"), (total("returned") / n).alias("returned"), (total("discount") / n).alias("discount"),
            F.try_divide(total("price"), total("taxed")).alias("price"), F.percentile("quantity", F.lit(0.5), F.col("n")).alias("quantity"), (total("days") / n / 365.2425).alias("age"),
        )

    def points(self) -> DataFrame:
        """A place for each order, inside a box of a fifth of a degree."""
        return self.orders.select(
            F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("cell_id"),
            (121.45 + (F.col("o_orderkey") * 7919 % 20000) / 1e5).alias("lon"), (25.0 + (F.col("o_orderkey") * 104729 % 20000) / 1e5).alias("lat"),
        )


def bricks(df: DataFrame, key: str, columns: int, place=lambda x, y: (x, y)) -> DataFrame:
    """``cell_id`` and ``rings``: the keys as a wall of bricks of unit size, every second column half a brick
    higher, each corner where ``place`` puts it."""
    west, south = (F.col(key) % columns).cast("double"), F.floor(F.col(key) / columns) + 0.5 * (F.col(key) % columns % 2)
    ring = []
    for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)):
        x, y = place(west + dx, south + dy)
        ring.append(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return df.select(F.col(key).alias("cell_id"), F.array(F.array(*ring)).alias("rings"))


#: Directions of the five metrics, and whether a metric's gate is passed.
METRICS = (("returned", "HIGHER", "PASS_REVIEW"), ("discount", "LOWER", "PASS_REVIEW"), ("price", "HIGHER", "PENDING"), ("quantity", "LOWER", "PASS_SOURCE"), ("age", "HIGHER", "PASS_"))

SQL_CELLS = """cells AS (
  SELECT c_custkey AS cell_id, (1000 + (c_custkey * 37 % 500) * 10)::DOUBLE AS area, c_nationkey AS nation_id, c_mktsegment AS segment FROM customer
)"""
SQL_FEATURES = f"""{SQL_CELLS}, cell_features AS (
  SELECT cells.*, coalesce(sites, 0) AS sites, coalesce(sites, 0) * 1e6 / area AS dense,
         purchases::DOUBLE / n_events::DOUBLE AS partial, CASE WHEN errors > 0 THEN errors::DOUBLE END AS overlay
  FROM cells
  LEFT JOIN (SELECT o_custkey AS cell_id, count(*) AS sites FROM orders GROUP BY 1) USING (cell_id)
  LEFT JOIN (SELECT user_id AS cell_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS n_events,
                    count(DISTINCT event_id) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) USING (cell_id)
)"""
SQL_LAYERS = f"""{SQL_FEATURES}, layers AS (
  SELECT 'dense' AS variant, cell_id, area, dense AS value FROM cell_features
  UNION ALL SELECT 'partial', cell_id, area, partial FROM cell_features
  UNION ALL SELECT 'overlay', cell_id, area, overlay FROM cell_features
)"""


def sql_select(source: str, target: str, *, share: float = 0.10, keys: str = "variant", total: str = "sum(area) OVER (PARTITION BY variant)") -> str:
    """Scores to selections: the top share of area with all ties at the threshold."""
    return f"""{target}_running AS (
  SELECT *, sum(CASE WHEN score IS NULL THEN 0 ELSE area END) OVER (PARTITION BY {keys} ORDER BY score DESC NULLS LAST, cell_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - area AS taken, {total} AS area_total FROM {source}
), {target}_threshold AS (
  SELECT {keys}, min(score) AS threshold FROM {target}_running WHERE score IS NOT NULL AND taken < {share} * area_total GROUP BY {keys}
), {target} AS (
  SELECT s.*, t.threshold, coalesce(s.score >= t.threshold, false) AS selected FROM {source} s LEFT JOIN {target}_threshold t USING ({keys})
)"""


SQL_SCORED = f"""{SQL_LAYERS}, scored AS (
  SELECT variant, cell_id, area, value,
         CASE WHEN value IS NOT NULL THEN percent_rank() OVER (PARTITION BY variant, value IS NULL ORDER BY value) END AS score FROM layers
)"""
SQL_SELECTED = f"{SQL_SCORED}, {sql_select('scored', 'chosen')}"
SQL_METRICS = """supplier_metrics AS (
  SELECT l_suppkey AS cell_id, count(*) AS n_lines,
         (count(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE / count(*)::DOUBLE AS returned,
         sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*)::DOUBLE AS discount,
         (sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_tax > 0.02))::DOUBLE / (sum(l_quantity::DECIMAL(18,2)) FILTER (WHERE l_tax > 0.02))::DOUBLE AS price,
         median(l_quantity) AS quantity,
         sum(date_diff('day', l_shipdate::DATE, DATE '2002-01-01'))::DOUBLE / count(*)::DOUBLE / 365.2425 AS age
  FROM lineitem GROUP BY 1
), metric_rows AS (
""" + "\n  UNION ALL ".join(f"SELECT '{m}' AS variant, '{d}' AS direction, '{g}' AS gate, cell_id, {m} AS value FROM supplier_metrics" for m, d, g in METRICS) + """
), metric_ranks AS (
  SELECT *, CASE WHEN value IS NOT NULL THEN percent_rank() OVER (PARTITION BY variant, value IS NULL ORDER BY CASE WHEN direction = 'LOWER' THEN -value ELSE value END) END AS diagnostic
  FROM metric_rows
), metric_index AS (
  SELECT cell_id, CASE WHEN count(diagnostic) = 5 THEN sum(diagnostic) / 5 END AS attribute FROM metric_ranks GROUP BY 1
)"""
