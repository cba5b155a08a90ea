"""Freeze-gated evaluation: captures, lifts, common-support ranks and serving summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.operators.merging import freeze, frozen_only
from geotally.operators.ranking import top_share
from geotally.plans.base import SQL_SELECTED, Tables, sql_select
from geotally.plans.layers import AREA, scored_layers, selected_layers
from geotally.plans.registry import query

SQL_REPORTS = "reports AS (SELECT event_id AS report_id, user_id * 2 AS cell_id, value, ts FROM events WHERE event_type = 'error')"


def reports(t: Tables) -> DataFrame:
    """Outcomes: error events at cells, of which some lie off the grid."""
    return t.events.where("event_type = 'error'").select(F.col("event_id").alias("report_id"), (F.col("user_id") * 2).alias("cell_id"), "value", "ts")


def frozen_layers(t: Tables) -> DataFrame:
    """Layers behind the gate: outcomes may be joined only to a frozen release."""
    chosen = selected_layers(t).where("variant <> 'overlay'")
    frozen, manifest = freeze(chosen, "t0", {"method": "percent_rank_top_area"})
    frozen_only(manifest, "t0")
    return frozen


def captured(layers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Share of all outcomes in selected cells; the denominator has those off the grid too."""
    hits = layers.join(outcomes, "cell_id").groupBy("variant").agg(
        F.countDistinct(F.when(F.col("selected"), F.col("report_id"))).alias("n_captured"), F.countDistinct(F.when(F.col("score").isNull(), F.col("report_id"))).alias("n_unscored"), F.countDistinct("report_id").alias("n_matched")
    )
    total = outcomes.agg(F.countDistinct("report_id").alias("n_reports"))
    areas = layers.groupBy("variant").agg(F.try_divide(F.sum(F.when(F.col("selected"), F.col("area")).otherwise(0.0)), F.sum("area")).alias("area_share"))
    one = areas.join(hits, "variant", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = F.try_divide(zero("n_captured").cast("double"), F.col("n_reports").cast("double"))
    return one.select(
        "variant", "n_reports", zero("n_captured").alias("n_captured"), (F.col("n_reports") - zero("n_matched")).alias("n_off_grid"), zero("n_unscored").alias("n_unscored"), "area_share",
        share.alias("capture"), F.try_divide(share, F.col("area_share")).alias("lift"),
    )


def sql_captured(layers: str) -> str:
    return f"""SELECT variant, n_reports, n_captured, n_reports - n_matched AS n_off_grid, n_unscored, area_share, n_captured::DOUBLE / n_reports::DOUBLE AS capture, n_captured::DOUBLE / n_reports::DOUBLE / area_share AS lift FROM (
  SELECT variant, (SELECT count(DISTINCT report_id) FROM reports) AS n_reports, count(DISTINCT CASE WHEN selected THEN report_id END) AS n_captured,
         count(DISTINCT report_id) AS n_matched, count(DISTINCT CASE WHEN score IS NULL THEN report_id END) AS n_unscored FROM {layers} LEFT JOIN reports USING (cell_id) GROUP BY variant)
  JOIN (SELECT variant, sum(CASE WHEN selected THEN area ELSE 0 END) / sum(area) AS area_share FROM {layers} GROUP BY variant) USING (variant)"""


SQL_FROZEN = f"{SQL_SELECTED}, {SQL_REPORTS}, frozen AS (SELECT * FROM chosen WHERE variant <> 'overlay')"


@query(f"WITH {SQL_FROZEN} {sql_captured('frozen')}")
def capture_lift(t: Tables) -> DataFrame:
    """Capture and lift over area by layer."""
    return captured(frozen_layers(t), reports(t))


SQL_SUPPORT = f"""{SQL_FROZEN}, support AS (
  SELECT cell_id FROM frozen WHERE score IS NOT NULL GROUP BY cell_id HAVING count(*) = 2
), common AS (SELECT variant, f.cell_id, area, score FROM frozen f JOIN support USING (cell_id)), {sql_select('common', 'reranked')}"""


def reranked(t: Tables) -> DataFrame:
    """Both layers on the cells that both score; the area is that of these cells."""
    frozen = frozen_layers(t).select("variant", "cell_id", "area", "score")
    support = frozen.where("score IS NOT NULL").groupBy("cell_id").count().where("count = 2").select("cell_id")
    return top_share(frozen.join(support, "cell_id", "left_semi"), ["variant"], "score", AREA)


@query(f"WITH {SQL_SUPPORT} SELECT variant, cell_id, area, score, threshold, selected FROM reranked")
def common_support_rerank(t: Tables) -> DataFrame:
    """Selections of both layers on their common support."""
    return reranked(t).select("variant", "cell_id", "area", "score", "threshold", "selected")


@query(f"WITH {SQL_SUPPORT}, c AS ({sql_captured('reranked')}) SELECT a.capture AS capture_partial, b.capture AS capture_dense, round(a.capture - b.capture, 12) AS difference, a.capture / b.capture AS lift_over_dense, a.n_reports FROM c a, c b WHERE a.variant = 'partial' AND b.variant = 'dense'")
def concordance_difference(t: Tables) -> DataFrame:
    """One row: the layer against its baseline, and their difference."""
    c = captured(reranked(t), reports(t))
    wide = c.groupBy("n_reports").pivot("variant", ["partial", "dense"]).agg(F.max("capture"))
    return wide.select(F.col("partial").alias("capture_partial"), F.col("dense").alias("capture_dense"), F.round(F.col("partial") - F.col("dense"), 12).alias("difference"), F.try_divide("partial", "dense").alias("lift_over_dense"), "n_reports")


@query(f"WITH {SQL_FROZEN}, near AS (SELECT DISTINCT c.variant, r.report_id, 0 AS tolerance FROM frozen c JOIN reports r ON c.selected AND r.cell_id = c.cell_id UNION SELECT DISTINCT c.variant, r.report_id, 1 FROM frozen c JOIN reports r ON c.selected AND abs(r.cell_id - c.cell_id) <= 1) SELECT variant, tolerance, count(DISTINCT report_id) AS n_captured, (SELECT count(*) FROM reports) AS n_reports FROM near GROUP BY 1, 2")
def evaluation_summary(t: Tables) -> DataFrame:
    """Exact hits and hits within a tolerance, as one table.

    Neighbours are an equal join on the three keys that a selected cell reaches.
    """
    chosen = frozen_layers(t).where("selected").select("variant", F.col("cell_id").alias("own"))
    reach = chosen.select("variant", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("cell_id"), "own")
    hits = reach.join(reports(t), "cell_id").select("variant", "report_id", (F.col("cell_id") == F.col("own")).alias("exact"))
    total = reports(t).agg(F.count("*").alias("n_reports"))
    exact = hits.where("exact").groupBy("variant").agg(F.countDistinct("report_id").alias("n_captured")).withColumn("tolerance", F.lit(0))
    near = hits.groupBy("variant").agg(F.countDistinct("report_id").alias("n_captured")).withColumn("tolerance", F.lit(1))
    return exact.unionByName(near).crossJoin(F.broadcast(total)).select("variant", "tolerance", "n_captured", "n_reports")


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, min(ts) + INTERVAL 8 HOUR AS first_local FROM events GROUP BY event_type")
def window_offset(t: Tables) -> DataFrame:
    """A local window eight hours from the stored one, kept beside it."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts")).withColumn("first_local", F.col("first_ts") + F.expr("INTERVAL 8 HOURS"))


@query("SELECT e.event_id, e.user_id FROM events e ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = e.user_id")
def anti_join_unmatched(t: Tables) -> DataFrame:
    """Events of users without a positive balance."""
    return t.events.join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("event_id", "user_id")


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN events ON user_id = c_custkey")
def semi_join_grid_coverage(t: Tables) -> DataFrame:
    """Cells that have an event."""
    return t.customer.join(t.events, F.col("c_custkey") == F.col("user_id"), "left_semi").select("c_custkey", "c_name")


@query(f"WITH {SQL_FROZEN} SELECT 't0' AS release, 'FROZEN' AS state, count(*) AS n_rows, 'percent_rank_top_area' AS method FROM frozen")
def freeze_manifest(t: Tables) -> DataFrame:
    """The manifest of a frozen release."""
    return freeze(selected_layers(t).where("variant <> 'overlay'"), "t0", {"method": "percent_rank_top_area"})[1]


@query(f"WITH {SQL_FROZEN} SELECT variant, count(*) AS n, count(*) FILTER (WHERE score IS NOT NULL AND cell_id % 50 = 0) AS n_changed, count(*) FILTER (WHERE score IS NULL AND cell_id % 50 = 0) AS n_null_kept FROM frozen GROUP BY 1")
def reproduction_check(t: Tables) -> DataFrame:
    """A release against a recomputation in which every fiftieth cell's score has moved: the changed
    rows are found row by row, and null scores that stayed null are not among them."""
    frozen = frozen_layers(t)
    moved = F.when(F.col("cell_id") % 50 == 0, F.col("score") + 1).otherwise(F.col("score"))
    again = selected_layers(t).select(F.col("variant").alias("v"), F.col("cell_id").alias("c"), moved.alias("s"), F.col("selected").alias("f"))
    both = frozen.join(again, (F.col("variant") == F.col("v")) & (F.col("cell_id") == F.col("c")), "left")
    changed = ~(F.col("score").eqNullSafe(F.col("s")) & F.col("selected").eqNullSafe(F.col("f")))
    return both.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(changed).alias("n_changed"), F.count_if(F.col("score").isNull() & F.col("s").isNull() & (F.col("c") % 50 == 0)).alias("n_null_kept"))
