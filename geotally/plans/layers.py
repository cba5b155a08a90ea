"""Layer ranking: features, percent ranks, selections, qualities and composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotally.operators.ranking import percent_rank, running, top_share
from geotally.plans.base import METRICS, SQL_FEATURES, SQL_METRICS, SQL_SCORED, SQL_SELECTED, Tables, sql_select
from geotally.plans.registry import query
from geotally.storage import cut

AREA = "area"  # a name, since columns need a session


def scored_layers(t: Tables) -> DataFrame:
    return percent_rank(t.layers(), ["variant"], "value")


def selected_layers(t: Tables, share: float = 0.10) -> DataFrame:
    return top_share(cut(scored_layers(t)), ["variant"], "score", AREA, share=share)


@query(f"WITH {SQL_FEATURES} SELECT cell_id, area, nation_id, segment, sites::BIGINT AS sites, dense, partial, overlay FROM cell_features")
def cell_features(t: Tables) -> DataFrame:
    """Star of left joins on cells: zero where a count is known to be zero, null where unknown."""
    return t.cell_features()


@query(f"WITH {SQL_SELECTED} SELECT variant, cell_id, area, value, score, threshold, selected FROM chosen")
def layer_rank_topk_area(t: Tables) -> DataFrame:
    """Each layer's percent ranks and the top tenth of area with all ties."""
    return selected_layers(t).select("variant", "cell_id", "area", "value", "score", "threshold", "selected")


def quality(selected: DataFrame) -> DataFrame:
    return selected.groupBy("variant").agg(
        F.count("*").alias("n_cells"), F.count("score").alias("n_scored"),
        F.sum(F.when(F.col("score").isNotNull(), F.col(AREA)).otherwise(0.0)).alias("scored_area"),
        F.try_divide(F.sum(F.when(F.col("score").isNotNull(), F.col(AREA)).otherwise(0.0)), F.sum("area")).alias("scored_share"),
        F.count_if("selected").alias("n_selected"),
        F.try_divide(F.sum(F.when(F.col("selected"), F.col(AREA)).otherwise(0.0)), F.sum("area")).alias("selected_share"),
        F.min("score").alias("least"), F.max("score").alias("most"), F.min("threshold").alias("threshold"),
    )


SQL_QUALITY = """SELECT variant, count(*) AS n_cells, count(score) AS n_scored, sum(CASE WHEN score IS NOT NULL THEN area ELSE 0 END) AS scored_area,
  sum(CASE WHEN score IS NOT NULL THEN area ELSE 0 END) / sum(area) AS scored_share, count(*) FILTER (WHERE selected) AS n_selected,
  sum(CASE WHEN selected THEN area ELSE 0 END) / sum(area) AS selected_share, min(score) AS least, max(score) AS most, min(threshold) AS threshold"""


@query(f"WITH {SQL_SELECTED} {SQL_QUALITY} FROM chosen GROUP BY variant")
def layer_quality(t: Tables) -> DataFrame:
    """Coverage and selection by layer."""
    return quality(selected_layers(t))


@query("".join((f"WITH {SQL_SCORED}, ", ", ".join(sql_select("scored", f"top{s}", share=s / 100) for s in (5, 10, 20)), " ", " UNION ALL ".join(f"SELECT '{s}' AS percent, variant, count(*) FILTER (WHERE selected) AS n_selected, sum(CASE WHEN selected THEN area ELSE 0 END) AS selected_area FROM top{s} GROUP BY variant" for s in (5, 10, 20)))))
def topk_sensitivity(t: Tables) -> DataFrame:
    """Selections at three shares of area."""
    scored = cut(scored_layers(t))
    parts = [
        top_share(scored, ["variant"], "score", AREA, share=s / 100).groupBy("variant")
        .agg(F.count_if("selected").alias("n_selected"), F.sum(F.when(F.col("selected"), F.col(AREA)).otherwise(0.0)).alias("selected_area")).withColumn("percent", F.lit(str(s)))
        for s in (5, 10, 20)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {SQL_SELECTED} SELECT cell_id, area, score, selected, sum(CASE WHEN score IS NULL THEN 0 ELSE area END) OVER (ORDER BY score DESC NULLS LAST, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_area FROM chosen WHERE variant = 'partial' AND score IS NOT NULL")
def running_area(t: Tables) -> DataFrame:
    """Area taken up to each cell, by falling score and then by id."""
    found = running_areas(t).where("variant = 'partial' AND score IS NOT NULL")
    return found.select("cell_id", "area", "score", "selected", "running_area")


@query(f"WITH {SQL_SELECTED} SELECT variant, cell_id, area, score, selected, sum(CASE WHEN score IS NULL THEN 0 ELSE area END) OVER (PARTITION BY variant ORDER BY score DESC NULLS LAST, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_area FROM chosen")
def running_area_by_layer(t: Tables) -> DataFrame:
    """Area taken up to each cell in every layer, unscored cells last."""
    return running_areas(t).select("variant", "cell_id", "area", "score", "selected", "running_area")


def running_areas(t: Tables) -> DataFrame:
    taken = F.when(F.col("score").isNotNull(), F.col(AREA)).otherwise(0)
    return running(cut(selected_layers(t)), ["variant"], "score", "cell_id", taken, name="running_area")


# --- five metrics -----------------------------------------------------------------------------

def metric_ranks(t: Tables) -> DataFrame:
    """variant, direction, gate, cell_id, value, diagnostic: unpivoted metrics with directed ranks."""
    rows = F.array(*[F.struct(F.lit(m).alias("variant"), F.lit(d).alias("direction"), F.lit(g).alias("gate"), F.col(m).cast("double").alias("value")) for m, d, g in METRICS])
    directed = t.supplier_metrics().select("cell_id", F.inline(rows)).withColumn("ordered", F.when(F.col("direction") == "LOWER", -F.col("value")).otherwise(F.col("value")))
    # Written once: the ranks are made of it and joined back to it.
    return percent_rank(cut(directed), ["variant"], "ordered", name="diagnostic").drop("ordered")


def metric_index(t: Tables) -> DataFrame:
    """Mean of the five ranks where all five are known."""
    return metric_ranks(t).groupBy("cell_id").agg(F.when(F.count("diagnostic") == 5, F.sum("diagnostic") / 5).alias("attribute"))


@query(f"WITH {SQL_METRICS} SELECT variant, direction, gate, cell_id, value, diagnostic, CASE WHEN gate LIKE 'PASS_%' THEN diagnostic END AS metric_score FROM metric_ranks")
def metric_unpivot_rank(t: Tables) -> DataFrame:
    """Metrics as rows, ranked in their direction; a score only behind a passed gate."""
    return metric_ranks(t).withColumn("metric_score", F.when(F.col("gate").like("PASS_%"), F.col("diagnostic")))


@query(f"WITH {SQL_METRICS} SELECT cell_id, round(attribute, 9) AS attribute FROM metric_index")
def metric_complete_case(t: Tables) -> DataFrame:
    """Five-metric mean on complete cases only; nothing is imputed or re-weighted."""
    return metric_index(t).select("cell_id", F.round("attribute", 9).alias("attribute"))


@query(f"WITH {SQL_METRICS} SELECT variant, count(*) AS n, count(value) AS n_valued, bool_and(gate LIKE 'PASS_%') AS gate_passed, bool_or(value = 0) AS any_zero, min(gate) AS gate, count(*) FILTER (WHERE diagnostic >= 0.9) AS n_top FROM metric_ranks GROUP BY variant HAVING count(*) > 1")
def metric_quality(t: Tables) -> DataFrame:
    """Counts, boolean aggregates and constants by metric."""
    return (
        metric_ranks(t).groupBy("variant").agg(
            F.count("*").alias("n"), F.count("value").alias("n_valued"), F.bool_and(F.col("gate").like("PASS_%")).alias("gate_passed"),
            F.bool_or(F.col("value") == 0).alias("any_zero"), F.min("gate").alias("gate"), F.count_if(F.col("diagnostic") >= 0.9).alias("n_top"),
        ).where("n > 1")
    )


@query(f"WITH {SQL_METRICS} SELECT cell_id, n_lines, round(returned, 9) AS returned, round(discount, 9) AS discount, round(price, 6) AS price, quantity, round(age, 9) AS age FROM supplier_metrics")
def weighted_means(t: Tables) -> DataFrame:
    """Ratios of sums with each metric's own valid weight, and an exact median."""
    return t.supplier_metrics().select("cell_id", "n_lines", *[F.round(c, 6 if c == "price" else 9).alias(c) for c in ("returned", "discount", "price")], "quantity", F.round("age", 9).alias("age"))


# --- composites -------------------------------------------------------------------------------

SQL_SCENARIOS = f"""{SQL_SELECTED}, wide AS (
  SELECT cell_id, area, max(score) FILTER (WHERE variant = 'dense') AS dense, max(score) FILTER (WHERE variant = 'partial') AS partial,
         max(score) FILTER (WHERE variant = 'overlay') AS overlay FROM chosen GROUP BY cell_id, area
), scenario_scores AS (
  SELECT 'dense' AS variant, cell_id, area, dense AS score FROM wide
  UNION ALL SELECT 'partial', cell_id, area, partial FROM wide
  UNION ALL SELECT 'overlay', cell_id, area, overlay FROM wide
  UNION ALL SELECT 'composite', cell_id, area, (dense + partial + overlay) / 3 FROM wide
  UNION ALL SELECT 'without_dense', cell_id, area, (partial + overlay) / 2 FROM wide
  UNION ALL SELECT 'without_partial', cell_id, area, (dense + overlay) / 2 FROM wide
  UNION ALL SELECT 'without_overlay', cell_id, area, (dense + partial) / 2 FROM wide
), {sql_select('scenario_scores', 'scenarios')}"""


def wide_scores(t: Tables) -> DataFrame:
    """Pivot: a column of scores for each layer."""
    return scored_layers(t).groupBy("cell_id", "area").pivot("variant", ["dense", "partial", "overlay"]).agg(F.max("score"))


def scenarios(t: Tables) -> DataFrame:
    """Layers, the equal-group composite and its ablations; null unless every group is known."""
    d, p, o = F.col("dense"), F.col("partial"), F.col("overlay")
    rows = {"dense": d, "partial": p, "overlay": o, "composite": (d + p + o) / 3, "without_dense": (p + o) / 2, "without_partial": (d + o) / 2, "without_overlay": (d + p) / 2}
    unpivoted = wide_scores(t).select("cell_id", "area", F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("score")) for k, v in rows.items()])))
    return top_share(cut(unpivoted), ["variant"], "score", AREA)


@query(f"WITH {SQL_SCENARIOS} SELECT variant, cell_id, area, score, threshold, selected FROM scenarios")
def scenario_scores(t: Tables) -> DataFrame:
    """Seven scenarios with their selections."""
    return scenarios(t).select("variant", "cell_id", "area", "score", "threshold", "selected")


@query(f"WITH {SQL_SCENARIOS} {SQL_QUALITY} FROM scenarios GROUP BY variant")
def scenario_quality(t: Tables) -> DataFrame:
    """Coverage and selection by scenario."""
    return quality(scenarios(t))


@query(f"""WITH {SQL_SCENARIOS}, pairs AS (
  SELECT a.variant AS left_variant, b.variant AS right_variant, a.area, a.score AS x, b.score AS y, a.selected AS s, b.selected AS r
  FROM scenarios a JOIN scenarios b ON a.cell_id = b.cell_id AND a.variant < b.variant WHERE a.score IS NOT NULL AND b.score IS NOT NULL
) SELECT left_variant, right_variant, count(*) AS n_common,
  CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS correlation,
  sum(CASE WHEN s AND r THEN area ELSE 0 END) / nullif(sum(CASE WHEN s OR r THEN area ELSE 0 END), 0) AS jaccard,
  round(avg(x), 9) AS left_mean, round(stddev_pop(x), 9) AS left_sd FROM pairs GROUP BY 1, 2""")
def variant_pairwise_corr_jaccard(t: Tables) -> DataFrame:
    """Correlation and area Jaccard of each pair of scenarios on their common support."""
    base = cut(scenarios(t)).where("score IS NOT NULL").select("cell_id", "variant", "area", "score", "selected")
    right = base.select("cell_id", F.col("variant").alias("right_variant"), F.col("score").alias("y"), F.col("selected").alias("r"))
    pairs = base.join(right, "cell_id").where("variant < right_variant")  # at most seven rows a cell on either side
    area = lambda c: F.sum(F.when(c, F.col(AREA)).otherwise(0.0))
    spread = F.count("*") > 1
    return (
        pairs.groupBy(F.col("variant").alias("left_variant"), "right_variant").agg(
            F.count("*").alias("n_common"), F.stddev_pop("score").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("score", "y").alias("c"),
            F.try_divide(area(F.col("selected") & F.col("r")), area(F.col("selected") | F.col("r"))).alias("jaccard"), F.round(F.avg("score"), 9).alias("left_mean"),
        ).select(
            "left_variant", "right_variant", "n_common",
            F.when((F.col("n_common") > 1) & (F.col("sx") > 0) & (F.col("sy") > 0), F.round(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")), 6)).alias("correlation"),
            "jaccard", "left_mean", F.round("sx", 9).alias("left_sd"),
        )
    )


#: Selections of two variants that share less of their area are unstable (fixed value).
STABLE = 0.6


@query(f"""WITH {SQL_SCENARIOS}, pairs AS (SELECT a.variant, a.area, a.selected AS s, b.selected AS r FROM scenarios a JOIN scenarios b ON a.cell_id = b.cell_id AND b.variant = 'composite' AND a.variant <> 'composite'
  WHERE a.score IS NOT NULL AND b.score IS NOT NULL), shared AS (SELECT variant, round(sum(CASE WHEN s AND r THEN area ELSE 0 END) / nullif(sum(CASE WHEN s OR r THEN area ELSE 0 END), 0), 9) AS jaccard FROM pairs GROUP BY 1)
SELECT variant, jaccard, coalesce(jaccard >= {STABLE}, false) AS stable FROM shared""")
def stability_gate(t: Tables) -> DataFrame:
    """Which ablations keep the composite's selection: an area Jaccard of at least 0.6 on common support."""
    rows = cut(scenarios(t).where("score IS NOT NULL").select("variant", "cell_id", "area", "selected"))
    whole = rows.where("variant = 'composite'").select("cell_id", F.col("selected").alias("chosen"))
    pairs = rows.where("variant <> 'composite'").join(whole, "cell_id")
    area = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0))
    shared = pairs.groupBy("variant").agg(F.round(F.try_divide(area(F.col("selected") & F.col("chosen")), area(F.col("selected") | F.col("chosen"))), 9).alias("jaccard"))
    return shared.withColumn("stable", F.coalesce(F.col("jaccard") >= STABLE, F.lit(False)))


@query(f"""WITH {SQL_SCENARIOS}, flat AS (
  SELECT cell_id, area, bool_or(selected AND variant = 'composite') AS in_composite, max(score) FILTER (WHERE variant = 'composite') AS composite,
         max(score) FILTER (WHERE variant = 'dense') AS dense, max(score) FILTER (WHERE variant = 'partial') AS partial FROM scenarios GROUP BY 1, 2
) SELECT cell_id, area, in_composite, round(composite, 9) AS composite, dense, partial,
  CASE WHEN dense IS NULL OR partial IS NULL THEN 'unscored_missing_group' ELSE 'eligible' END AS coverage_state,
  concat_ws(',', CASE WHEN composite IS NULL THEN 'COMPOSITE_MISSING' END, 'NOT_A_PROBABILITY', CASE WHEN partial IS NULL THEN 'PARTIAL_MISSING' END) AS limitation_codes,
  least(4, floor(coalesce(dense, 0) * 5))::INTEGER AS colour_bin, NULL::DOUBLE AS probability FROM flat""")
def map_payload_pivot(t: Tables) -> DataFrame:
    """Serving rows: pivoted scores, states and sorted limitation codes; a rank is no probability."""
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("score")))
    flat = scenarios(t).groupBy("cell_id", "area").agg(
        F.bool_or(F.col("selected") & (F.col("variant") == "composite")).alias("in_composite"), pick("composite").alias("composite"), pick("dense").alias("dense"), pick("partial").alias("partial")
    )
    codes = F.array(F.when(F.col("composite").isNull(), "COMPOSITE_MISSING"), F.lit("NOT_A_PROBABILITY"), F.when(F.col("partial").isNull(), "PARTIAL_MISSING"))
    return flat.select(
        "cell_id", "area", "in_composite", F.round("composite", 9).alias("composite"), "dense", "partial",
        F.when(F.col("dense").isNull() | F.col("partial").isNull(), "unscored_missing_group").otherwise("eligible").alias("coverage_state"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))), ",").alias("limitation_codes"),
        F.least(F.lit(4), F.floor(F.coalesce("dense", F.lit(0.0)) * 5)).cast("int").alias("colour_bin"), F.lit(None).cast("double").alias("probability"),
    )


@query(f"""WITH {SQL_SELECTED}, w AS (SELECT cell_id, max(score) FILTER (WHERE variant='dense') AS a, max(score) FILTER (WHERE variant='partial') AS b, max(score) FILTER (WHERE variant='overlay') AS c FROM scored GROUP BY 1)
SELECT cell_id, round((coalesce(a,0)+coalesce(b,0)+coalesce(c,0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT), 9) AS mean_available FROM w""")
def mean_of_available(t: Tables) -> DataFrame:
    """The fallback of map clients: the mean of the scores that are known."""
    known = F.filter(F.array("dense", "partial", "overlay"), lambda x: x.isNotNull())
    return wide_scores(t).select("cell_id", F.round(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known).cast("double")), 9).alias("mean_available"))


@query(f"""WITH {SQL_SCENARIOS} SELECT variant, cell_id, round(score, 9) AS score, row_number() OVER (PARTITION BY variant ORDER BY score DESC, cell_id)::INTEGER AS place
FROM scenarios WHERE score IS NOT NULL QUALIFY place <= 50""")
def top50_by_variant(t: Tables) -> DataFrame:
    """The fifty best cells of each scenario (a report): ranked in pieces first, so that no task sorts a whole scenario."""
    pieces = Window.partitionBy("variant", F.pmod("cell_id", F.lit(64))).orderBy(F.col("score").desc(), "cell_id")
    whole = Window.partitionBy("variant").orderBy(F.col("score").desc(), "cell_id")
    best = scenarios(t).where("score IS NOT NULL").withColumn("__p", F.row_number().over(pieces)).where("__p <= 50")
    return best.withColumn("place", F.row_number().over(whole)).where("place <= 50").select("variant", "cell_id", F.round("score", 9).alias("score"), "place")
