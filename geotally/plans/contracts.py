"""Contracts of published results: outcomes, locks, receipts, gates, canonical texts and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.functions import scalars
from geotally.operators.merging import creation_states, first_of_each, lock, one_value_set, served
from geotally.operators.ranking import numbered, running
from geotally.plans.base import SQL_SELECTED, Tables
from geotally.plans.layers import SQL_SCENARIOS, scenarios, selected_layers
from geotally.plans.network import SCENARIOS, SQL_DIRECTED, SQL_IDENTITY, SQL_WALK, SQL_WEIGHTED, all_links, both_ways, cell_links, matrix_table, network_cells, run_identity, scenario_table, seeds, walk
from geotally.plans.registry import query
from geotally.sources.readers import APPROVED, CITY, OUTCOME, approved_outcomes
from geotally.storage import cut, written

# --- outcomes -----------------------------------------------------------------------------------

SQL_RAW = f"""raw AS (SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN '{OUTCOME}' ELSE '其他' END AS kind, CASE event_id % 4 WHEN 0 THEN '{APPROVED[0]}' WHEN 1 THEN '{APPROVED[1]}' ELSE '處理中' END AS status,
  CASE WHEN event_id % 5 = 0 THEN '新北市' ELSE '{CITY}' END || user_id || '號' AS place, CASE WHEN event_id % 11 = 0 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS reported,
  CASE WHEN event_id % 13 = 0 THEN 'unknown' ELSE (25 + user_id / 1000)::DECIMAL(8,3)::VARCHAR END AS lat, (121 + user_id / 1000)::DECIMAL(8,3)::VARCHAR AS lon FROM events)"""


def raw_outcomes(t: Tables) -> DataFrame:
    """Rows of an outcome file as text, some of which the rules leave out."""
    e = F.col("event_id")
    degrees = lambda base: (base + F.col("user_id") / 1000).cast("decimal(8,3)").cast("string")
    return t.events.select(
        F.when(F.col("event_type").isin("error", "click"), OUTCOME).otherwise("其他").alias("類型"), F.when(e % 4 == 0, APPROVED[0]).when(e % 4 == 1, APPROVED[1]).otherwise("處理中").alias("狀態"),
        F.concat(F.when(e % 5 == 0, "新北市").otherwise(CITY), F.col("user_id").cast("string"), F.lit("號")).alias("地點"),
        F.when(e % 11 == 0, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("通報時間"),
        F.when(e % 13 == 0, "unknown").otherwise(degrees(25)).alias("緯度"), degrees(121).alias("經度"), e.cast("string").alias("說明"),
    )


@query(f"""WITH {SQL_RAW} SELECT sha256('{{"地點":"' || place || '","狀態":"' || status || '","經度":"' || lon || '","緯度":"' || lat || '","說明":"' || event_id || '","通報時間":"' || reported || '","類型":"' || kind || '"}}') AS report_id,
 lat::DOUBLE AS lat, lon::DOUBLE AS lon, strptime(reported, '%Y-%m-%d %H:%M') AS reported_at FROM raw WHERE kind = '{OUTCOME}' AND status <> '處理中' AND event_id % 5 > 0 AND event_id % 11 > 0 AND event_id % 13 > 0""")
def outcome_reports(t: Tables) -> DataFrame:
    """Outcomes that the rules admit, each under the hash of its canonical text."""
    return approved_outcomes(raw_outcomes(t))


# --- gates and keys -----------------------------------------------------------------------------

@query("""SELECT 'finished' AS source, 'F' AS snapshot, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderstatus = 'F' HAVING count(DISTINCT o_orderstatus) = 1
UNION ALL SELECT 'all', min(o_orderstatus), count(*), sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders HAVING count(DISTINCT o_orderstatus) = 1""")
def single_snapshot_gate(t: Tables) -> DataFrame:
    """Totals of a source, only if it is of a single snapshot: one that mixes them has no row."""

    def total(df: DataFrame, name: str) -> DataFrame:
        sums = df.agg(F.countDistinct("o_orderstatus").alias("k"), F.min("o_orderstatus").alias("snapshot"), F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
        return sums.where("k = 1").select(F.lit(name).alias("source"), "snapshot", "n", "total")

    return total(t.orders.where("o_orderstatus = 'F'"), "finished").unionByName(total(t.orders, "all"))


@query(f"""WITH {SQL_SELECTED}, placed AS (SELECT variant, cell_id, score, row_number() OVER (PARTITION BY variant ORDER BY score DESC, cell_id) AS place, count(*) OVER (PARTITION BY variant) AS n FROM scored WHERE score IS NOT NULL)
SELECT variant, cell_id, round(score, 9) AS score, place::BIGINT AS place FROM placed WHERE place <= greatest(1, round(n * 0.10))""")
def top_fraction(t: Tables) -> DataFrame:
    """The best tenth of each layer's scored cells (rounded, one at least), ties by cell."""
    scored = selected_layers(t).where("score IS NOT NULL").select("variant", "cell_id", "score").withColumn("one", F.lit(1).cast("long"))
    placed = running(scored, ["variant"], "score", "cell_id", "one", name="place")
    sizes = scored.groupBy(F.col("variant").alias("v")).agg(F.greatest(F.lit(1), F.round(F.count("*") * 0.10)).alias("most"))
    return placed.join(F.broadcast(sizes), F.col("variant") == F.col("v")).where(F.col("place") <= F.col("most")).select("variant", "cell_id", F.round("score", 9).alias("score"), "place")  # a row a layer


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, printf('%02d', l_linenumber) AS padded, '{"order":' || l_orderkey || ',"line":' || l_linenumber || ',"flag":"' || l_returnflag || '"}' AS source_key,
 sha256('{"flag":"' || l_returnflag || '","line":' || l_linenumber || ',"order":' || l_orderkey || '}') AS row_sha256 FROM lineitem""")
def composite_keys(t: Tables) -> DataFrame:
    """Padded numbers, a composite key as JSON, and the hash of a row's canonical JSON."""
    fields = {"order": F.col("l_orderkey"), "line": F.col("l_linenumber"), "flag": F.col("l_returnflag")}
    key = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.format_string("%02d", "l_linenumber").alias("padded"), key.alias("source_key"), scalars.json_digest(**fields).alias("row_sha256"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS reported, sum(l_linenumber * 10)::DOUBLE AS measured FROM lineitem GROUP BY 1)
SELECT l_orderkey, reported, measured, CASE WHEN reported IS NOT NULL AND measured > 0 THEN reported / measured < 0.9 OR reported / measured > 1.1 END AS mismatch FROM l""")
def length_ratio_flags(t: Tables) -> DataFrame:
    """Reported lengths against measured ones: a ratio outside 0.9 to 1.1 is flagged."""
    sums = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("reported"), F.sum(F.col("l_linenumber") * 10).cast("double").alias("measured"))
    return sums.withColumn("mismatch", scalars.length_mismatch(F.col("reported"), F.col("measured")))


# --- states of cells -----------------------------------------------------------------------------

# The support states of a cell in the order of their precedence.
SUPPORT = ("SELF_ONLY", "GENERIC_ADJACENCY_ONLY", "SEWER_ATTRIBUTE_MISSING", "NO_ELIGIBLE_SEWER_NEIGHBOR", "METRIC_SEWER_SUPPORTED")
SQL_BUCKETS = f"buckets(scenario, generic_bucket) AS (VALUES {', '.join(f'({s!r}, {b}::DOUBLE)' for s, _, b, _ in SCENARIOS)})"


@query(f"""WITH {SQL_DIRECTED}, {SQL_BUCKETS} SELECT scenario, support.cell_id, CASE WHEN n_links = 0 AND (generic_bucket = 0 OR n_generic = 0) THEN '{SUPPORT[0]}' WHEN generic_bucket > 0 AND n_links = 0 AND n_generic > 0 THEN '{SUPPORT[1]}'
  WHEN m.attribute IS NULL THEN '{SUPPORT[2]}' WHEN n_links = 0 THEN '{SUPPORT[3]}' ELSE '{SUPPORT[4]}' END AS support_state FROM support CROSS JOIN buckets LEFT JOIN metric_index m ON m.cell_id = support.cell_id""")
def cell_support_states(t: Tables) -> DataFrame:
    """Each cell's support in each scenario: the first of five states that holds."""
    from geotally.plans.layers import metric_index

    weighted = (F.col("link_class") == "weighted") & F.coalesce(F.col("eligible"), F.lit(False))
    counts = both_ways(cut(all_links(t))).groupBy(F.col("from_cell").alias("at")).agg(F.count_if(weighted).alias("n_links"), F.count_if(F.col("link_class") == "generic").alias("n_generic"))
    known = metric_index(t).where("attribute IS NOT NULL").select(F.col("cell_id").alias("known"))
    joined = network_cells(t).join(counts, F.col("at") == F.col("cell_id"), "left").join(known, F.col("known") == F.col("cell_id"), "left").crossJoin(F.broadcast(scenario_table(t)))  # three scenarios
    links, generic, open_ = F.coalesce("n_links", F.lit(0)), F.coalesce("n_generic", F.lit(0)), F.col("generic_bucket") > 0
    state = F.when((links == 0) & (~open_ | (generic == 0)), SUPPORT[0]).when(open_ & (links == 0) & (generic > 0), SUPPORT[1]).when(F.col("known").isNull(), SUPPORT[2]).when(links == 0, SUPPORT[3]).otherwise(SUPPORT[4])
    return joined.select("scenario", "cell_id", state.alias("support_state"))


# --- runs, receipts and locks -------------------------------------------------------------------

@query(f"WITH {SQL_WEIGHTED}, {SQL_IDENTITY} SELECT * FROM run")
def run_identity_hashes(t: Tables) -> DataFrame:
    """The identity of a run and the nine content hashes that it is made of."""
    return run_identity(t)


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS run_key, count(*) AS n_requests, count(*) - 1 AS n_replayed FROM orders GROUP BY 1, 2")
def idempotent_runs(t: Tables) -> DataFrame:
    """Requests with one key and digest are one run: the first is created, the others get it again."""
    return first_of_each(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey", name="run_key")


@query("""WITH first AS (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_orderpriority, o_orderkey) AS d FROM orders GROUP BY 1)
SELECT o_orderkey, k AS run_order, CASE WHEN o_orderkey = k THEN 'CREATED' WHEN o_orderpriority = d THEN 'REPLAYED' ELSE 'CONFLICT' END AS state FROM orders JOIN first USING (o_custkey)""")
def run_creation_states(t: Tables) -> DataFrame:
    """Requests for runs: created, answered with the run that is there, or refused for another digest under one key."""
    return creation_states(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_orderkey", "run_order", "state")


@query(f"""WITH {SQL_SCENARIOS} SELECT variant, cell_id, round(score, 9) AS score, selected, 'locked' AS release, (SELECT count(*) FROM scenarios WHERE variant IN ('composite', 'without_partial')) AS n_rows
FROM scenarios WHERE variant IN ('composite', 'without_partial')""")
def locked_scenarios(t: Tables) -> DataFrame:
    """Two of the seven scenarios, copied under a lock whose manifest counts them."""
    rows, manifest = lock(scenarios(t), "variant", ["composite", "without_partial"], "locked")
    return rows.join(F.broadcast(manifest.select("release", "n_rows")), "release").select("variant", "cell_id", F.round("score", 9).alias("score"), "selected", "release", "n_rows")  # one row


SQL_SERVED = f"""{SQL_WALK}, maps AS (SELECT s.scenario, s.step, s_suppkey AS cell_id, s_suppkey % 4 AS kind FROM supplier CROSS JOIN (SELECT DISTINCT scenario, step FROM walk) s)"""


@query(f"""WITH {SQL_SERVED} SELECT 'r1' AS run_id, maps.scenario, maps.step, maps.cell_id, kind, round(mass, 6) AS mass FROM maps JOIN walk ON walk.scenario = maps.scenario AND walk.step = maps.step AND walk.cell_id = maps.cell_id""")
def served_states(t: Tables) -> DataFrame:
    """States behind the serving gate: the receipt that is for internal use and not released, joined
    to its map and states on run, scenario, step and cell."""
    states = written(walk(t), "states").withColumn("run_id", F.lit("r1"))
    maps = t.supplier.select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 4).alias("kind")).crossJoin(F.broadcast(states.select("run_id", "scenario", "step").distinct()))  # a row a step
    flags = "struct<run_id:string,use_state:string,evidence_state:string,operational_use:string,public_release_ready:boolean,operational_use_ready:boolean>"
    made = [("r1", "INTERNAL_SIMULATION_ONLY", "NO_TRUSTED_RESULT", "PROHIBITED", False, False), ("r0", "PUBLIC", "NO_TRUSTED_RESULT", "PROHIBITED", True, False)]
    rows = F.array(*[F.struct(*map(F.lit, r)) for r in made]).cast(f"array<{flags}>")
    receipts = t.spark.range(1).select(F.inline(rows))
    return served(receipts, maps, states, ["run_id", "scenario", "step", "cell_id"]).select("run_id", "scenario", "step", "cell_id", "kind", F.round(F.col("mass").cast("double"), 6).alias("mass"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n_values FROM orders
WHERE CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END <> 1""")
def one_of_violations(t: Tables) -> DataFrame:
    """Typed records with no value, or with more than one."""
    k = F.col("o_orderkey")
    records = t.orders.select("o_orderkey", F.when(k % 3 == 0, k).alias("integer_value"), F.when(k % 5 == 0, F.col("o_totalprice")).alias("decimal_value"), F.when(k % 7 == 0, F.col("o_orderstatus")).alias("text_value"))
    counted = one_value_set(records, ["integer_value", "decimal_value", "text_value"])
    return counted.where("n_values <> 1").select("o_orderkey", "n_values")


@query(f"WITH {SQL_DIRECTED} SELECT count(*) AS n_links, count(*) FILTER (WHERE from_cell >= to_cell) AS n_turned, count(*) - count(DISTINCT (from_cell, to_cell)) AS n_repeats, count(*) FILTER (WHERE eligible AND weight IS NULL) AS n_unweighted, min(weight) >= 0.25 AND max(weight) <= 1 AS weights_in_range FROM cell_links")
def link_contract(t: Tables) -> DataFrame:
    """What clients may rely on: links are turned one way, unique, weighed where eligible."""
    links = cut(cell_links(t))
    keys = links.select("from_cell", "to_cell").distinct().agg(F.count("*").alias("k"))
    sums = links.agg(
        F.count("*").alias("n_links"), F.count_if(F.col("from_cell") >= F.col("to_cell")).alias("n_turned"), F.count_if(F.col("eligible") & F.col("weight").isNull()).alias("n_unweighted"),
        ((F.min("weight") >= 0.25) & (F.max("weight") <= 1)).alias("weights_in_range"),
    )
    return sums.crossJoin(keys).select("n_links", "n_turned", (F.col("n_links") - F.col("k")).alias("n_repeats"), "n_unweighted", "weights_in_range")  # one row


@query("""SELECT count(*) AS n_seeded, round(sum(share), 9) AS mass FROM (SELECT count(*) * (1000 + l_suppkey * 37 % 500)::DOUBLE / sum(count(*) * (1000 + l_suppkey * 37 % 500)::DOUBLE) OVER () AS share FROM lineitem GROUP BY l_suppkey)""")
def seed_mass(t: Tables) -> DataFrame:
    """Cells with a seed, and the whole mass of all seeds."""
    from geotally.functions import exact

    return seeds(t).agg(F.count_if(F.col("units") > 0).alias("n_seeded"), F.round(exact.as_decimal(F.sum("units")).cast("double"), 9).alias("mass"))


# --- audits of the walk -------------------------------------------------------------------------

@query(f"""WITH {SQL_WALK}, again AS (
  SELECT p.scenario, p.step + 1 AS step, m.to_cell AS cell_id, sum(0.75 * p.mass * m.share) AS moved FROM walk p JOIN matrix m ON m.scenario = p.scenario AND m.from_cell = p.cell_id WHERE p.step < 8 GROUP BY 1, 2, 3)
SELECT w.scenario, w.step, count(*) AS n_cells, round(max(abs(w.mass - 0.25 * seeds.seed - coalesce(moved, 0))), 9) AS residual FROM walk w JOIN seeds ON seeds.cell_id = w.cell_id
LEFT JOIN again a ON a.scenario = w.scenario AND a.step = w.step AND a.cell_id = w.cell_id WHERE w.step > 0 GROUP BY 1, 2""")
def recurrence_residuals(t: Tables) -> DataFrame:
    """Each step worked out again from the stored one before it: the largest difference."""
    from geotally.functions import exact
    from geotally.operators.links import by_scenario, restart_walk

    table, start = matrix_table(t), cut(seeds(t))
    units = by_scenario(table, scenario_table(t))
    states = cut(restart_walk(start, table, scenario_table(t), 8).withColumn("mass", F.col("mass").cast("double")))
    shares = units.select("scenario", "from_cell", "to_cell", exact.as_decimal(F.col("units")).cast("double").alias("share"))
    # A cell's masses of all steps are one row, so each share is met once and its eight products are summed side by side.
    masses, sums = [f"mass{k}" for k in range(8)], [f"moved{k}" for k in range(8)]
    before = states.where("step < 8").groupBy("scenario", F.col("cell_id").alias("from_cell")).agg(*[F.sum(F.when(F.col("step") == k, F.col("mass"))).alias(m) for k, m in enumerate(masses)])
    wide = before.join(shares, ["scenario", "from_cell"]).groupBy("scenario", F.col("to_cell").alias("cell_id")).agg(*[F.sum(0.75 * F.col(m) * F.col("share")).alias(s) for m, s in zip(masses, sums, strict=True)])
    moved = wide.select("scenario", "cell_id", F.inline(F.array(*[F.struct(F.lit(k + 1).alias("step"), F.col(s).alias("moved")) for k, s in enumerate(sums)])))
    back = start.select("cell_id", exact.as_decimal(F.col("units")).cast("double").alias("seed"))
    joined = states.where("step > 0").join(back, "cell_id", "left").join(moved, ["scenario", "step", "cell_id"], "left")
    gap = F.abs(F.col("mass") - 0.25 * F.coalesce("seed", F.lit(0.0)) - F.coalesce("moved", F.lit(0.0)))
    return joined.groupBy("scenario", "step").agg(F.count("*").alias("n_cells"), F.round(F.max(gap), 9).alias("residual"))


@query(f"""WITH {SQL_WALK}, own AS (SELECT scenario, from_cell, share FROM matrix WHERE from_cell = to_cell)
SELECT w.scenario, w.step, o.share > 0.99999 AS self_only, count(*) AS n_cells, round(sum(w.mass), 6) AS mass, round(sum(w.mass * o.share), 6) AS kept FROM walk w JOIN own o ON o.scenario = w.scenario AND o.from_cell = w.cell_id GROUP BY 1, 2, 3""")
def self_only_mass(t: Tables) -> DataFrame:
    """Mass at each step in cells that give nothing away and in the others, and what stays where it is."""
    from geotally.functions import exact
    from geotally.operators.links import by_scenario, restart_walk

    table = matrix_table(t)
    units = by_scenario(table, scenario_table(t))
    own = units.where("from_cell = to_cell").select("scenario", F.col("from_cell").alias("cell_id"), exact.as_decimal(F.col("units")).cast("double").alias("share"))
    states = restart_walk(seeds(t), table, scenario_table(t), 8).withColumn("mass", F.col("mass").cast("double"))
    groups = states.join(own, ["scenario", "cell_id"]).groupBy("scenario", "step", (F.col("share") > 0.99999).alias("self_only"))
    return groups.agg(F.count("*").alias("n_cells"), F.round(F.sum("mass"), 6).alias("mass"), F.round(F.sum(F.col("mass") * F.col("share")), 6).alias("kept"))


# --- small predicates, counts and samples -------------------------------------------------------

@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN sha1(o_orderkey::VARCHAR) WHEN 1 THEN sha256(o_orderkey::VARCHAR) WHEN 2 THEN upper(sha1(o_orderkey::VARCHAR)) ELSE sha1(o_orderkey::VARCHAR) || 'g' END AS digest FROM orders)
SELECT o_orderkey, digest, length(digest)::BIGINT AS n FROM d WHERE regexp_full_match(digest, '[0-9a-f]{40}|[0-9a-f]{64}')""")
def hex_digests(t: Tables) -> DataFrame:
    """Texts that are 40 or 64 lower-case hexadecimal digits and nothing else."""
    k, text = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    digest = F.when(k == 0, F.sha1(text)).when(k == 1, F.sha2(text, 256)).when(k == 2, F.upper(F.sha1(text))).otherwise(F.concat(F.sha1(text), F.lit("g")))
    made = t.orders.select("o_orderkey", digest.alias("digest"))
    return made.where(scalars.is_digest(F.col("digest"))).select("o_orderkey", "digest", F.length("digest").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, count(*) OVER w AS n, count(*) FILTER (WHERE l_returnflag = 'R') OVER w AS n_returned FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def partition_counts(t: Tables) -> DataFrame:
    """Each line with the counts of its order."""
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.count("*").over(own).alias("n"), F.count_if(F.col("l_returnflag") == "R").over(own).alias("n_returned"))


@query("""WITH first AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h, 121.45 + (o_orderkey * 7919 % 20000) / 1e5 AS lon, 25.0 + (o_orderkey * 104729 % 20000) / 1e5 AS lat FROM orders ORDER BY h, o_orderkey LIMIT 7500)
SELECT o_orderkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM first WHERE lon BETWEEN 121.5 AND 121.6 AND lat BETWEEN 25.02 AND 25.15 ORDER BY h, o_orderkey LIMIT 5000""")
def staged_sample(t: Tables) -> DataFrame:
    """A sample by hash in two stages (both limits are the operator): 7,500 rows, of these the ones in
    a box, of these 5,000."""
    h = F.md5(F.col("point_id").cast("string"))
    first = t.points().select("point_id", "lon", "lat").orderBy(h, "point_id").limit(7500)
    kept = first.where(F.col("lon").between(121.5, 121.6) & F.col("lat").between(25.02, 25.15))
    return kept.orderBy(h, "point_id").limit(5000).select(F.col("point_id").alias("o_orderkey"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS source_row FROM orders")
def source_rows(t: Tables) -> DataFrame:
    """Rows numbered from 2 in the order of their key, as a file with a header has them."""
    return numbered(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], first=2, name="source_row")
