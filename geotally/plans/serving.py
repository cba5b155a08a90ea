"""Serving: gated pages, look-ups, summaries and client computations as functions of tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions.spatial import box_overlaps, parse_box
from geotally.plans.base import SQL_FEATURES, SQL_SELECTED, Tables
from geotally.plans.layers import selected_layers
from geotally.plans.registry import query

DEFAULT_LIMIT, MOST = 500, 1500


def clamp(limit: int | None) -> int:
    return min(limit or DEFAULT_LIMIT, MOST)


def encode_token(after: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"after": str(after)}).encode()).decode()


def decode_token(token: str) -> int:
    return int(json.loads(base64.urlsafe_b64decode(token))["after"])


def page(df: DataFrame, key: str, limit: int | None = None, token: str | None = None) -> tuple[list, str | None]:
    """Rows of a page in key order, and the token of the next one (or none)."""
    n = clamp(limit)
    rows = (df.where(F.col(key) > decode_token(token)) if token else df).orderBy(key).limit(n + 1).collect()
    return rows[:n], encode_token(rows[n - 1][key]) if len(rows) > n else None


def capabilities() -> dict:
    """What the engine serves, as a constant."""
    return {"ranking": "SUPPORTED", "network_walk": "SUPPORTED", "probability": "NOT_SUPPORTED", "daily_series": "NOT_SUPPORTED"}


def readable(df: DataFrame) -> bool:
    """Whether a table can be read and has a row."""
    return not df.limit(1).isEmpty()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 501")
def keyset_page(t: Tables) -> DataFrame:
    """A page (a report): the keys after the token, one more than the page to know of a next one."""
    return t.customer.where("c_custkey > 100").orderBy("c_custkey").limit(clamp(None) + 1).select("c_custkey", "c_name", "c_acctbal")


BOX = "121.5,25.02,121.6,25.1"
SQL_BOXES = "boxes AS (SELECT o_orderkey AS point_id, 121.45 + (o_orderkey * 7919 % 20000) / 1e5 AS lon, 25.0 + (o_orderkey * 104729 % 20000) / 1e5 AS lat FROM orders)"


@query(f"WITH {SQL_BOXES} SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM boxes WHERE lon - 0.001 <= 121.6 AND lon + 0.001 >= 121.5 AND lat - 0.001 <= 25.1 AND lat + 0.001 >= 25.02")
def bbox_filter(t: Tables) -> DataFrame:
    """Cells whose box meets the asked one (west, south, east, north)."""
    lon, lat = F.col("lon"), F.col("lat")
    return t.points().where(box_overlaps(lon - 0.001, lat - 0.001, lon + 0.001, lat + 0.001, parse_box(BOX))).select("point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"WITH {SQL_BOXES} SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM boxes WHERE point_id > 1000 AND lon - 0.001 <= 121.6 AND lon + 0.001 >= 121.5 AND lat - 0.001 <= 25.1 AND lat + 0.001 >= 25.02 ORDER BY point_id LIMIT 501")
def bbox_page(t: Tables) -> DataFrame:
    """A page of the cells in a box (a report): after a token's key, in key order, one more than the page."""
    token = encode_token(1000)
    return bbox_filter(t).where(F.col("point_id") > decode_token(token)).orderBy("point_id").limit(clamp(None) + 1)


RELEASE = "r1"


def released_page(cells: DataFrame, release: str, box: str, token: str | None, limit: int | None = None) -> DataFrame:
    """A page of one release's cells (``release``, ``point_id``, ``lon``, ``lat``) in a box, after a token's key, one more than the
    page to know of a next one; a release that the table lacks has none."""
    lon, lat = F.col("lon"), F.col("lat")
    own = cells.where((F.col("release") == release) & box_overlaps(lon - 0.001, lat - 0.001, lon + 0.001, lat + 0.001, parse_box(box)))
    after = own.where(F.col("point_id") > decode_token(token)) if token else own
    return after.orderBy("point_id").limit(clamp(limit) + 1)


@query(f"WITH {SQL_BOXES} SELECT 'r1' AS release, point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM boxes JOIN orders ON o_orderkey = point_id WHERE o_orderstatus = 'F' AND point_id > 1000 AND lon - 0.001 <= 121.6 AND lon + 0.001 >= 121.5 AND lat - 0.001 <= 25.1 AND lat + 0.001 >= 25.02 ORDER BY point_id LIMIT 501")
def release_bbox_page(t: Tables) -> DataFrame:
    """A page (a report) of the cells of one release of several in a box, after a token's key."""
    releases = t.orders.select(F.col("o_orderkey").alias("point_id"), F.when(F.col("o_orderstatus") == "F", RELEASE).when(F.col("o_orderstatus") == "O", "r2").otherwise("r0").alias("release"))
    cells = t.points().select("point_id", "lon", "lat").join(releases, "point_id")
    return released_page(cells, RELEASE, BOX, encode_token(1000)).select("release", "point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def bootstrap(cells: DataFrame, release: str) -> dict:
    """What a map begins with: its release and whether cells can be read, limits and capabilities."""
    return {"release": release, "ready": readable(cells), "default_limit": DEFAULT_LIMIT, "max_limit": MOST, "capabilities": capabilities()}


def current_release(manifests: DataFrame) -> dict | None:
    """The one frozen release, or none; more than one is an error."""
    rows = manifests.where("state = 'FROZEN'").limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one release is frozen")
    return rows[0].asDict() if rows else None


@query("SELECT * FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def point_lookup(t: Tables) -> DataFrame:
    """One row by its key, the last one's."""
    last = t.customer.agg(F.max("c_custkey").alias("c_custkey"))
    return t.customer.join(F.broadcast(last), "c_custkey", "left_semi")


@query(f"WITH {SQL_SELECTED} SELECT variant, count(*)::BIGINT AS n, round(max(score), 9) AS top_score, string_agg(cell_id::VARCHAR, ',' ORDER BY area DESC, cell_id) FILTER (WHERE k <= 5) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY variant, selected ORDER BY area DESC, cell_id) AS k FROM chosen) WHERE selected GROUP BY variant")
def nested_summary(t: Tables) -> DataFrame:
    """Per layer a summary with its five largest selected cells in order (a report)."""
    chosen = selected_layers(t).where("selected")
    pieces = Window.partitionBy("variant", F.pmod("cell_id", F.lit(32))).orderBy(F.col("area").desc(), "cell_id")
    few = chosen.withColumn("k", F.row_number().over(pieces)).where("k <= 5")
    best = few.groupBy("variant").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), "cell_id"))), 1, 5).alias("top"))
    sums = chosen.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.max("score"), 9).alias("top_score"))
    return sums.join(best, "variant").select("variant", "n", "top_score", F.array_join(F.transform("top", lambda x: x["cell_id"].cast("string")), ",").alias("largest"))


@query(f"WITH {SQL_FEATURES} SELECT nation_id, count(*) AS n_cells, count(partial) AS n_scored, arg_max(cell_id, dense * 1e9 - cell_id) AS densest, round(45 + least(1, greatest(0, avg(coalesce(partial, 0)))) * 455, 6) AS capacity FROM cell_features GROUP BY nation_id")
def district_statistics(t: Tables) -> DataFrame:
    """Coverage by district, its densest cell, and the capacity that clients show."""
    f = t.cell_features()
    mean = F.avg(F.coalesce("partial", F.lit(0.0)))
    return f.groupBy("nation_id").agg(
        F.count("*").alias("n_cells"), F.count("partial").alias("n_scored"), F.max_by("cell_id", F.col("dense") * 1e9 - F.col("cell_id")).alias("densest"),
        F.round(45 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)) * 455, 6).alias("capacity"),
    )


@query("SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS vintage FROM events WHERE event_type = 'purchase'")
def vintage_history(t: Tables) -> DataFrame:
    """History of each cell in the order of issue."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value", F.row_number().over(own).alias("vintage"))


WEEKS = 26
_KEEP = "0.6 * (CASE WHEN {w} % 4 = 1 THEN 0.2 ELSE 0 END) + 0.4 * (CASE WHEN {w} % 4 = 2 THEN 0.2 ELSE 0 END)"


def _sql_growth() -> str:
    x = "n0"
    steps = []
    for w in range(1, WEEKS + 1):
        steps.append(f"s{w} AS (SELECT cell_id, k, greatest(0, n + 0.12 * n * (1 - n / k) - n * ({_KEEP.format(w=w)}) + 0.5) AS n FROM s{w - 1})")
    return f"WITH {SQL_FEATURES}, s0 AS (SELECT cell_id, 45 + coalesce(partial, 0) * 455 AS k, (45 + coalesce(partial, 0) * 455) / 2 AS n FROM cell_features), {', '.join(steps)} SELECT cell_id, round(k, 6) AS capacity, round(n, 6) AS population FROM s{WEEKS}"


@query(_sql_growth())
def logistic_simulation(t: Tables) -> DataFrame:
    """A short recurrence over each cell's measured share: 26 steps of logistic growth with two fixed
    losses every fourth step and a constant gain.  It stands in for the clients' simulation, which
    is not rebuilt: no other steps, constants or delays of that are claimed."""
    k = F.col("k")

    def week(n, w):
        bait = F.when(w % 4 == 1, 0.6 * 0.2).when(w % 4 == 2, 0.4 * 0.2).otherwise(0.0)
        return F.greatest(F.lit(0.0), n + 0.12 * n * (1 - n / k) - n * bait + 0.5)

    cells = t.cell_features().select("cell_id", (45 + F.coalesce("partial", F.lit(0.0)) * 455).alias("k"))
    return cells.select("cell_id", F.round("k", 6).alias("capacity"), F.round(F.aggregate(F.sequence(F.lit(1), F.lit(WEEKS)), k / 2, week), 6).alias("population"))
