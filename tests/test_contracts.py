"""Locks, gates, receipts, outcome rules, sinks and serving helpers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from geotally.functions import scalars
from geotally.operators import merging
from geotally.plans import serving
from geotally.sources import readers, writers


def test_lock_and_gates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "variant string, x int")
    rows, manifest = merging.lock(df, "variant", ["a", "c"], "r1")
    assert rows.count() == 3 and manifest.first().n_rows == 3 and manifest.first().variants == "a,c"
    with pytest.raises(merging.GateError):
        merging.lock(df, "variant", ["a", "z"], "r1")
    assert merging.same_values(df, "variant", ["a", "b", "c"]).first().holds and not merging.same_values(df, "variant", ["a", "b"]).first().holds and not merging.same_values(df, "variant", ["a", "b", "c", "d"]).first().holds
    records = spark.createDataFrame([(1, 1, None), (2, None, None), (3, 1, "x")], "k int, a int, b string")
    assert {r.k: r.n_values for r in merging.one_value_set(records, ["a", "b"]).collect()} == {1: 1, 2: 0, 3: 2}


def test_only_open_receipts_are_served(spark):
    good = ("r1", "INTERNAL_SIMULATION_ONLY", "NO_TRUSTED_RESULT", "PROHIBITED", False, None)
    rows = [good, ("r2", *good[1:4], True, False), ("r3", "PUBLIC", *good[2:]), ("r4", *good[1:3], "ALLOWED", False, False), ("r5", *good[1:4], False, True)]
    receipts = spark.createDataFrame(rows, "run_id string, use_state string, evidence_state string, operational_use string, public_release_ready boolean, operational_use_ready boolean")
    maps = spark.createDataFrame([(f"r{i}", c) for i in range(1, 6) for c in (1, 2)], "run_id string, cell_id int")
    assert {(r.run_id, r.cell_id) for r in merging.served(receipts, maps, maps.withColumn("mass", F.lit(1.0)), ["run_id", "cell_id"]).collect()} == {("r1", 1), ("r1", 2)}


COLUMNS = ["通報時間", "類型", "地點", "狀態", "說明", "照片網址", "緯度", "經度"]


def test_outcome_rules(spark, tmp_path):
    good = {"通報時間": "2026-01-02 03:04", "類型": readers.OUTCOME, "地點": "臺北市大安區", "狀態": readers.APPROVED[0], "說明": 'says "x"', "照片網址": "", "緯度": "25.03", "經度": "121.56"}
    bad = [{"類型": "其他"}, {"狀態": "處理中"}, {"地點": "新北市"}, {"緯度": "north"}, {"經度": ""}, {"通報時間": "2026/01/02"}]
    rows = [good, good | {"狀態": readers.APPROVED[1]}, good, *[good | b for b in bad]]
    path = tmp_path / "o.csv"
    path.write_text("﻿" + ",".join(COLUMNS) + "\n" + "\n".join(",".join('"' + r[c].replace('"', '""') + '"' for c in COLUMNS) for r in rows), encoding="utf-8")
    found = readers.approved_outcomes(spark.read.option("header", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in COLUMNS)).csv(str(path)).na.fill("")).collect()
    want = {hashlib.sha256(json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for r in rows[:2]}
    assert {r.report_id for r in found} == want and len(found) == 2 and found[0].lat == 25.03
    assert str(found[0].reported_at) == "2026-01-02 03:04:00"


def test_canonical_json(spark):
    df = spark.createDataFrame([(2, "é\"\\", None, True)], "n int, s string, z string, b boolean")
    made = df.select(scalars.canonical_json(z=F.col("z"), s=F.col("s"), b=F.col("b"), n=F.col("n")).alias("j")).first().j
    assert made == json.dumps({"n": 2, "s": "é\"\\", "z": None, "b": True}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    flags = spark.createDataFrame([(9.0, 10.0), (8.9, 10.0), (11.0, 10.0), (11.1, 10.0), (1.0, 0.0), (None, 1.0)], "r double, m double")
    assert [x.f for x in flags.select(scalars.length_mismatch(F.col("r"), F.col("m")).alias("f")).collect()] == [False, True, False, True, None, None]


def test_stages_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01", 1, ["a"]), ("2026-01-01", 2, ["b", "c"])], "day string, k long, flags array<string>")
    stage = readers.empty_stage(df)
    assert stage.schema == df.schema and stage.count() == 0
    writers.snapshot(df, str(tmp_path / "s"), "day", required=["k"], lists=["flags"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    for bad in ([("d", None, ["a"])], [("d", 1, None)], [("d", 1, ["a", None])]):
        with pytest.raises(Exception, match="required|without nulls"):
            writers.snapshot(spark.createDataFrame(bad, df.schema), str(tmp_path / "t"), "day", required=["k"], lists=["flags"])
    writers.manifest(df, str(tmp_path / "m"), "k", source="test")
    one = spark.read.json(str(tmp_path / "m")).first()
    leaf = hashlib.sha256("\n".join(json.dumps({"day": r.day, "flags": r.flags, "k": r.k}, separators=(",", ":")) for r in df.collect()).encode()).hexdigest()
    for _ in range(5):
        leaf = hashlib.sha256(leaf.encode()).hexdigest()
    assert (one.n_rows, one.source, one.rows_sha256) == (2, "test", leaf)
    writers.csv(df.select("day", "k"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == [("2026-01-01", "1"), ("2026-01-01", "2")]


def test_bootstrap_and_release(spark):
    cells = spark.range(3)
    assert serving.bootstrap(cells, "r1")["ready"] and not serving.bootstrap(cells.where("false"), "r1")["ready"]
    manifests = spark.createDataFrame([("r1", "FROZEN"), ("r2", "DRAFT")], "release string, state string")
    assert serving.current_release(manifests)["release"] == "r1" and serving.current_release(manifests.where("state = 'DRAFT'")) is None
    with pytest.raises(ValueError, match="more than one"):
        serving.current_release(manifests.withColumn("state", F.lit("FROZEN")))


def test_readers_that_check(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,road\n63000010,x\n63000020,y\n", encoding="utf-8")
    found = readers.address_points(spark, str(tmp_path / "a.csv"), ["code", "road"], "code", ["63000010"])
    assert [r.road for r in found.collect()] == ["x"]
    with pytest.raises(ValueError, match="expected columns"):
        readers.address_points(spark, str(tmp_path / "a.csv"), ["code", "street"], "code", [])
    (tmp_path / "p.json").write_text(json.dumps([{"k": 1, "ok": "true", "state": "A"}, {"k": 2, "ok": False, "state": "B"}, {"k": 3, "ok": None, "state": "A"}]))
    rows = readers.preview(spark, str(tmp_path / "p.json"), "k int, ok string, state string", ["ok"], "state", ["A", "B"])
    assert {r.k: r.ok for r in rows.collect()} == {1: True, 2: False, 3: None}
    for flags, states in ((["state"], ["A", "B"]), (["ok"], ["A"])):
        with pytest.raises(Exception, match="no boolean|unknown value"):
            readers.preview(spark, str(tmp_path / "p.json"), "k int, ok string, state string", flags, "state", states).collect()


def test_covering_of_a_box(spark):
    """Against every cell that a dense grid of points falls into."""
    import numpy as np

    from geotally.functions import spatial

    box = (121.5, 25.0, 121.56, 25.05)
    found = {r.s2_cell for r in spatial.s2_covering(spark, box, 13).collect()}
    lon, lat = (x.ravel() for x in np.meshgrid(np.linspace(box[0], box[2], 300), np.linspace(box[1], box[3], 300)))
    inside = set(spatial._s2_ids(lon, lat, 13).tolist())
    assert inside <= found and len(found) < 2 * len(inside) + 20


def test_numbered_rows(spark):
    from geotally.operators.ranking import numbered

    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k int, v string")
    assert [(r.row, r.k) for r in numbered(df, ["k"], first=2, ranges=5).orderBy("k").collect()] == [(k + 2, k) for k in range(101)]
    assert numbered(df.where("false"), ["k"]).collect() == []


def test_creation_states(spark):
    from geotally.operators.merging import creation_states

    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", None, 4), ("b", None, 5), (None, "z", 6), (None, "z", 7), ("c", "q", 8), ("c", "r", 9)]
    df = spark.createDataFrame(rows, "k string, d string, at int")
    want = {1: "CREATED", 2: "REPLAYED", 3: "CONFLICT", 4: "CREATED", 5: "REPLAYED", 6: "CREATED", 7: "CREATED", 8: "CREATED", 9: "CONFLICT"}
    assert {r["at"]: r.state for r in creation_states(df, "k", "d", "at").collect()} == want
    stored = spark.createDataFrame([("a", "x"), ("c", "r")], "k string, d string")
    found = {r["at"]: r.state for r in creation_states(df, "k", "d", "at", stored).collect()}
    assert found == want | {1: "REPLAYED", 8: "CONFLICT", 9: "REPLAYED"}
    assert creation_states(df.where("false"), "k", "d", "at").collect() == []


def test_approximate_quantiles_are_near(spark):
    """The rank of each answer is within the sketch's bound."""
    from pyspark.sql import functions as F

    from geotally import catalog

    sf = "/root/testdata/sf0.01"
    found = {r.year: (r.quantiles, r.n) for r in catalog.QUERIES["approximate_quantiles"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.year("l_shipdate").alias("y"), "l_extendedprice").collect()
    for year, (values, n) in found.items():
        own = sorted(r.l_extendedprice for r in rows if r.y == year)
        assert len(own) == n
        for q, v in zip((0.5, 0.99), values, strict=True):
            low, high = sum(x < v for x in own), sum(x <= v for x in own)
            assert low - n / 10_000 - 1 <= q * n <= high + n / 10_000 + 1


def test_public_fingerprint(spark):
    """Published values, and all classes of length against a plain version."""
    from pyspark.sql import functions as F

    from geotally.functions.fingerprint import farm_fingerprint, fingerprints

    known = {"1footrue": -1541654101129638711, "2applefalse": 2794438866806483259, "3true": -4880158226897771312, "test": 8581389452482819506, "test" * 8: -4196240717365766262, "test" * 64: 3500507768004279527}
    df = spark.createDataFrame([(k,) for k in known] + [(None,)], "t string")
    assert {r.t: r.f for r in df.select("t", farm_fingerprint(F.col("t")).alias("f")).collect()} == known | {None: None}
    texts = [bytes((i * 37 + k) % 251 for k in range(i)) for i in range(200)]
    together = fingerprints(texts).tolist()
    assert together == [fingerprints([t])[0] for t in texts] and len(set(together)) == 200


def test_release_pages(spark):
    from geotally.plans.serving import encode_token, released_page

    cells = spark.createDataFrame([(r, i, 121.5 + i / 1000, 25.05) for r in ("a", "b") for i in range(1, 40)], "release string, point_id int, lon double, lat double")
    page = released_page(cells, "a", "121.51,25,121.53,25.1", encode_token(12), 5).collect()
    assert [(r.release, r.point_id) for r in page] == [("a", i) for i in range(13, 19)]
    assert released_page(cells, "none", "121.51,25,121.53,25.1", None).collect() == []


def test_binary_forms(spark):
    """Known bytes of the public form; zero is never negative; null stays null."""
    from pyspark.sql import functions as F

    from geotally.functions import wkb

    ring = "array<struct<x:double,y:double>>"
    line = [(0.0, 0.0), (1.0, 2.0)]
    polygon = [[(0.0, -0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(1.0, 2.0, line, polygon, [polygon]), (None, 1.0, None, None, None)], f"x double, y double, l {ring}, p array<{ring}>, m array<array<{ring}>>")
    got, none = df.select(*[F.hex(c).alias(n) for n, c in (("x", wkb.point_wkb("x", "y")), ("l", wkb.line_wkb("l")), ("p", wkb.polygon_wkb("p")), ("m", wkb.multipolygon_wkb("m")))]).collect()
    one, two, zero = "000000000000F03F", "0000000000000040", "0000000000000000"
    assert got.x == "0101000000" + one + two
    assert got.l == "010200000002000000" + zero + zero + one + two
    rings = "04000000" + zero + zero + one + zero + zero + one + zero + zero
    assert got.p == "010300000001000000" + rings and got.m == "010600000001000000" + got.p
    assert tuple(none) == (None, None, None, None)


def test_a_changed_input_changes_its_part_and_the_run(spark, tmp_path):
    import shutil

    from geotally import catalog

    sf = "/root/testdata/sf0.001"
    for t in ("supplier", "lineitem", "orders"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    before = catalog.QUERIES["run_identity_hashes"](spark, sf).first().asDict()
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.selectExpr("* EXCEPT (o_orderstatus)", "CASE WHEN o_orderkey = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus").write.mode("overwrite").parquet(str(tmp_path / "changed"))
    shutil.rmtree(tmp_path / "orders.parquet", ignore_errors=True)
    (tmp_path / "orders.parquet").unlink(missing_ok=True)
    shutil.move(str(tmp_path / "changed"), str(tmp_path / "orders.parquet"))
    after = catalog.QUERIES["run_identity_hashes"](spark, str(tmp_path)).first().asDict()
    changed = {k for k in before if before[k] != after[k]}
    assert {"source", "inputs", "run_id"} <= changed <= {"source", "inputs", "run_id", "parent"}
