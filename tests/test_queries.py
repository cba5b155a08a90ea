"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from geotally import catalog, lineage

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


#: Columns that only outcomes have: structural queries count events, they read no event's value or time.
OUTCOMES = {("events", "value"), ("events", "ts")}


def structural():
    import importlib
    import inspect

    names = []
    for module in ("layers", "network", "pipes", "geometry", "spatial"):
        m = importlib.import_module(f"geotally.plans.{module}")
        names += [n for n, f in inspect.getmembers(m, inspect.isfunction) if n in catalog.QUERIES and f.__module__ == m.__name__]
    return sorted(names)


STRUCTURAL = set(structural())


def run(spark, name):
    """The query's result; what its plan's scans read, behind checkpoints too, must be no outcome if it is structural."""
    with lineage.tracked():
        found = catalog.QUERIES[name](spark, SF)
        assert name not in STRUCTURAL or not lineage.reads(found) & OUTCOMES
    return found


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, con, name):
    want = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in want.description]
    columns = sorted(names)
    rows = want.fetchall()
    found = run(spark, name)
    assert sorted(found.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql(spark, name):
    assert run(spark, name).count() > 0


def test_lineage_sees_an_outcome(spark):
    """A query that reads outcomes is caught, behind a checkpoint as well; tables joined in are all listed."""
    from geotally.plans.base import Tables
    from geotally.storage import cut

    t = Tables(spark, SF)
    with lineage.tracked():
        early = cut(t.events.groupBy("user_id").agg({"value": "sum"}))
        late = cut(early.join(t.customer.selectExpr("c_custkey AS user_id", "c_nationkey"), "user_id"))
        assert lineage.reads(late) == {("events", "user_id"), ("events", "value"), ("customer", "c_custkey"), ("customer", "c_nationkey")}
        assert lineage.reads(catalog.QUERIES["capture_lift"](spark, SF)) >= {("events", "event_type"), ("events", "event_id")}
        assert lineage.reads(t.events.select("user_id")) == {("events", "user_id")}
