"""Files in pieces: digests, and one JSON array by many tasks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from geotally.sources import readers, streamed


def test_digests(spark, tmp_path):
    rng = random.Random(1)
    whole = {name: rng.randbytes(n) for name, n in (("a.bin", 0), ("b.bin", 1), ("c.bin", streamed.PIECE_BYTES), ("d.bin", 3 * streamed.PIECE_BYTES + 17))}
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in streamed.file_digests(spark, path).collect()}
        assert found == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in whole.items()}
    assert streamed.file_digests(spark, str(tmp_path / "b.bin")).count() == 1
    with pytest.raises(FileNotFoundError):
        streamed.file_digests(spark, str(tmp_path / "none"))


def test_a_file_beyond_a_row(spark, tmp_path):
    """More than 2 GB, sparse on the disk."""
    size = (2 << 30) + 5
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    for _ in range(2048):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    assert [(r.length, r.sha256) for r in streamed.file_digests(spark, str(tmp_path / "large")).collect()] == [(size, digest.hexdigest())]


def test_items_of_one_array_by_many_tasks(spark, tmp_path):
    """Braces, quotes and backslashes in strings, nested objects and arrays, letters of several bytes, at any cut."""
    rng = random.Random(2)
    odd = ['{"', "}]", "\\", '\\"', "木é", "[{", "a\nb", "", '"},{"']
    items = [{"id": i, "name": "".join(rng.choice(odd) for _ in range(rng.randrange(6))), "inner": {"list": [{"x": rng.randrange(9)} for _ in range(rng.randrange(3))]}} for i in range(300)]
    document = {"note": 'x}]{["\\', "result": {"count": len(items), "results": items, "more": {"a": [1, {"b": 2}]}}}
    for indent, name in ((None, "compact.json"), (2, "wide.json")):
        (tmp_path / name).write_text(json.dumps(document, ensure_ascii=name == "wide.json", indent=indent))
    schema = "id int, name string, inner struct<list:array<struct<x:int>>>"
    want = sorted((r["id"], r["name"], [x["x"] for x in r["inner"]["list"]]) for r in items)
    for size in (101, 4096, 1 << 20):
        for name in ("compact.json", "wide.json"):
            df = streamed.json_items(spark, str(tmp_path / name), schema, range_bytes=size) if size > 101 or name == "compact.json" else None
            if df is not None:
                assert sorted((r.id, r.name, [x.x for x in r.inner.list]) for r in df.collect()) == want
    whole = readers.json_envelope(spark, str(tmp_path / "compact.json"), "id:int,name:string")
    assert sorted((r.id, r.name) for r in whole.collect()) == [w[:2] for w in want]
    both = streamed.json_items(spark, str(tmp_path), "id int", range_bytes=5000)
    assert both.count() == 600 and both.agg(F.sum("id")).first()[0] == 2 * sum(range(300))
    tasks = streamed.json_items(spark, str(tmp_path / "compact.json"), "id int", range_bytes=5000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3


def test_pieces_end_anywhere(monkeypatch, tmp_path):
    """Reading in pieces of a few bytes gives the same items."""
    text = json.dumps([{"a": '\\"{'}, {"b": [{}, "]"]}, {"c": "é"}])
    (tmp_path / "x").write_text(text)
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(streamed, "PIECE_BYTES", size)
        assert [json.loads(x) for x in streamed._items(str(tmp_path / "x"), 0, len(text.encode()), 0, 0, 1)] == json.loads(text)
