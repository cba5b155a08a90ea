"""Periodic runs: the grammar, the runs and the query against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from geotally.llm import registry
from geotally.llm.periodic import collapse_runs, find_runs
from geotally.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"


def brute_runs(w, periods=4, least=6):
    """Every maximal stretch of every period, the smallest period of each."""
    best = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def made_texts(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 10 and rng.random() < 0.3:
            w = (w[:7] * 6) + w[3:] + w[:2] * 9
        out.append(w)
    return out


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(250):
        texts = made_texts(rng)
        words, bounds = np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)])
        got = [tuple(map(int, r)) for r in zip(*find_runs(words, bounds), strict=True)]
        assert got == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_texts_that_begin_as_others_end():
    """Candidates across the border of two texts aren't runs, whichever texts have a grammar."""
    rng = random.Random(6)
    for _ in range(60):
        texts = [[rng.randrange(9) for _ in range(rng.choice([0, 3, 8, 30]))] for _ in range(rng.randint(20, 60))]
        texts[rng.randrange(len(texts))] = [1, 2] * 6
        words, bounds = np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)])
        got = [tuple(map(int, r)) for r in zip(*find_runs(words, bounds), strict=True)]
        assert got == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_extensions_equal_comparison_word_by_word():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 4):
        body = rng.integers(0, kinds, 300)
        row = np.concatenate([[10], body[:120], body[:90], [11], body, [12]])
        grammar = Grammar(row, 10)
        x = rng.integers(1, len(row) - 2, 400)
        y = np.minimum(x + rng.integers(1, 60, 400), len(row) - 1)
        ahead, back = grammar.extend(x, y, grammar.ahead), grammar.extend(x, y, grammar.back)
        for a, b, f, r in zip(x, y, ahead, back, strict=True):
            if a == b:
                continue
            n = next(n for n in range(len(row)) if b + n >= len(row) or row[a + n] != row[b + n])
            m = next(m for m in range(len(row)) if row[a - m] != row[b - m])
            assert (f, r) == (n, m)


def test_one_word_many_times_and_long_texts():
    n = 60_000
    assert [int(x[0]) for x in find_runs(np.zeros(n, np.int64), np.array([0, n]))] == [0, 0, n, 1]
    w = np.random.default_rng(1).integers(0, 5000, n)[np.arange(n) % (n // 7)]
    assert [int(x[0]) for x in find_runs(w, np.array([0, n]))] == [0, 0, n, n // 7]
    with pytest.raises(ValueError):
        find_runs(w, np.array([0, n]), periods=3)


def collapsed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows_of_all_kinds(spark):
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x y x y x y x y", "x y x y x y x", "é é é é é é 木 木", "b\n" * 50 + "c d " * 40, "the  end\x0bof it", "a b a b a b a b a b a b"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("row", T.IntegerType())])
    rows = [(i if i != 3 else None, t, "old", 7) for i, t in enumerate(texts)] + [(5, texts[5], "old", 7)]
    got = collapse_runs(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "row", "n_words", "runs", "collapsed_sha256"]
    found = got.collect()
    assert len(found) == len(rows) and {r["row"] for r in found} == {7}
    by_id = {r["doc_id"]: r for r in found}
    for i, t in [(r[0], r[1]) for r in rows]:
        runs, left = collapsed(t)
        r = by_id[i]
        assert [tuple(x) for x in r["runs"]] == runs and r["text"] == left
        assert r["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()
    assert collapse_runs(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for i, text in docs.items():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs, left = collapsed(" ".join(words))
        r = got[i]
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        some += bool(runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()
    assert some >= 10
