"""The prefix trie of rebuilt conversations against brute force."""

import hashlib
import math
import random
import re
import zlib

from pyspark.sql import types as T

from geotally.llm import prefix_trie, registry

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def base_of(c):
    """The first of a block; remainders have the sign of the number, as in SQL."""
    return c - int(math.fmod(c, 20))


def brute(rows):
    stored = {}
    for c, turn, role, text in rows:
        if c is not None:
            stored.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in stored.items()}
    members = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(stored.get(base_of(c), [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole)))
    out = []
    for node, found in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c, n in found if n == len(node))
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        childless = lambda n: all(m == len(n) for _, m in members[n])
        out.append((
            min(found)[0], len(node), min(members[node[:-1]])[0] if node else None, len(found), sum(len(n) == len(node) + 1 for n in under), sum(map(childless, under)),
            sum((len(members[n]) - 1) * words(n) for n in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(rng):
    """Conversations with common beginnings, copies, nulls, ties, gaps in the ids, empty roles and texts."""
    rows = []
    for c in rng.sample(range(-30, 130), 60):
        for turn in range(rng.randint(0, 6)):
            t = rng.choice([turn, turn, turn, None, 0])
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "a  b", "", None, "c", "é 木 d"])))
    rows += [(c, turn, "user", "copy %d" % turn) for c in (201, 202, 203, 209, 215) for turn in range(4)]
    return rows + [(None, 1, "user", "nobody's"), rows[0]]


def test_nodes_equal_brute_force(spark):
    rng = random.Random(4)
    for _ in range(2):
        rows = made(rng)
        assert found(prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_collisions_are_seen_and_other_bases_taken(spark):
    rows = made(random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA)
    # Tiny moduli make different sequences collide; the next attempt is exact.
    assert found(prefix_trie.nodes(df, attempts=[(1, (5, 7)), (2, (11, 13)), (3, prefix_trie.MODULI)])) == brute(rows)


def test_one_long_conversation_in_many_tasks(spark):
    rows = [(40, i, "user", f"turn {i % 97}") for i in range(3000)] + [(c, i, "user", f"turn {i}") for c in (41, 47) for i in range(5)]
    assert found(prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute_of_long(rows)


def brute_of_long(rows):
    """As ``brute``, without comparing all pairs of nodes of one long chain."""
    stored = {}
    for c, turn, role, text in rows:
        stored.setdefault(c, []).append((turn, role, text))
    stored = {c: [x[1:] for x in sorted(v)] for c, v in stored.items()}
    members, total = {}, {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = stored.get(base_of(c), [])[:h] + own[h:]
        total[c] = len(whole)
        key = hashlib.sha256()
        members.setdefault((0, key.hexdigest()), []).append((c, 0, None))
        for d, turn in enumerate(whole, 1):
            before = (d - 1, key.hexdigest())
            key.update(str(turn).encode())
            members.setdefault((d, key.hexdigest()), []).append((c, len(turn[1].split()), before))
    leaves, saved, children = {}, {}, {}
    for node in sorted(members, reverse=True):
        found_ = members[node]
        d = node[0]
        leaves[node] = leaves.get(node, 0) + all(total[c] == d for c, _, _ in found_)
        saved[node] = saved.get(node, 0) + (len(found_) - 1) * found_[0][1]
        up = found_[0][2]
        if up is not None:
            leaves[up], saved[up], children[up] = leaves.get(up, 0) + leaves[node], saved.get(up, 0) + saved[node], children.get(up, 0) + 1
    out = []
    for node, f in members.items():
        ends = sorted(c for c, _, _ in f if total[c] == node[0])
        out.append((min(f)[0], node[0], min(members[f[0][2]])[0] if f[0][2] else None, len(f), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "x"), (2, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], T.StructType([*SCHEMA, T.StructField("depth", T.IntegerType()), T.StructField("part", T.IntegerType())]))
    assert found(prefix_trie.nodes(df)) == brute(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*SCHEMA.names).collect()]
    assert found(registry.QUERIES["op11_prefix_trie"](spark, SF)) == brute(rows)
