"""Merkle fingerprints against a plain version."""

import hashlib
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotally.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def root(text):
    digests, sections, own = [sha("p:" + x) for x in text.split("\n")], [], []
    for i, d in enumerate(digests):
        own.append(d)
        if d < "2" or d == sha("p:") or i == len(digests) - 1:
            sections.append(sha("s:" + "".join(own)))
            own = []
    return sha("d:" + "".join(sections)), len(sections)


def likeness(a, b):
    a, b = ({p for p in re.findall(merkle.PIECE, x) if p} for x in (a, b))
    chars = lambda ps: sum(map(len, ps))
    return 1.0 if not a and not b else 2.0 * chars(a & b) / (chars(a) + chars(b))


def span(a, b):
    """Code points of a whose paragraphs differ from those of b."""
    if a == b:
        return None, None
    x, y = a.split("\n"), b.split("\n")
    f = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    r = 0
    while r < min(len(x), len(y)) - f and x[-1 - r] == y[-1 - r]:
        r += 1
    start = min(len(a), sum(len(p) + 1 for p in x[:f]))
    return start, max(start, len(a) - sum(len(p) + 1 for p in x[len(x) - r :]))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def expected(rows):
    """By descending id, ties by text; the first follows the last; no id: the text follows itself."""
    placed = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], (r[1] or "").encode()))
    out = []
    for r, after in [*zip(placed, placed[1:] + placed[:1]), *((r, r) for r in rows if r[0] is None)]:
        own, other = r[1] or "", after[1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        out.append((r[0], len(own), edited, root(own)[0], root(edited)[0], round(likeness(own, edited), 9), round(likeness(own, other), 9), *span(own, edited)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_rows_of_all_kinds(spark):
    rng = random.Random(2)
    words = ["the", "of", "é", "木木", "end.", "x,", "a" * 150, "𝔘𝔫𝔦"]
    texts = [None, "", "\n", "a", "ab", "\n\n\n", "one line only, with a mark. and more", "x" * 3000, " " * 700]
    texts += ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)] + [(None, "nobody"), (None, None), (12, "a tie"), (12, "a tie"), (5, "again"), (5, "more")]
    assert got(merkle.edited_fingerprints(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_many_ranges(spark):
    rows = [(i * i % 100_003, f"text {i % 50}\nof {i}") for i in range(3000)]
    assert got(merkle.edited_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5))) == expected(rows)


def test_one_row_and_none(spark):
    assert got(merkle.edited_fingerprints(spark.createDataFrame([(1, "abc def")], SCHEMA))) == expected([(1, "abc def")])
    assert merkle.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "x"), (None, "y z")]
    assert got(merkle.edited_fingerprints(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_fingerprints_keep_columns(spark):
    rows = [(1, "a\n\nb", "old", 1), (2, None, "old", 2), (2, None, "old", 2)]
    schema = T.StructType([*SCHEMA, T.StructField("fingerprint", T.StringType()), T.StructField("row", T.IntegerType())])
    out = merkle.fingerprints(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "row", "fingerprint", "n_sections", "n_paragraphs"]
    assert [(r["row"], r["fingerprint"], r["n_sections"], r["n_paragraphs"]) for r in out.orderBy("row").collect()] == [(1, *root("a\n\nb"), 3), (2, *root(""), 1), (2, *root(""), 1)]


def test_differing_branches_locate_edits(spark):
    """A change in one paragraph of a long text is that paragraph; sections around it are skipped whole."""
    rng = random.Random(8)
    lines = [" ".join(str(rng.randrange(1000)) for _ in range(8)) for _ in range(400)]
    pairs = []
    for at in (0, 7, 200, 399):
        changed = [*lines[:at], "other", *lines[at + 1 :]]
        pairs.append(("\n".join(lines), "\n".join(changed)))
        pairs.append(("\n".join(lines), "\n".join([*lines[:at], "new", *lines[at:]])))
        pairs.append(("\n".join(lines), "\n".join([*lines[:at], *lines[at + 1 :]])))
    pairs += [("same", "same"), ("a\na\na", "a\na"), ("a", "a\na"), ("", "x")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    trees = df.select("i", merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    found = trees.select("i", merkle.changed(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [(r["c"]["start"], r["c"]["stop"]) if r["c"] else (None, None) for r in found] == [span(a, b) for a, b in pairs]


def test_main_path_has_no_python(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    plan = merkle.edited_fingerprints(rows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
