"""The operators against brute-force versions, on small tables with all odd cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from geotally.llm import decontaminate, exact_topk, langid, line_dedup, passages, quality, sentencepiece_codec, simhash, substring_dedup, toxicity, warc
from geotally.llm.common import scratch
from geotally.operators.components import components
from geotally.llm.registry import PIECE_MODEL

DOCS = "doc_id long, text string, id string, hash int, leaks int, n_lines int, version string, start int, gone string, row int, __id string, lang_pred string"


def rows(spark, texts, schema=DOCS):
    """Documents 0, 1, ... with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4, "z", 5, "u", "v") for i, t in texts], schema)


def prose(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- line dedup -------------------------------------------------------------------------------

def lines_by_hand(texts, min_docs, min_chars):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                seen.setdefault(key(line), set()).add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(seen.get(key(x), ())) < min_docs or i == max(seen[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    shared, other = "A line that MANY documents share, really", "another line that is long enough, too ÄÖ"
    texts = [(i, f"own {i}\n  {shared.lower() if i % 2 else shared}\t\n{other}\n{shared}") for i in range(4)]
    texts += [(9, shared), (9, shared), (9, shared + "\n\n" + other), (None, shared), (None, None), (5, None), (6, ""), (7, "\n\n"), (8, "short")]
    found = line_dedup.drop_frequent_lines(rows(spark, texts), min_docs=5, min_chars=40)
    assert "hash" in found.columns and found.columns.count("n_lines") == 1
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str)
    assert got == lines_by_hand(texts, 5, 40)


def test_line_dedup_long_and_empty(spark):
    long = "\n".join(f"line number {i % 700} of a very long document, padded out" for i in range(3000))
    texts = [(i, long) for i in range(5)]
    got = line_dedup.drop_frequent_lines(rows(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [3000] * 4 + [0] and got[0].text == "" and got[4].text == long
    assert line_dedup.drop_frequent_lines(rows(spark, [])).collect() == []


# --- SentencePiece ----------------------------------------------------------------------------

def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = [None, "", " ", "  ", "a", " a", "a ", "  two  blanks ", "▁literal▁ mark", "tab\tand\nline", "Ünïcode 漢字 😀\x00", "<s> </s>", "x" * 5000, "the the the " * 3000]
    found = sentencepiece_codec.encode_decode(rows(spark, enumerate(texts)), PIECE_MODEL, block_chars=50).orderBy("doc_id").collect()
    whole = sentencepiece_codec.encode_decode(rows(spark, enumerate(texts)), PIECE_MODEL, use_chunks=False).orderBy("doc_id").collect()
    assert found == whole
    odd = sentencepiece_codec.encode_decode(rows(spark, [(None, "a b"), (None, "a b"), (7, None)]), PIECE_MODEL, with_ids=False, with_text=False).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in odd) == [(0, 4), (0, 4), (7, 2)]
    for r, text in zip(found, texts, strict=True):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_decode(rows(spark, []), PIECE_MODEL).count() == 0


def test_chunks_are_checked():
    class Model:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "a▁b"][i]

    assert not sentencepiece_codec.chunks_are_independent(Model())


# --- SimHash ----------------------------------------------------------------------------------

def print_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_simhash(spark):
    rng = random.Random(1)
    texts = [prose(rng, 120) for _ in range(30)]
    texts += [t.replace("w1", "W1") for t in texts[:10]] + [" ".join(t.split()[:-1]) for t in texts[5:20]] + texts[:3]
    texts += [None, "", "  \n", "one", "One", "a b c", "é É"]
    found = simhash.near_duplicates(rows(spark, enumerate(texts))).orderBy("doc_id").collect()
    prints = [print_by_hand(t) for t in texts]
    assert [int(r.fingerprint, 16) for r in found] == prints
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = classes_by_hand(pairs, range(len(prints)))
    assert {r.doc_id: r.component_id for r in found} == want
    kept = simhash.keep_one(rows(spark, [*enumerate(texts), (0, texts[0]), (None, "no id")])).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert [r.text for r in kept if r.doc_id is None] == ["no id"]
    assert simhash.near_duplicates(rows(spark, [])).collect() == []


def test_simhash_joins_keys_by_a_shuffle(spark):
    """The keys are 64 times the fingerprints, which Spark's sizes don't know: neither side is broadcast, however small."""
    few = spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long")
    found = simhash.links(few)
    assert sorted(map(tuple, found.collect())) == [(1, 3), (1, 1 << 40), (3, 1 << 40)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(70_000))
    texts = [(None, long), (5, long), (5, long), (3, long + " end"), (None, "alone here"), (9, "other")]
    found = simhash.near_duplicates(rows(spark, texts)).collect()
    assert len(found) == 6 and {int(r.fingerprint, 16) for r in found if r.doc_id == 5} == {print_by_hand(long)}
    assert sorted(map(str, (r.component_id for r in found))) == ["3", "3", "3", "3", "9", "None"]


def test_links_are_complete(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for d in range(1, 7):
            q = p
            for b in rng.sample(range(64), d):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (p >> 63 << 64) for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 6)


def test_sketches_keep_similar_sets_and_end_others():
    rng = np.random.default_rng(5)
    differ = lambda a, b: sum((x ^ y & (1 << 64) - 1).bit_count() for x, y in zip((v & (1 << 64) - 1 for v in simhash.sketch(a)), (v & (1 << 64) - 1 for v in simhash.sketch(b))))
    bits = 64 * simhash.SKETCH_LONGS
    most = bits - int(bits * 0.9 - simhash.SKETCH_DEVIATIONS * (bits * 0.9 * 0.1) ** 0.5)
    passed = {}
    for share in (0.8, 0.5):
        common = int(300 * share)
        extra = (300 - common) // 2
        hits = 0
        for _ in range(200):
            h = rng.integers(0, 1 << 63, 300, dtype=np.int64).view(np.uint64)
            hits += differ(h[: common + extra], np.concatenate([h[:common], h[common + extra :]])) <= most
        passed[share] = hits
    assert passed[0.8] >= 196 and passed[0.5] <= 40
    assert simhash.sketch(np.zeros(0, np.uint64)) == [0] * simhash.SKETCH_LONGS


def test_a_large_family_that_is_not_similar_enough_makes_few_pairs(spark):
    """Near copies of one text, nearly all pairs under 0.8: the links are those of brute force, and the join
    of candidates leaves most pairs out."""
    rng = random.Random(21)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.sample(range(150), 6):
            words[at] = "w%d" % rng.randrange(10**9)
        texts.append(" ".join(words))
    for k in range(20):
        words = texts[k].split()
        words[75] = "other"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]
    assert len(pairs) < len(texts) ** 2 / 20
    made = []
    whole = simhash._pairs
    try:
        simhash._pairs = lambda *a: made.append(whole(*a)) or made[-1]
        found = {r.doc_id: r.component_id for r in simhash.similar_components(rows(spark, enumerate(texts))).collect()}
        candidates = made[0].count()
    finally:
        simhash._pairs = whole
    want = classes_by_hand(pairs, range(len(sets)))
    together = sum(found[i] == found[j] for i, j in pairs)
    assert together >= 0.9 * len(pairs) and all(want[i] == want[j] for i in found for j in [found[i]])
    assert candidates < len(texts) ** 2 / 8


def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [prose(rng, 200) for _ in range(40)]
    for t in texts[:40]:
        words = t.split()
        for at in rng.sample(range(200), rng.randrange(1, 5)):
            words[at] = "new"
        texts.append(" ".join(words))
    texts += [texts[0].upper(), None, "", "one two", "one  two", "a b c d e"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]
    want = classes_by_hand(pairs, range(len(sets)))
    docs = rows(spark, enumerate(texts))
    assert {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()} == want
    full = docs.select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in corpus_pipeline.COLUMNS[2:]])
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, full, "").collect()} == set(want.values())
    assert max((simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() for i, j in pairs) > 5
    assert simhash.similar_components(rows(spark, [])).collect() == []
    with_null = simhash.similar_components(rows(spark, [(None, texts[0]), (7, texts[0]), (None, "no id")])).collect()
    assert sorted(map(str, (r.component_id for r in with_null))) == ["7", "7", "None"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, i) for i in range(201, 230)] + [(7, 7), (300, 300)]
    found = components(spark.createDataFrame([*edges, (None, 3), edges[0]], "a long, b long")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.root for r in found} == classes_by_hand([e for e in edges if e[0] != e[1]], nodes) and len(found) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- WARC -------------------------------------------------------------------------------------

def test_warc(spark):
    html = ["<p>é</p>", "<p>é</p>", None, "", "WARC/1.1\r\n\r\nnot a record\r\n\r\n", "x" * 200_000, "one\ntwo\r\n", "x" * 200_000, "lone"]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nEvil: 1" if i else None, h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, record_id int")
    raw, done = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write_archives(warc.page_records(pages), raw, file_bytes=100_000)
    payloads = {r.record_id: bytes(r.payload).decode() for r in warc.read_archives(spark, raw, with_payload=True).collect()}
    assert payloads == {i: h or "" for i, h in enumerate(html)}
    warc.resolve(spark, raw, done, min_bytes=1)
    found = {r.record_id: r for r in warc.read_resolved(spark, done).collect()}
    assert len(found) == len(html)
    for i, h in enumerate(html):
        same = [j for j, other in enumerate(html) if other == h and h]
        last = max(same, default=i)
        assert found[i].payload_bytes == len((h or "").encode())
        assert (found[i].record_type, found[i].refers_to) == (("response", None) if i == last else ("revisit", last))
        import base64

        assert found[i].payload_digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    raw, done = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write_archives(warc.page_records(pages.where("false")), raw)
    warc.resolve(spark, raw, done)
    assert warc.read_resolved(spark, done).count() == 0


def test_any_number_of_gzip_members(spark):
    import gzip

    def raw(i, payload, kind="response", extra=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\n{extra}Content-Length:{len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    records = [raw(i, bytes([i]) * (300_000 * i)) for i in range(5)] + [raw(9, b"", "warcinfo")]
    for content in (b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), b"".join(records)):
        assert [(h["warc-record-id"], len(b)) for h, b in warc.parse(content)] == [(f"<urn:page:{i}>", 300_000 * i) for i in range(5)] + [("<urn:page:9>", 0)]
    assert list(warc.parse(b"")) == []
    whole = b"".join(map(gzip.compress, records))
    for broken in (whole[:-3], whole + gzip.compress(b"WARC/1.1\r\nCont"), gzip.compress(raw(1, b"xx")[:-5]), whole + gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises(ValueError, match="archive ends|no WARC|longer"):
            list(warc.parse(broken))


def test_archives_of_others(spark):
    """Null and repeated ids, payloads above a batch, bytes that are no text, revisits of the source,
    wrong and missing digests, other types of records."""
    big = bytes(range(256)) * 20_000
    digest = warc.base64.b32encode(hashlib.sha1(big).digest()).decode()
    made = [
        (1, "response", big, None, None), (2, "response", big, "WRONG", None), (2, "response", big, None, None), (None, "response", big, None, None),
        (3, "revisit", b"", digest, 1), (4, "revisit", b"", "NOWHERE", 77), (5, "warcinfo", b"tool: x", None, None), (6, "response", b"lone", None, None),
    ]
    df = spark.createDataFrame(
        [(i, k, None, "2024-01-02T03:04:05Z", None, bytearray(p), d, len(p), r) for i, k, p, d, r in made],
        "record_id long, record_type string, uri string, date string, content_type string, payload binary, payload_digest string, payload_bytes long, refers_to long",
    )
    raw, done = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write_archives(df, raw)
    warc.resolve(spark, raw, done)
    found = warc.read_archives(spark, done, with_payload=True).collect()
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_digest == digest, len(r.payload)) for r in found), key=str)
    want = [(1, "revisit", 2, True, 0), (2, "response", None, True, len(big)), (2, "response", None, True, len(big)), (None, "response", None, True, len(big)),
            (3, "revisit", 2, True, 0), (4, "revisit", 77, False, 0), (5, "warcinfo", None, False, 7), (6, "response", None, False, 4)]
    assert got == sorted(want, key=str)
    assert {r.date for r in found} == {"2024-01-02T03:04:05Z"} and all(bytes(r.payload) == big for r in found if r.record_id == 2)
    sizes = {r.record_id: r.payload_bytes for r in warc.read_resolved(spark, done).collect() if r.record_id}
    assert sizes == {1: len(big), 2: len(big), 3: len(big), 4: None, 5: 7, 6: 4}


def test_foreign_ids_and_records_without_a_length():
    for urn, number in [("<urn:page:12>", 12), ("<urn:page:-3>", -3), ("<urn:page:abc>", None), ("<urn:page:>", None), ("<urn:page:1_0>", None), ("<urn:page:٣>", None), ("<urn:page:9223372036854775807>", 2**63 - 1), ("<urn:page:9223372036854775808>", None), ("<urn:uuid:1>", None), ("", None), (None, None)]:
        assert warc._number(urn) == number
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\n%s\r\n"
    length = b"Content-Length: %d\r\n"
    records = [(head % (1, b""), b"no length"), (head % (2, length % 4), b"four"), (head % (3, b"Content-Length: many\r\n"), b"a\r\n\r\nb"), (head % (4, b""), b"")]
    whole = b"".join(h + b + b"\r\n\r\n" for h, b in records)
    import gzip

    for content in (whole, gzip.compress(whole), b"".join(gzip.compress(h + b + b"\r\n\r\n") for h, b in records)):
        assert [(h["warc-record-id"], b) for h, b in warc.parse(content)] == [(f"<urn:page:{i}>", b) for i, (_, b) in enumerate(records, 1)]
    assert [b for _, b in warc.parse(head % (1, b"") + b"cut")] == [b"cut"]


# --- exact top-k ------------------------------------------------------------------------------

def test_top_k(spark):
    rng = random.Random(4)
    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None, 2.0]), (302, [1.0, float("nan"), 2.0]), (303, [float("inf")] * 3), (304, [1.0, 2.0]), (305, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, shard int")
    q = exact_topk.quantised(df, scale=2)
    assert q.count() == 302
    found = exact_topk.top_k(q.where("vec_id % 100 = 0 OR vec_id = 304"), q, k=7, query_rows=2, tile_rows=16, fan_in=2, block_bytes=100).collect()
    usable = [(i, [int(2 * x) for x in v]) for i, v in vectors[:300]]
    for qid in (0, 100, 200):
        want = sorted((-sum(a * b for a, b in zip(usable[qid][1], v, strict=True)), i) for i, v in usable if i != qid)[:7]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == qid), key=lambda r: r.rank)] == want
    assert len(found) == 21  # 304 has no other vector of its length
    assert exact_topk.top_k(q.where("false"), q).collect() == []
    big = spark.createDataFrame([(i, [2.0**29 + i, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(*[exact_topk.quantised(big, scale=1)] * 2, k=1).where("query_id = 0").first()
    assert got.score == 2**29 * (2**29 + 2) + 1
    repeated = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(*[exact_topk.quantised(repeated, scale=1)] * 2, k=3).where("query_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2), (1, 2), (2, 2)]
    huge = exact_topk.quantised(spark.createDataFrame([(i, [2.0**31]) for i in range(2)], "vec_id long, embedding array<double>"), scale=1)
    with pytest.raises(Exception, match="don't fit in 64 bits"):
        exact_topk.top_k(huge, huge).collect()


# --- decontamination --------------------------------------------------------------------------

def test_myers_is_edit_distance():
    rng = random.Random(5)

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            before, row = row, [i]
            for j, d in enumerate(t, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return min(row)

    for _ in range(200):
        p = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))
        assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == distance(p, t)


def test_search_is_complete():
    """Items edited at random are found exactly when the whole text has them near enough."""
    rng = random.Random(13)
    items = ["".join(rng.choice("abcd ") for _ in range(40)).strip() for _ in range(20)]
    items = [decontaminate.normalise(i) for i in items]
    finder = decontaminate.Finder(list(enumerate(items)), 0.15)
    for _ in range(300):
        chars = list(rng.choice(items))
        for _ in range(rng.randrange(10)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randrange(2)] = rng.choice(["a", "b", "", "dd"])
        text = decontaminate.normalise("".join(rng.choice("abcd ") for _ in range(20)) + "".join(chars) + "cab")
        want = {i: d for i, p in enumerate(items) if (d := decontaminate.myers(decontaminate.masks(p), len(p), text)[0]) <= decontaminate.budget(len(p), 0.15)}
        assert {x["item_id"]: x["distance"] for x in finder.leaks(text)} == want


def test_decontamination(spark):
    rng = random.Random(6)
    item = prose(rng, 40)
    edited = item.replace(item.split()[3], "zzz", 1).replace(item.split()[20], "", 1)
    far = " ".join(w if i % 3 else "other" for i, w in enumerate(item.split()))
    texts = [None, "", prose(rng, 300), prose(rng, 100) + " " + item.upper() + "! " + prose(rng, 50), "(" + edited.replace(" ", ",\n") + ")", far, item[: len(item) // 2]]
    bench = spark.createDataFrame([(1, item), (2, item), (None, item), (4, None), (5, "short"), (6, "")], "item_id long, text string")
    found = decontaminate.with_leaks(rows(spark, enumerate(texts)), bench, block_chars=50).orderBy("doc_id").collect()
    assert [sorted(x.item_id or 0 for x in r.leaks) for r in found] == [[], [], [], [0, 1, 2], [0, 1, 2], [], []]
    assert {x.distance for x in found[3].leaks} == {0} and all(0 < x.distance <= len(item) * decontaminate.ERROR_RATE for x in found[4].leaks)
    clean = decontaminate.normalise(texts[3])
    assert clean[found[3].leaks[0].start : found[3].leaks[0].end] == decontaminate.normalise(item)
    kept = decontaminate.decontaminate(rows(spark, enumerate(texts)), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5, 6] and kept.columns == rows(spark, []).columns
    assert decontaminate.decontaminate(rows(spark, enumerate(texts)), bench.where("false")).count() == len(texts)
    assert decontaminate.with_leaks(rows(spark, []), bench).collect() == []


def test_short_items_and_several_blocks(spark):
    """Items under the bound as whole words, with errors too; blocks one after the other over many batches."""
    rng = random.Random(14)
    items = [(i, prose(rng, 30)) for i in range(12)] + [(100, "What is the capital of France?"), (101, "H2O"), (102, "?!")]
    texts = [prose(rng, 40) + " " + items[i % 12][1] for i in range(60)] + ["so what is the  capital, of france", "what is the capital of frances", "somewhat is the capital of france", "h2o", "H2O2 is not ch2o", "h2o " * 50_000, "w1 " * 100_000 + items[3][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = rows(spark, [*enumerate(texts), (1, texts[1]), (1, texts[1])]).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = decontaminate.with_leaks(docs, bench, block_chars=600).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in found}
    assert len(found) == len(texts) + 2
    assert [got[i] for i in range(len(texts))] == [[i % 12] for i in range(60)] + [[100], [100], [], [101], [], [101], [3]]
    whole = {r.doc_id: r.leaks for r in decontaminate.with_leaks(docs, bench).collect()}
    assert whole == {r.doc_id: r.leaks for r in found}


def test_short_items_with_errors_equal_all_spans_of_words():
    """Ten to thirty-one characters: found exactly where some whole words are near enough."""
    rng = random.Random(15)

    def distance(p, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(p, 1):
            before, row = row, [i]
            for j, d in enumerate(t, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return row[-1]

    items = sorted({decontaminate.normalise("".join(rng.choice("abcd  ") for _ in range(rng.randrange(8, 31)))) for _ in range(40)} - {""})
    finder = decontaminate.Finder(list(enumerate(items)), 0.10, decontaminate.MIN_ITEM_CHARS)
    some = 0
    for _ in range(250):
        chars = list(rng.choice(items))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randrange(2)] = rng.choice(["a", "b", " ", "d"])
        text = decontaminate.normalise("".join(rng.choice("abcd ") for _ in range(12)) + rng.choice(["", " "]) + "".join(chars) + rng.choice(["", " "]) + "ca")
        words, want = text.split(" "), {}
        for n, p in enumerate(items):
            spans = [d for i in range(len(words)) for j in range(i + 1, len(words) + 1) if abs(len(t := " ".join(words[i:j])) - len(p)) <= decontaminate.budget(len(p)) and (d := distance(p, t)) <= decontaminate.budget(len(p))]
            if spans:
                want[n] = min(spans)
        some += any(want.values())
        assert {x["item_id"]: x["distance"] for x in finder.leaks(text)} == want
    assert some > 20


def test_typing_errors_in_short_questions(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?")], "item_id long, text string")
    texts = ["What is the capital of Frence?", "so: what is the capitol of france, then", "what is the capital of greece", "whats the capital of france", None]
    found = decontaminate.with_leaks(rows(spark, enumerate(texts)), bench).orderBy("doc_id").collect()
    assert [[x.distance for x in r.leaks] for r in found] == [[1], [1], [], [2], []]


# --- language ID ------------------------------------------------------------------------------

def all_segmentations(word, p, unknown):
    if not word:
        return 1.0
    total = sum(p[word[:n]] * all_segmentations(word[n:], p, unknown) for n in range(1, len(word) + 1) if word[:n] in p)
    return total if word[:1] in p else total + unknown * all_segmentations(word[1:], p, unknown)


def test_forward_sums_all_segmentations():
    v = langid.vocabulary(PIECE_MODEL)
    rng = np.random.default_rng(7)
    probability = rng.random((v.size + 1, 2))
    for words in (["the", "and", "xqz"], ["straße", "ωmega_"[:5] + "x"], ["a"]):
        words = [w for w in words if len(w) == len(words[0])]
        got = langid.log_scores(v, words, probability)
        for k in range(2):
            p = {piece: probability[i, k] for i, piece in enumerate(v.pieces)}
            want = [np.log(all_segmentations(langid.MARK + w, p, probability[v.size, k])) for w in words]
            assert np.allclose(got[:, k], want)


def test_long_words_as_short_ones():
    v = langid.vocabulary(PIECE_MODEL)
    rng = np.random.default_rng(8)
    probability = rng.random((v.size + 1, 3)) / 1000
    for w in ("a", "the", "xqzthe", "donaudampfschifffahrt", "漢字かな", "straßeωω"):
        assert np.allclose(langid.long_score(v, w, np.log(probability)), langid.log_scores(v, [w], probability)[0])
        assert np.allclose(langid.long_counts(v, w, 2.5), langid.expected_counts(v, [w], np.array([2.5])))
    assert np.isfinite(langid.long_score(v, "the漢" * 5000, np.log(probability))).all()
    assert langid.words("½ ² ① Ⅷ 12 _") == [] and langid.words("x½y é² " + "Z" * 50) == ["x", "y", "é", "z" * 50]


def test_language_ties_repeats_and_bounds(spark):
    same = spark.createDataFrame([("one text", "b"), ("one text", "a")], "text string, lang string")
    docs = rows(spark, [(1, "one text"), (1, "one text"), (2, "½ ² ①"), (None, "text"), (3, "漢" * 3000)])
    found = langid.identify(docs, same, PIECE_MODEL).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in found) == [(0, "a"), (1, "a"), (1, "a"), (2, "und"), (3, "a")]
    assert found[0].__fields__.count("lang_pred") == 1 and docs.columns == [c for c in found[0].__fields__ if c not in ("lang_pred", "lang_score")] + ["lang_pred"]


def test_more_languages_than_a_model_holds(spark, monkeypatch):
    """Languages in several models give what one model gives."""
    rng = random.Random(16)
    own = [f"{c}{d}" for c in "abcdefgh" for d in "xyz"]
    texts = [(" ".join(rng.choice(own[k * 3 : k * 3 + 5]) * 3 for _ in range(20)), f"l{k}") for k in range(7) for _ in range(3)]
    training = spark.createDataFrame(texts, "text string, lang string")
    docs = rows(spark, [*enumerate(t for t, _ in texts), (90, None), (91, "12"), (92, "azby")])
    whole = {r.doc_id: (r.lang_pred, round(r.lang_score, 9)) for r in langid.identify(docs, training, PIECE_MODEL).collect()}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert len(langid.train(training, PIECE_MODEL)) == 4
    parts = {r.doc_id: (r.lang_pred, round(r.lang_score, 9)) for r in langid.identify(docs, training, PIECE_MODEL).collect()}
    assert parts == whole and whole[90] == whole[91] == ("und", 0.0) and {p for p, _ in whole.values()} >= {f"l{k}" for k in range(7)}
    none = langid.identify(docs, training.where("false"), PIECE_MODEL).collect()
    assert {(r.lang_pred, r.lang_score) for r in none} == {("und", 0.0)}


def test_language_id(spark):
    english = ["the house is on the hill and the dog is in it", "this is what they wanted from the other side of the river"]
    german = ["das haus ist auf dem hügel und der hund ist darin", "das ist was sie von der anderen seite des flusses wollten"]
    train = spark.createDataFrame([(t, "en", 1) for t in english] + [(t, "de", 2) for t in german] + [(None, "fr", 3), ("text", None, 4)], "text string, lang string, piece int")
    texts = [None, "", "12 ?!", "the other house and the river", "der andere hund und das haus", "THE DOG " * 4000, "x" * 10_000, "漢字"]
    found = langid.identify(rows(spark, enumerate(texts)), train, PIECE_MODEL).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found][:6] == ["und", "und", "und", "en", "de", "en"]
    assert all(0 <= r.lang_score <= 1 for r in found) and found[0].lang_score == 0
    assert {r.lang_pred for r in langid.identify(rows(spark, [(1, "the")]), train.where("false"), PIECE_MODEL).collect()} == {"und"}
    assert langid.identify(rows(spark, []), train, PIECE_MODEL).collect() == []


# --- toxicity ---------------------------------------------------------------------------------

def near_by_hand(word, term):
    row = list(range(len(word) + 1))
    for i, c in enumerate(term, 1):
        before, row = row, [i]
        for j, d in enumerate(word, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return row[-1]


def test_automaton_finds_what_is_near():
    rng = random.Random(8)
    terms = {t: 1.0 for t in ("abcab", "abcabcabc", "abc", "bacca")}
    lexicon = toxicity.Lexicon(terms, {})
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 12)))
        want = [near_by_hand(w, t) for t in terms if near_by_hand(w, t) <= toxicity.errors_allowed(t)]
        got = lexicon.match(w)
        assert (got is not None) == bool(want) and (not want or got[1] == min(want)), w
    assert toxicity.Lexicon({}, {"abca": 2.0}).match("abcaxyz") == (2.0, 0)
    assert toxicity.Lexicon(terms, {}, frozenset({"abcaa"})).match("abcaa") is None


def test_toxicity(spark):
    rng = random.Random(9)
    bad, texts, labels = ["idiotic", "scumbag", "moronic"], [], []
    for i in range(300):
        words = prose(rng, 60, 200).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")).split()
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(bad)
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    extra = [(1000, "you are so idiotik"), (1001, None), (1002, ""), (1003, "you m0ronic thing"), (None, "plain words")]
    marked = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, key int")
    found = {r.doc_id: r for r in toxicity.classify(rows(spark, texts + extra), marked, learn_from=F.col("doc_id") < 200).collect()}
    assert all(found[i].predicted == (i % 4 == 0) for i in range(300))
    assert found[1000].predicted == found[1003].predicted == 1 and not any(found[i].predicted for i in (1001, 1002, None))
    assert all(0 <= r.score <= 1 for r in found.values()) and len(found) == 305
    none = toxicity.classify(rows(spark, texts[:5]), marked.where("false")).collect()
    assert len(none) == 5 and not any(r.predicted for r in none)
    assert toxicity.classify(rows(spark, []), marked).collect() == []


def test_first_letters_short_terms_and_long_runs():
    rng = random.Random(10)
    terms = {t: 1.0 for t in ("abcab", "abcabcabc", "abc", "bacca")}
    lexicon = toxicity.Lexicon(terms, {})
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
        want = [near_by_hand(w, t) for t in terms if near_by_hand(w, t) <= toxicity.errors_allowed(t)]
        got = lexicon.match(w)
        assert (got is not None) == bool(want) and (not want or got[1] == min(want)), w
    lexicon = toxicity.Lexicon({"stupid": 5.0, "idiot": 5.0, "ass": 5.0, "x" * 45: 5.0}, {})
    scorer = toxicity.Scorer(lexicon)
    for word, exact in [("tupid", False), ("xtupid", False), ("ztupid", False), ("$tupid", True), ("1diot", True), ("@ss", True), ("a$s", True), ("ass", True), ("x" * 45, True)]:
        x = scorer.features(f"some {word} here")
        assert (x[1] > 0, x[2] > 0) == (exact, not exact), word
    assert toxicity.clean("15 as 10diot a_1diot $5") == "15 as 10diot a_1diot $5"


def test_short_and_long_terms_are_learned(spark):
    table = spark.createDataFrame([("bad " + "q" * 50, 1), ("fine words", 0)], "text string, label int")
    assert {"w:bad", "w:" + "q" * 50} <= {r.key for r in toxicity.word_counts(table).collect()}


def test_many_words_as_one_by_one():
    rng = random.Random(15)
    terms = {"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 14))): rng.random() for _ in range(300)} | {"e" * 40: 1.0, "d" * 70: 2.0}
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 15))) for _ in range(2000)] + ["e" * 39, "e" * 42, "e" * 43, "d" * 69, "d" * 100, "x" * 5000]
    lexicon = toxicity.Lexicon(terms, {"abca": 2.0, "ddddd": 0.5}, frozenset(words[:100]))
    words = list(dict.fromkeys(words))
    assert lexicon.match_all(words) == {w: hit for w in words if (hit := lexicon.match(w))}
    assert toxicity.Lexicon({}, {}).match_all(words) == {}


def test_very_long_texts_of_toxicity():
    lexicon = toxicity.Lexicon({"scumbag": 5.0}, {})
    scorer = toxicity.Scorer(lexicon, most=10)
    texts = ["fine " * 500_000 + "scumbag", "fine " * 500_000, None, "some sumbag here", "a b c d e f g h i j k l m scumbag"]
    assert [bool(x[1:].any()) for x in scorer.features_of(texts)] == [True, False, False, True, True]


def test_quotation_counts_for_less():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 5.0}, {}))
    abuse, quotation = scorer.features("you are an idiot and you know it"), scorer.features('he said "idiot" , which the report called a word')
    assert abuse @ toxicity.PRIOR > quotation @ toxicity.PRIOR and quotation[3] > 0 and abuse[3] == 0


# --- quality ----------------------------------------------------------------------------------

def test_quality(spark):
    rng = random.Random(10)
    good = [prose(rng, rng.randrange(30, 200)) + "." for _ in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randrange(30, 200), 20).split()) for _ in range(60)]
    texts = [*enumerate(good + junk), (900, None), (901, ""), (902, "x" * 100_000), (None, good[0])]
    labels = spark.createDataFrame([(i, int(i < 120), 5) for i in range(180)] + [(None, 1, 5), (3, None, 5), (4, 7, 5)], "doc_id long, quality int, x int")
    found = {r.doc_id: r for r in quality.classify(rows(spark, texts), labels, learn_from=F.col("doc_id") % 5 != 0).collect()}
    right = sum(found[i].predicted == (i < 120) for i in range(0, 180, 5))
    assert right >= 35 and len(found) == 184 and all(0 <= r.score <= 1 for r in found.values())
    assert [r.score for r in quality.classify(rows(spark, texts[:2]), labels.where("false")).collect()] == [0.5, 0.5]
    assert quality.classify(rows(spark, []), labels).collect() == []


def statistics_by_hand(text):
    """The fourteen statistics in the plainest way, on bytes."""
    data = (text or "").encode()
    space, common = b" \t\n\x0b\x0c\r", b".,;:'\"-()?"
    upper, lower, digit = (lambda b: 65 <= b <= 90), (lambda b: 97 <= b <= 122), (lambda b: 48 <= b <= 57)
    mark = lambda b: b < 128 and not (upper(b) or lower(b) or digit(b) or b in common or b in space)
    words, n = data.split(), len(data)
    grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    count = lambda f: sum(map(f, data))
    logit = lambda x, n: np.log((x + 0.5) / (max(n - x, 0) + 0.5))
    shouted = [w for w in words if len(w) > 1 and sum(map(upper, w)) >= 2 and not any(map(lower, w))]
    return [
        np.log1p(len(words)), np.log1p(n / max(len(words), 1)), logit(count(upper), n), logit(count(digit), n), logit(count(mark), n), logit(count(lambda b: b in common), n), logit(count(lambda b: b >= 128), n),
        logit(data.count(b"\n"), n), logit(sum(any(map(mark, w)) for w in words), len(words)), logit(len(shouted), len(words)), logit(len(set(words)), len(words)),
        logit(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)), logit(len(set(grams)), len(grams)), logit(sum(mark(a) and mark(b) for a, b in zip(data, data[1:], strict=False)), n),
    ]


def test_statistics_of_texts():
    import pyarrow as pa

    rng = random.Random(18)
    texts = [None, "", "  \n", "One", "ÄÖ é漢字 ##", "BUY NOW!!! $$$ BUY NOW!!!"] + ["".join(rng.choice("abAB 12\n.,#$éß ") for _ in range(rng.randrange(300))) for _ in range(60)] + [prose(rng, 3000)]
    assert np.allclose(quality.statistics(pa.array(texts, pa.string())), [statistics_by_hand(t) for t in texts])


def test_repeated_ids_and_long_texts_of_quality(spark):
    rng = random.Random(17)
    texts = [(i, prose(rng, 50) if i % 2 else "!!! " * 50) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    found = quality.classify(rows(spark, [*texts, (1, texts[1][1]), (77, "plain words here " * 100_000)]), labels).collect()
    assert len(found) == 42 and len({r.score for r in found if r.doc_id == 1}) == 1


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(11)
    d = len(quality.STATISTICS)
    model, logs = {}, []
    x = rng.normal(size=(5, d))
    for c in (0, 1):
        a = rng.normal(size=(d, d))
        v, mean = a @ a.T + np.eye(d), rng.normal(size=d)
        f = np.linalg.cholesky(v)
        model[c] = {"mean": mean, "factor": f, "inverse": np.linalg.inv(f), "log_det": 2 * np.log(np.diag(f)).sum(), "log_share": np.log(0.25 + 0.5 * c)}
        logs.append([-0.5 * ((r - mean) @ np.linalg.solve(v, r - mean) + np.linalg.slogdet(v)[1]) + np.log(0.25 + 0.5 * c) for r in x])
    assert np.allclose(quality.log_odds(model, x), np.array(logs[1]) - np.array(logs[0]))


# --- substring dedup --------------------------------------------------------------------------

def repeats_by_hand(texts, size):
    split = [(i, [w for w in (t or "").replace("\n", " ").split(" ") if w]) for i, t in texts]
    where = {}
    for i, words in split:
        for s in range(len(words) - size + 1):
            if i is not None:
                where.setdefault(tuple(words[s : s + size]), set()).add(i)
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - size + 1):
            if i is not None and min(where[tuple(words[s : s + size])]) < i:
                gone |= set(range(s, s + size))
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram"), [(50, 16), (6, 3)])
def test_substring_dedup(spark, window, gram):
    rng = random.Random(window)
    passage = [prose(rng, 3 * window) for _ in range(4)]
    texts = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 2 * window))]
        for p in rng.sample(passage, 2):
            words = p.split()
            a = rng.randrange(window)
            words = words[a : a + rng.randrange(window - 2, 3 * window)]
            if rng.random() < 0.5 and words:
                words[rng.randrange(len(words))] = "edited"
            parts += [" ".join(words), prose(rng, rng.randrange(0, 5))]
        texts.append((i, "\n ".join(parts)))
    texts += [(50, "ha " * 400), (51, "ha " * 300), (52, "to be or not " * 100), (53, "not to be or " * 90), (50, passage[0]), (50, passage[0]), (60, passage[0]), (None, passage[0]), (61, None), (62, ""), (63, " \n")]
    texts += [(70, texts[3][1]), (71, texts[3][1])]
    found = substring_dedup.remove_repeats(rows(spark, texts), window=window, gram=gram).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found), key=str)
    assert got == repeats_by_hand(texts, window)


def test_references_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", 2)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 100)
    rng = random.Random(16)
    passage = prose(rng, 120)
    texts = [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(30)] + [(100 + i, prose(rng, 5000) + " " + passage) for i in range(3)]
    found = substring_dedup.remove_repeats(rows(spark, texts)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found), key=str) == repeats_by_hand(texts, 50)


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(rows(spark, [])).collect() == []


def test_matching_statistics():
    rng = random.Random(12)
    for _ in range(100):
        a = [rng.randrange(3) for _ in range(30)]
        b = [rng.randrange(3) for _ in range(40)]
        covered = set()
        for s in range(len(b) - 3):
            if any(a[t : t + 4] == b[s : s + 4] for t in range(len(a) - 3)):
                covered |= set(range(s, s + 4))
        assert {i for x, y in passages.SuffixAutomaton(a).spans(b, 4) for i in range(x, y)} == covered
