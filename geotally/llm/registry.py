"""The thin queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm import decontaminate, exact_topk, langid, line_dedup, merkle, periodic, prefix_trie, quality, sentencepiece_codec, simhash, substring_dedup, toxicity, warc
from geotally.llm.common import fold, scratch, table

#: The public vocabulary; its path is a parameter of every operator that uses it.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without the lines that at least five documents share."""
    done = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op6_line_dedup"] = r"""
WITH pieces AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM pieces
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> f.keeper, false) AS gone
  FROM keyed LEFT JOIN frequent f ON f.k = keyed.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode_decode(docs, PIECE_MODEL, with_ids=False, with_text=False)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, deduplicated to revisit records and read back."""
    raw, resolved = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), raw)
    warc.resolve(spark, raw, resolved, min_bytes=0)
    return warc.read_resolved(spark, resolved).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE["op2_warc_revisit"] = r"""
WITH hexed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, payload_bytes, h,
         list_transform(range(0, 32), lambda i: ('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT // (32 ** (3 - i % 4))::INT % 32) AS ds
  FROM hexed
), digests AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(ds, lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (d + 1)::INT, 1)), '') AS payload_digest
  FROM bits
), newest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM newest
"""


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows, by inner product, of every hundredth vector."""
    vectors = exact_topk.quantised(table(spark, sf_dir, "embeddings"))
    return exact_topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10)


ORACLE["op5_exact_topk"] = r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or with a few errors: a row for each item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def language_training(docs: DataFrame) -> DataFrame:
    """Documents that language may be learned from."""
    return docs.where(F.coalesce(fold(parts=4) != 2, F.lit(False)) & F.col("lang").isNotNull())


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.drop("lang"), language_training(docs), PIECE_MODEL)
    return found.select(
        "doc_id", F.coalesce(fold(parts=4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def label_fold(held_out: bool):
    """Rows with remainder 0 are held out; rows without an id are neither learned from nor held out."""
    return F.coalesce(fold(parts=5) == 0 if held_out else fold(parts=5) != 0, F.lit(False))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = quality.classify(docs, labels, threshold=0.3, learn_from=label_fold(held_out=False))
    return found.select("doc_id", label_fold(held_out=True).alias("held_out"), "score", "predicted")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = toxicity.classify(docs, labels, threshold=0.5, learn_from=label_fold(held_out=False))
    return found.select("doc_id", label_fold(held_out=True).alias("held_out"), "score", "predicted")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without the 50-word passages that a smaller document has too."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50, with_text=False)


ORACLE["op10_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, p AS start, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM words WHERE len(ws) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS m FROM windows GROUP BY h
), hits AS (
  SELECT w.doc_id, w.start FROM windows w JOIN firsts USING (h) WHERE firsts.m < w.doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS p FROM hits
), placed AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM words
), kept AS (
  SELECT placed.doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed,
         string_agg(w, ' ' ORDER BY placed.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM placed LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p GROUP BY placed.doc_id
)
SELECT words.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of every whole document and of its edited text, likeness to it and to the next document,
    and the place that the differing branches give for the edit."""
    found = merkle.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changed_from", "changed_to"
    )


ORACLE["op12_merkle"] = rf"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS a, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS nx FROM documents WINDOW w AS (ORDER BY doc_id DESC)
), two AS (
  SELECT doc_id, a, left(a, length(a) - length(a) // 2) || left(nx, length(a) // 2) AS b, nx FROM own
), texts AS (
  SELECT doc_id, 'a' AS k, a AS text FROM two UNION ALL SELECT doc_id, 'b', b FROM two UNION ALL SELECT doc_id, 'n', nx FROM two
), lines AS (
  SELECT doc_id, k, text, string_split(text, chr(10)) AS ls, list_filter(list_distinct(regexp_extract_all(text, '{merkle.PIECE}')), lambda p: p <> '') AS ps FROM texts
), digests AS (
  SELECT *, list_transform(ls, lambda x: sha256('p:' || x)) AS ds, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0)::BIGINT AS n FROM lines
), cuts AS (
  SELECT *, list_filter(range(1, len(ds) + 1), lambda i: i = len(ds) OR ds[i] < '2' OR ds[i] = sha256('p:')) AS es FROM digests
), sections AS (
  SELECT *, list_transform(range(1, len(es) + 1), lambda j: sha256('s:' || array_to_string(ds[coalesce(es[j - 1], 0) + 1 : es[j]], ''))) AS ss FROM cuts
), trees AS (
  SELECT *, sha256('d:' || array_to_string(ss, '')) AS root FROM sections
), joined AS (
  SELECT x.doc_id, x.text, x.ls AS la, y.ls AS lb, y.text AS edited, x.root AS fingerprint, y.root AS edited_fingerprint,
         x.n AS na, y.n AS nb, z.n AS nz, coalesce(list_sum(list_transform(list_intersect(x.ps, y.ps), lambda p: length(p))), 0) AS both_edited,
         coalesce(list_sum(list_transform(list_intersect(x.ps, z.ps), lambda p: length(p))), 0) AS both_next
  FROM trees x JOIN trees y ON y.doc_id = x.doc_id AND y.k = 'b' JOIN trees z ON z.doc_id = x.doc_id AND z.k = 'n' WHERE x.k = 'a'
), ahead AS (
  SELECT *, coalesce(list_position(list_transform(range(1, len(la) + 1), lambda i: la[i] IS NOT DISTINCT FROM lb[i]), false), len(la) + 1) - 1 AS f,
         list_reverse(la) AS ra, list_reverse(lb) AS rb FROM joined
), around AS (
  SELECT *, least(coalesce(list_position(list_transform(range(1, len(ra) + 1), lambda i: ra[i] IS NOT DISTINCT FROM rb[i]), false), len(ra) + 1) - 1, least(len(la), len(lb)) - f) AS r FROM ahead
), spans AS (
  SELECT *, least(length(text), coalesce(list_sum(list_transform(la[1 : f], lambda x: length(x) + 1)), 0)) AS s, length(text) - coalesce(list_sum(list_transform(ra[1 : r], lambda x: length(x) + 1)), 0) AS e FROM around
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN na + nb = 0 THEN 1.0 ELSE 2.0::DOUBLE * both_edited::DOUBLE / (na + nb)::DOUBLE END AS near_edited, CASE WHEN na + nz = 0 THEN 1.0 ELSE 2.0::DOUBLE * both_next::DOUBLE / (na + nz)::DOUBLE END AS near_next,
       CASE WHEN text <> edited THEN s::BIGINT END AS changed_from, CASE WHEN text <> edited THEN greatest(s, e)::BIGINT END AS changed_to
FROM spans
"""


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """The documents, one in ten with words from a place on that repeat a stretch of its own.

    h is crc32 of the id's decimal text and g = h // 10.  Where h % 10 is 0, each of the n words from
    number a = g % n on becomes word a + (i - a) % p of the original, p = 1 + (n - a) // (3 + g % 8).
    Other texts, and those without an id or words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def turned(ws):
        n, g = F.size(ws).cast("long"), F.floor(h / 10)
        place = F.struct((g % n).alias("a"), n.alias("n"), (3 + g % 8).alias("parts"))
        period = lambda s: F.struct(s["a"].alias("a"), s["n"].alias("n"), (1 + F.floor((s["n"] - s["a"]) / s["parts"])).alias("p"))  # noqa: E731
        word = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(ws, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")))  # noqa: E731
        return F.when(n > 0, F.array_join(F.element_at(F.transform(F.transform(F.array(place), period), word), 1), " ")).otherwise("")

    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.element_at(F.transform(F.array(words), turned), 1)).otherwise(F.col("text")))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods in every whole document, and the texts without what repeats."""
    docs = with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.collapse_runs(docs, periods=4, min_words=6, with_text=False)
    longest = {k: periodic.longest(F.col("runs"), k) for k in ("start", "length", "period")}
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[v.alias(k) for k, v in longest.items()], F.floor(longest["length"] * 1000 / longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )  # fmt: skip


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.nodes(table(spark, sf_dir, "conversations")).drop("n_ends")


#: crc32 by its bits: the first number is the register's start, numbers of a byte are folded in, -1 shifts one bit out.
SQL_CRC = """list_reduce(list_concat([4294967295], flatten(list_transform(regexp_extract_all(conv_id::VARCHAR, '.'), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)"""

ORACLE["op11_prefix_trie"] = rf"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT DISTINCT conv_id FROM placed
), planned AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor({SQL_CRC}, 4294967295) % 4 AS h FROM convs
), parts AS (
  SELECT p.conv_id AS m, 0 AS part, k, r, x FROM planned p JOIN placed ON placed.conv_id = base AND k <= h
  UNION ALL SELECT p.conv_id, 1, k, r, x FROM planned p JOIN placed ON placed.conv_id = p.conv_id AND k > h
), turns AS (
  SELECT m, row_number() OVER (PARTITION BY m ORDER BY part, k) AS d, len(regexp_extract_all(x, '[^ 	-]+')) AS w, sha256(length(r) || ':' || r || x) AS c FROM parts
), paths AS (
  SELECT m, d, w, sha256(string_agg(c, ',') OVER (PARTITION BY m ORDER BY d)) AS v, max(d) OVER (PARTITION BY m) AS n FROM turns
  UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(d) FROM turns WHERE m = conv_id), 0) FROM convs
), nodes AS (
  SELECT d, v, min(m) AS owner, count(*) AS n_convs, max(n) AS longest, any_value(w) AS w, string_agg(m::VARCHAR, ',' ORDER BY m) FILTER (WHERE n = d) AS ends FROM paths GROUP BY d, v
), up AS (
  SELECT x.d, x.v, p.owner AS parent FROM nodes x JOIN paths a ON a.m = x.owner AND a.d = x.d - 1 JOIN nodes p ON p.d = a.d AND p.v = a.v
), under AS (
  SELECT a.d, a.v, count(*) FILTER (WHERE x.longest = x.d) AS n_leaves, count(*) FILTER (WHERE x.d = a.d + 1) AS n_children, sum((x.n_convs - 1) * x.w) AS saved
  FROM nodes x JOIN paths a ON a.m = x.owner AND a.d <= x.d GROUP BY a.d, a.v
)
SELECT owner AS conv_id, nodes.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes JOIN under ON under.d = nodes.d AND under.v = nodes.v LEFT JOIN up ON up.d = nodes.d AND up.v = nodes.v
"""
