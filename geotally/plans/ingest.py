"""Ingest: snapshots, merges, quality flags, addresses, phases, hashes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions import fingerprint, scalars
from geotally.operators.matching import unambiguous_match
from geotally.operators.merging import conflicts, insert_only_merge
from geotally.operators.ranking import quantiles
from geotally.plans.base import Tables
from geotally.plans.registry import query


def _orders(orders: DataFrame, *more: str) -> DataFrame:
    digest = scalars.row_digest(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", digest.alias("row_hash"), *more)


SQL_ORDERS = "hashed AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, sha256(concat_ws(chr(31), o_custkey, o_orderstatus, o_orderpriority)) AS row_hash FROM orders)"


@query(f"""WITH {SQL_ORDERS}, staged AS (
  SELECT h.o_orderkey + CASE WHEN o_totalprice > 250000 THEN 100000000 ELSE 0 END AS o_orderkey, h.o_custkey, h.o_orderstatus, h.o_orderpriority, h.row_hash
  FROM hashed h JOIN orders o ON o.o_orderkey = h.o_orderkey WHERE h.o_orderkey % 3 = 0 OR o_totalprice > 250000
) SELECT * FROM hashed WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM staged s WHERE NOT EXISTS (SELECT 1 FROM hashed h WHERE h.o_orderkey = s.o_orderkey AND h.o_orderstatus = 'F')""")
def insert_only_merge_orders(t: Tables) -> DataFrame:
    """The stored snapshot (finished orders) with the new keys of a reload: every third order, and
    large ones under new keys.  Rows that are stored already are staged with them and add nothing."""
    o = _orders(t.orders, "o_totalprice")
    large = F.col("o_totalprice") > 250000
    staged = o.where((F.col("o_orderkey") % 3 == 0) | large).withColumn("o_orderkey", F.col("o_orderkey") + F.when(large, 100_000_000).otherwise(0))
    return insert_only_merge(o.where("o_orderstatus = 'F'").drop("o_totalprice"), staged.drop("o_totalprice"), ["o_orderkey"], "row_hash")


@query("SELECT o_orderkey, sha256(concat_ws(chr(31), o_custkey, 'X', o_orderpriority)) AS row_hash FROM orders WHERE o_totalprice > 250000")
def immutability_conflicts(t: Tables) -> DataFrame:
    """Rows of a reload, in which large orders changed state, that contradict the stored ones."""
    staged = t.orders.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 250000, "X").otherwise(F.col("o_orderstatus")))
    digest = scalars.row_digest(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    return conflicts(_orders(t.orders), staged.select("o_orderkey", digest.alias("row_hash")), ["o_orderkey"], "row_hash")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_repeats,
 quantile_cont(l_quantity, 0.5) AS median_quantity, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99_price, quantile_disc(l_quantity, 0.9) AS p90_quantity, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem GROUP BY 1, 2""")
def quantile_qa(t: Tables) -> DataFrame:
    """Census and exact quantiles of each group, without a group in one place."""
    keys = ["l_returnflag", "l_linestatus"]
    census = t.lineitem.groupBy(*keys, "l_orderkey", "l_linenumber").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.sum("k").alias("n"), F.count("*").alias("n_keys"))
    linear = quantiles(t.lineitem, keys, "l_quantity", {"median_quantity": 0.5, "q1": 0.25, "q3": 0.75})
    discrete = quantiles(t.lineitem, keys, "l_quantity", {"p90_quantity": 0.9}, kind="discrete")
    price = quantiles(t.lineitem, keys, "l_extendedprice", {"p99_price": 0.99})
    joined = census.join(linear, keys).join(discrete, keys).join(price, keys)
    return joined.select(*keys, "n", "n_keys", (F.col("n") - F.col("n_keys")).alias("n_repeats"), "median_quantity", F.round("p99_price", 6).alias("p99_price"), "p90_quantity", (F.col("q3") - F.col("q1")).alias("iqr"))


@query()
def approximate_quantiles(t: Tables) -> DataFrame:
    """Bounded-memory quantiles of prices by year (a sketch: no SQL has the same values)."""
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.percentile_approx("l_extendedprice", [0.5, 0.99], 10_000).alias("quantiles"), F.count("*").alias("n"))


@query("""WITH v AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(l_quantity) FILTER (WHERE i = floor((n - 1) * 0.5)) AS p50, max(l_quantity) FILTER (WHERE i = floor((n - 1) * 0.9)) AS p90 FROM v GROUP BY 1""")
def nearest_rank_quantiles(t: Tables) -> DataFrame:
    """Quantiles by nearest lower rank, from counts by value: groups may be of any size."""
    return quantiles(t.lineitem, ["l_suppkey"], "l_quantity", {"p50": 0.5, "p90": 0.9}, kind="lower")


@query("SELECT l_suppkey, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM lineitem)::DOUBLE AS share FROM lineitem GROUP BY 1 HAVING count(*)::DOUBLE / (SELECT count(*) FROM lineitem)::DOUBLE >= 0.005")
def concentration_share(t: Tables) -> DataFrame:
    """Values that hold at least a given share of rows."""
    total = t.lineitem.agg(F.count("*").cast("double").alias("all"))
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("l_suppkey", "n", (F.col("n").cast("double") / F.col("all")).alias("share")).where("share >= 0.005")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_census(t: Tables) -> DataFrame:
    """Keys that are not unique."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, sha256(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS snapshot_id FROM orders GROUP BY 1")
def snapshot_hash_listagg(t: Tables) -> DataFrame:
    """Ordered distinct text of a group, and its hash."""
    text = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")
    return t.orders.groupBy("o_custkey").agg(text.alias("priorities")).withColumn("snapshot_id", F.sha2("priorities", 256))


@query("SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority, min(o_orderdate) AS first_date, count(*) AS n FROM orders GROUP BY 1")
def site_dedup_first_by_order(t: Tables) -> DataFrame:
    """The first record of each site by date and key."""
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"), F.min("o_orderdate").alias("first_date"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def window_dedupe(t: Tables) -> DataFrame:
    """One row of each group by a window's row number."""
    own = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t.orders.withColumn("k", F.row_number().over(own)).where("k = 1").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderdate::DATE <= DATE '2000-06-30' THEN round(date_diff('day', o_orderdate::DATE, DATE '2000-06-30') / 365.2425, 9) END AS age_years FROM orders")
def age_years(t: Tables) -> DataFrame:
    """Age at a snapshot; unknown for what came later."""
    snapshot = F.lit("2000-06-30").cast("date")
    return t.orders.select("o_orderkey", F.round(scalars.age_years(F.col("o_orderdate").cast("date"), snapshot), 9).alias("age_years"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, concat_ws(',', CASE WHEN l_shipdate > TIMESTAMP '2000-06-30' THEN 'FUTURE' END, CASE WHEN l_discount = 0 THEN 'NO_DISCOUNT' END,
  CASE WHEN l_quantity > 45 THEN 'OVERSIZE' END, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END) AS flags, CASE WHEN l_quantity > 0 AND l_discount = 0 THEN round(l_quantity * 0.0254, 9) END AS diameter_m FROM lineitem""")
def flags_array(t: Tables) -> DataFrame:
    """Sorted quality flags, and a measure under a rule with a unit."""
    f = scalars.flags(FUTURE=F.col("l_shipdate") > F.lit("2000-06-30").cast("timestamp"), NO_DISCOUNT=F.col("l_discount") == 0, OVERSIZE=F.col("l_quantity") > 45, RETURNED=F.col("l_returnflag") == "R")
    width = scalars.circular_diameter(F.col("l_quantity"), F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.array_join(f, ",").alias("flags"), F.round(scalars.metres(width, F.lit("1")), 9).alias("diameter_m"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' THEN 'OUT_OF_SCOPE' WHEN o_orderpriority NOT LIKE '1%' THEN 'OUT_OF_SCOPE' WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'APPROVED_NON_COMPLETE' ELSE 'OTHER' END AS phase FROM orders")
def phase_classify(t: Tables) -> DataFrame:
    """Phase by prefix and status."""
    return t.orders.select("o_orderkey", scalars.phase_group(F.col("o_orderpriority"), F.col("o_orderstatus"), "1", ["F"], ["O"]).alias("phase"))


@query("SELECT page_id, regexp_replace(lower(trim(url)), '^https?://(www\\.|m\\.)?', '') AS host_path, regexp_extract(url, '/([0-9]+)', 1) AS number, length(url) AS n FROM pages")
def normalize_text(t: Tables) -> DataFrame:
    """Keys from text: case, blanks and prefixes don't count."""
    return t.pages.select("page_id", F.regexp_replace(F.lower(F.trim("url")), r"^https?://(www\.|m\.)?", "").alias("host_path"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"), F.length("url").cast("long").alias("n"))


@query("SELECT doc_id, nfc_normalize(text) AS composed, length(nfc_normalize(text)) AS n FROM documents")
def unicode_form(t: Tables) -> DataFrame:
    """Compatibility form of every whole text (the given texts have no compatibility characters, so it is the composed form)."""
    composed = t.documents.select("doc_id", scalars.nfkc("text").alias("composed"))
    return composed.withColumn("n", F.length("composed").cast("long"))


@query("SELECT p_partkey, upper(p_name) || ' No ' || p_size AS plain, length(p_name)::BIGINT AS n FROM part")
def compatibility_form(t: Tables) -> DataFrame:
    """Compatibility characters (full-width letters and digits, a numero sign, an ideographic space)
    come back as plain ones."""
    ascii_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else chr(0x3000) for c in ascii_)
    text = F.concat(F.translate(F.upper("p_name"), ascii_, wide), F.lit("\u3000\u2116\u3000"), F.translate(F.col("p_size").cast("string"), ascii_, wide))
    return t.part.select("p_partkey", scalars.nfkc(text).alias("plain"), F.length("p_name").cast("long").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS n_sizes, count(*) FILTER (WHERE p_size > 25) AS n_large, sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END)::BIGINT AS size_large FROM part GROUP BY 1, 2")
def conditional_counts(t: Tables) -> DataFrame:
    """Conditional counts and sums."""
    return t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.countDistinct("p_size").alias("n_sizes"), F.count_if(F.col("p_size") > 25).alias("n_large"), F.sum(F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0)).alias("size_large"))


@query("SELECT l_suppkey, count(*) AS n_addresses, count(DISTINCT l_partkey) AS n_places, CASE WHEN count(DISTINCT l_partkey) = 1 THEN min(l_partkey) END AS place, CASE WHEN count(*) > 1 AND count(DISTINCT l_partkey) > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS state FROM lineitem GROUP BY 1")
def ambiguous_match(t: Tables) -> DataFrame:
    """A key matches only if all its rows name one place."""
    places = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n_addresses"), F.countDistinct("l_partkey").alias("n_places"), F.min("l_partkey").alias("least"))
    return places.select("l_suppkey", "n_addresses", "n_places", F.when(F.col("n_places") == 1, F.col("least")).alias("place"), F.when(F.col("n_places") > 1, "AMBIGUOUS").otherwise("MATCHED").alias("state"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, bool_and(value > 0) AS all_positive, round(corr(event_id, value), 6) AS correlation FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 1""")
def source_quality(t: Tables) -> DataFrame:
    """Source census by type."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.bool_and(F.col("value") > 0).alias("all_positive"), F.round(F.corr("event_id", "value"), 6).alias("correlation")).where("n_users >= 1")


@query("""SELECT event_id, (regexp_extract(props, '"k": *([0-9]+)', 1))::BIGINT AS k FROM events""")
def json_field(t: Tables) -> DataFrame:
    """A number inside JSON text."""
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH rows AS (SELECT o_orderstatus, o_orderkey, concat_ws(chr(31), o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_totalprice = 0 THEN '0.00' ELSE (round_even(o_totalprice::DECIMAL(18,6), 2)::DECIMAL(18,2))::VARCHAR END,
  CASE WHEN o_orderstatus = 'P' THEN chr(0) ELSE replace(o_orderpriority, '-', chr(30)) END) AS r FROM orders
), l0 AS (SELECT o_orderstatus, o_orderkey // 1024 AS k, count(*) AS n, sha256(string_agg(r, chr(10) ORDER BY o_orderkey)) AS d FROM rows GROUP BY 1, 2
), l1 AS (SELECT o_orderstatus, k // 1024 AS k, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY k)) AS d FROM l0 GROUP BY o_orderstatus, l0.k // 1024
), l2 AS (SELECT o_orderstatus, k // 1024 AS k, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY k)) AS d FROM l1 GROUP BY o_orderstatus, l1.k // 1024
), l3 AS (SELECT o_orderstatus, k // 1024 AS k, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY k)) AS d FROM l2 GROUP BY o_orderstatus, l2.k // 1024
) SELECT o_orderstatus, sum(n)::BIGINT AS n_rows, sha256(string_agg(d, chr(10) ORDER BY k)) AS table_sha256 FROM l3 GROUP BY 1""")
def canonical_table_hash(t: Tables) -> DataFrame:
    """Identity of each state's orders: rows by key, fields apart by a unit separator, lists by
    another, decimals with fixed places, nulls marked; pieces are hashed level by level."""
    parts = F.when(F.col("o_orderstatus") != "P", F.array_join(F.split("o_orderpriority", "-"), scalars.LIST_SEPARATOR))
    fields = (F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"), scalars.fixed_decimal(F.col("o_totalprice").cast("decimal(18,6)"), 2), parts)
    row = F.concat_ws(scalars.UNIT_SEPARATOR, *[F.coalesce(c, F.lit(scalars.NULL_MARK)) for c in fields])
    rows = t.orders.select("o_orderstatus", "o_orderkey", row.alias("row"))
    return scalars.digest_tree(rows, ["o_orderstatus"], "o_orderkey", "row", levels=3).withColumnRenamed("digest", "table_sha256")


@query("""SELECT p_partkey, coalesce(n_rows, 0) AS n_rows, coalesce(n_places, 0) AS n_places, CASE WHEN n_places = 1 THEN p END AS l_suppkey,
 CASE WHEN n_places IS NULL THEN 'UNMATCHED' WHEN n_places > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS state FROM part
 LEFT JOIN (SELECT l_partkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_places, min(l_suppkey) AS p FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def address_match(t: Tables) -> DataFrame:
    """Targets against all official points: matched, ambiguous or unmatched."""
    points = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return unambiguous_match(t.part.select("p_partkey"), points, ["p_partkey"], ["l_suppkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 5000")
def hash_sample(t: Tables) -> DataFrame:
    """A sample that depends on keys only (the limit is the operator)."""
    return t.orders.orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(5000).select("o_orderkey", "o_custkey")


def _sql_times(a: str, b: str) -> str:
    return f"(({a})::UHUGEINT * ({b})::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _sql_mixed(x: str) -> str:
    return f"xor({x}, {x} >> 47)"


_K = {k: f"{int(v)}::UBIGINT" for k, v in (("k0", fingerprint.K0), ("k2", fingerprint.K2))}
# Keys of up to seven digits: the fingerprint's classes of one to three and of four to seven bytes.
_SQL_FINGERPRINT = f"""keys AS (SELECT o_orderkey, o_custkey, o_orderkey::VARCHAR AS s, length(o_orderkey::VARCHAR) AS n FROM orders
), small AS (SELECT o_orderkey, xor({_sql_times("ascii(s[1]) + ascii(s[(n // 2 + 1)]) * 256", _K["k2"])}, {_sql_times("n + ascii(s[n]) * 4", _K["k0"])}) AS x FROM keys WHERE n < 4
), words AS (SELECT o_orderkey, n, ((n + (ascii(s[1]) + ascii(s[2]) * 256 + ascii(s[3]) * 65536 + ascii(s[4])::BIGINT * 16777216) * 8))::UBIGINT AS u,
    (ascii(s[n - 3]) + ascii(s[n - 2]) * 256 + ascii(s[n - 1]) * 65536 + ascii(s[n])::BIGINT * 16777216)::UBIGINT AS v, (({_K["k2"]})::UHUGEINT + (2 * n)::UHUGEINT) % 18446744073709551616::UHUGEINT AS f FROM keys WHERE n BETWEEN 4 AND 7
), first AS (SELECT o_orderkey, v, f, {_sql_times("xor(u, v)", "f")} AS a FROM words), second AS (SELECT o_orderkey, f, {_sql_times("xor(v, " + _sql_mixed("a") + ")", "f")} AS b FROM first
), prints AS (SELECT o_orderkey, {_sql_times(_sql_mixed("x"), _K["k2"])} AS h FROM small UNION ALL SELECT o_orderkey, {_sql_times(_sql_mixed("b"), "f")} FROM second
), signed AS (SELECT o_orderkey, o_custkey, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS fingerprint FROM prints JOIN keys USING (o_orderkey))"""


@query(f"WITH {_SQL_FINGERPRINT} SELECT * FROM signed ORDER BY fingerprint, o_orderkey LIMIT 5000")
def fingerprint_sample(t: Tables) -> DataFrame:
    """A sample by the public 64-bit fingerprint of the keys (the limit is the operator)."""
    printed = t.orders.select("o_orderkey", "o_custkey", fingerprint.farm_fingerprint(F.col("o_orderkey").cast("string")).alias("fingerprint"))
    return printed.orderBy("fingerprint", "o_orderkey").limit(5000)


@query("SELECT user_id, count(*) FILTER (WHERE event_id <= before) AS n_violations, count(*) AS n FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def order_violations(t: Tables) -> DataFrame:
    """Rows that break the strict order of keys in time."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lagged = t.events.select("user_id", "event_id", F.lag("event_id").over(own).alias("before"))
    return lagged.groupBy("user_id").agg(F.count_if(F.col("event_id") <= F.col("before")).alias("n_violations"), F.count("*").alias("n"))


@query("SELECT o_custkey, list_contains(list(DISTINCT o_orderpriority), '1-URGENT') AS urgent, len(list(DISTINCT o_orderstatus))::INTEGER AS n_states, count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F') AS n_open FROM orders GROUP BY 1")
def flag_membership(t: Tables) -> DataFrame:
    """Membership and size of array columns, null-safe comparison."""
    return t.orders.groupBy("o_custkey").agg(
        F.array_contains(F.collect_set("o_orderpriority"), "1-URGENT").alias("urgent"), F.size(F.collect_set("o_orderstatus")).alias("n_states"), F.count_if(~F.col("o_orderstatus").eqNullSafe(F.lit("F"))).alias("n_open")
    )


@query("SELECT * EXCLUDE (c_acctbal) REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND regexp_matches(c_name, '[0-9]+$')")
def parameterised_query(t: Tables) -> DataFrame:
    """SQL with named parameters: excluded and replaced columns, a range and a pattern."""
    return t.spark.sql(
        "SELECT c_custkey, c_name, c_nationkey, lower(c_mktsegment) AS c_mktsegment FROM {customers} WHERE c_acctbal BETWEEN :low AND :high AND c_name RLIKE :pattern",
        args={"low": 0, "high": 5000, "pattern": "[0-9]+$"}, customers=t.customer,
    )
