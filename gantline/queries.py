"""The operators as queries over the driver's tables, each with its SQL where SQL can express it.

Two generations are derived from a table by keys: the old one lacks keys divisible by 11, the new one those
divisible by 13, and in the new one a cell changes where the key is divisible by 7.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import page_queries
from .functions import columns as C
from .functions.sequences import lcs_length
from .operators import diff, graphs, groups, ledger
from .plans import calendars, report
from .sources.feed import Feed
from .sources.scratch import Scratch, global_rank

BANDS = ["05:00-07:00", "07:00-09:00", "09:00-16:00", "16:00-19:00", "19:00-22:00", "22:00-29:00"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    cells = lambda priority: [
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus",
        F.date_format("o_orderdate", "yyyyMMdd").alias("o_orderdate"), priority.alias("o_orderpriority"),
    ]
    k = F.col("o_orderkey")
    old = orders.filter(k % 11 != 0).select(*cells(F.col("o_orderpriority")))
    new = orders.filter(k % 13 != 0).select(*cells(F.when(k % 7 == 0, "0-CHANGED").otherwise(F.col("o_orderpriority"))))
    return old, new


def order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.keyed_diff(*order_generations(spark, sf_dir), ["o_orderkey"])


#: The same differences in SQL, as a CTE ``d``.
ORDER_DIFF = """
WITH old AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s, strftime(o_orderdate, '%Y%m%d') AS d, o_orderpriority AS p
             FROM orders WHERE o_orderkey % 11 <> 0),
new AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s, strftime(o_orderdate, '%Y%m%d') AS d,
             CASE WHEN o_orderkey % 7 = 0 THEN '0-CHANGED' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 13 <> 0),
d AS (
    SELECT 'row_removed' AS kind, o.k AS key, '' AS "column", CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value, 2 AS phase FROM old o ANTI JOIN new n ON o.k = n.k
    UNION ALL SELECT 'row_added', n.k, '', NULL, NULL, 3 FROM new n ANTI JOIN old o ON o.k = n.k
    UNION ALL SELECT 'field_changed', o.k, 'o_custkey', o.c, n.c, 4 FROM old o JOIN new n ON o.k = n.k WHERE o.c <> n.c
    UNION ALL SELECT 'field_changed', o.k, 'o_orderstatus', o.s, n.s, 4 FROM old o JOIN new n ON o.k = n.k WHERE o.s <> n.s
    UNION ALL SELECT 'field_changed', o.k, 'o_orderdate', o.d, n.d, 4 FROM old o JOIN new n ON o.k = n.k WHERE o.d <> n.d
    UNION ALL SELECT 'field_changed', o.k, 'o_orderpriority', o.p, n.p, 4 FROM old o JOIN new n ON o.k = n.k WHERE o.p <> n.p
)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(page_queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(page_queries.ORACLE_SQL)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(ORDER_DIFF + """ SELECT key AS o_orderkey, "column", old_value, new_value FROM d WHERE kind = 'field_changed'""")
def keyed_diff_cells(spark, sf_dir):
    return order_diff(spark, sf_dir).filter("kind = 'field_changed'").select(F.col("key")[0].alias("o_orderkey"), "column", "old_value", "new_value")


@query(ORDER_DIFF + " SELECT kind, key AS o_orderkey FROM d WHERE kind <> 'field_changed'")
def keyed_diff_rows(spark, sf_dir):
    return order_diff(spark, sf_dir).filter("kind <> 'field_changed'").select("kind", F.col("key")[0].alias("o_orderkey"))


@query(ORDER_DIFF + " SELECT kind, count(*) AS n FROM d GROUP BY kind")
def diff_count_by_kind(spark, sf_dir):
    return diff.count_by(order_diff(spark, sf_dir), "kind")


@query(ORDER_DIFF + """ SELECT printf('rawdiff_%06d', row_number() OVER (ORDER BY phase, key, "column")) AS rawdiff_id, kind, key AS o_orderkey, "column" FROM d""")
def rawdiff_ids(spark, sf_dir):
    ranked = global_rank(order_diff(spark, sf_dir), Scratch(spark, "ids"), [F.col("phase"), F.col("sort"), F.col("column")])
    return ranked.select(F.format_string("rawdiff_%06d", F.col("rank") + 1).alias("rawdiff_id"), "kind", F.col("key")[0].alias("o_orderkey"), "column")


LINES = ["l_linenumber", "l_linestatus", "l_returnflag"]


@query("""
WITH counted AS (
    SELECT concat_ws(chr(31), CAST(l_linenumber AS VARCHAR), l_linestatus, l_returnflag) AS row, concat_ws(',', CAST(l_linenumber AS VARCHAR), l_linestatus, l_returnflag) AS value,
           sum(CASE WHEN l_orderkey % 13 <> 0 THEN 1 ELSE 0 END) - sum(CASE WHEN l_orderkey % 11 <> 0 THEN 1 ELSE 0 END) AS n
    FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN n < 0 THEN 'row_removed' ELSE 'row_added' END AS kind, substr(sha1(row), 1, 12) AS digest, CAST(i AS VARCHAR) AS occurrence, value
FROM (SELECT *, unnest(range(abs(n)::BIGINT)) AS i FROM counted)""")
def multiset_diff(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINES)
    found = diff.multiset_diff(lines.filter("l_orderkey % 11 <> 0"), lines.filter("l_orderkey % 13 <> 0"), LINES)
    return found.select("kind", F.col("key")[0].alias("digest"), F.col("key")[1].alias("occurrence"), F.coalesce("old_value", "new_value").alias("value"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), o AS (SELECT * FROM l WHERE l_orderkey % 11 <> 0),
n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM l WHERE l_orderkey % 13 <> 0)
SELECT 'rows_removed_bulk' AS kind, CAST(count(*) AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM o ANTI JOIN n USING (l_orderkey, l_linenumber)
UNION ALL SELECT 'rows_added_bulk', NULL, CAST(count(*) AS VARCHAR) FROM n ANTI JOIN o USING (l_orderkey, l_linenumber)
UNION ALL SELECT 'rows_changed_bulk', CAST(count(*) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM o JOIN n USING (l_orderkey, l_linenumber) WHERE o.l_returnflag <> n.l_returnflag""")
def bulk_collapse(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    new = lines.filter("l_orderkey % 13 <> 0").withColumn("l_returnflag", F.when(F.expr("l_orderkey % 7 = 0"), "X").otherwise(F.col("l_returnflag")))
    found = diff.keyed_diff(lines.filter("l_orderkey % 11 <> 0"), new, ["l_orderkey", "l_linenumber"], ["l_returnflag"])
    return diff.collapse(found, 100, Scratch(spark, "bulk")).select("kind", "old_value", "new_value")


@query("""
WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
span AS (SELECT user_id, min(day) AS lo, max(day) AS hi, count(*) AS n FROM days GROUP BY user_id),
hits AS (SELECT user_id, isodow(day) AS w, count(*) AS hit FROM days GROUP BY ALL),
totals AS (SELECT user_id, w, greatest(0, floor((date_diff('day', lo, hi) - (w - isodow(lo) + 7) % 7) / 7.0) + 1) AS total FROM span, range(1, 8) r(w)),
cov AS (SELECT t.user_id, t.w, coalesce(hit, 0) AS hit, CASE WHEN total > 0 THEN coalesce(hit, 0) / total ELSE 0 END AS cov FROM totals t LEFT JOIN hits h ON h.user_id = t.user_id AND h.w = t.w),
prof AS (SELECT c.user_id, s.n, string_agg(CASE WHEN cov >= 0.6 THEN '1' ELSE '0' END, '' ORDER BY w) AS flags, sum(CASE WHEN cov >= 0.6 THEN 0 ELSE hit END) / any_value(s.n) AS stray, min(cov) AS least,
           sum(CASE WHEN w <= 5 THEN hit ELSE 0 END) AS wk, sum(CASE WHEN w = 6 THEN hit ELSE 0 END) AS sa, sum(CASE WHEN w = 7 THEN hit ELSE 0 END) AS su
         FROM cov c JOIN span s ON s.user_id = c.user_id GROUP BY c.user_id, s.n)
SELECT user_id, CAST(n AS BIGINT) AS days, CASE WHEN n <= 10 THEN 'irregular'
    WHEN flags <> '0000000' AND stray <= 0.1 AND NOT (flags = '1111111' AND least < 0.9) THEN
        CASE flags WHEN '1111100' THEN 'weekday' WHEN '1111111' THEN 'daily' WHEN '0000011' THEN 'weekend' WHEN '0000010' THEN 'saturday' WHEN '0000001' THEN 'sunday_holiday' ELSE 'dow_' || flags END
    WHEN greatest(wk, sa, su) / n >= 0.8 THEN CASE WHEN wk >= sa AND wk >= su THEN 'weekday' WHEN sa >= su THEN 'saturday' ELSE 'sunday_holiday' END
    ELSE 'irregular' END AS day_type FROM prof""")
def day_label(spark, sf_dir):
    from .plans.calendars import label_dates

    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return label_dates(days, ["user_id"]).select("user_id", "days", "day_type")


@query("""
WITH days AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
runs AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY o_custkey, year(day) ORDER BY day) AS INTEGER) AS run FROM days)
SELECT o_custkey, min(day) AS "start", max(day) AS "end", count(*) AS days FROM runs GROUP BY o_custkey, year(day), run""")
def date_runs_orders(spark, sf_dir):
    return graphs.date_runs(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey"])


@query("""
WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
runs AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id, year(day) ORDER BY day) AS INTEGER) AS run FROM days)
SELECT user_id, min(day) AS "start", max(day) AS "end", count(*) AS days FROM runs GROUP BY user_id, year(day), run""")
def date_runs(spark, sf_dir):
    return graphs.date_runs(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id"])


@query("""
WITH months AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders), spans AS (SELECT CAST(m AS DATE) AS lo, CAST(m + INTERVAL 14 DAY AS DATE) AS hi FROM months)
SELECT lo, hi, count(DISTINCT o_custkey) AS customers FROM spans JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN lo AND hi GROUP BY lo, hi""")
def active_interval(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    spans = orders.select(F.trunc("day", "month").alias("lo")).distinct().withColumn("hi", F.date_add("lo", 14))
    # A customer is a service that runs on the days of its orders, as a feed would tell it.
    dates = orders.select(F.col("o_custkey").cast("string").alias("service_id"), F.date_format("day", "yyyyMMdd").alias("date"), F.lit("1").alias("exception_type"))
    return calendars.active_services(Feed({"calendar_dates": dates}, spark), spans).groupBy("lo", "hi").agg(F.count("*").alias("customers"))


@query("""
WITH t AS (SELECT event_type, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events)
SELECT event_type, CASE WHEN s >= 18000 AND s < 25200 THEN '05:00-07:00' WHEN s >= 25200 AND s < 32400 THEN '07:00-09:00' WHEN s >= 32400 AND s < 57600 THEN '09:00-16:00'
    WHEN s >= 57600 AND s < 68400 THEN '16:00-19:00' WHEN s >= 68400 AND s < 79200 THEN '19:00-22:00' WHEN s >= 79200 OR s < 18000 THEN '22:00-29:00' ELSE 'other' END AS band, count(*) AS n
FROM t GROUP BY ALL""")
def time_band_counts(spark, sf_dir):
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").groupBy("event_type", C.time_band(seconds, BANDS).alias("band")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT user_id, CAST(ts AS DATE) < DATE '2024-01-16' AS old, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS m FROM events),
b AS (SELECT user_id, min(m) FILTER (WHERE old) AS old_first, max(m) FILTER (WHERE old) AS old_last, min(m) FILTER (WHERE NOT old) AS new_first, max(m) FILTER (WHERE NOT old) AS new_last FROM t GROUP BY user_id)
SELECT user_id, old_first, old_last, new_first, new_last FROM b WHERE abs(new_first - old_first) >= 15 OR abs(new_last - old_last) >= 15""")
def first_last_departure(spark, sf_dir):
    m = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    old = F.to_date("ts") < F.lit("2024-01-16").cast("date")
    return groups.moved_ends(table(spark, sf_dir, "events").groupBy("user_id").agg(*groups.ends(m, old)), 15)


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
ends AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (
    SELECT a, a FROM ends GROUP BY a
    UNION
    (SELECT b, min(cc.component) FROM cc JOIN ends ON ends.a = cc.node JOIN recurring.cc AS k ON k.node = ends.b WHERE cc.component < k.component GROUP BY ends.b))
SELECT node, component FROM cc""")
def family_components(spark, sf_dir):
    """The components of all customers and parts that orders join."""
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = pairs.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return graphs.components(edges, Scratch(spark, "components"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey, l_orderkey % 2 AS side, l_partkey FROM lineitem), n AS (SELECT l_suppkey, side, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS common FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT a, b, common, round(common / (x.n + y.n - common), 6) AS jaccard FROM m JOIN n x ON x.l_suppkey = a AND x.side = 0 JOIN n y ON y.l_suppkey = b AND y.side = 1
WHERE 20 * common >= x.n + y.n - common""")
def set_jaccard_link(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    sets = lines.select(F.when(F.expr("l_orderkey % 2 = 0"), "old").otherwise("new").alias("side"), F.col("l_suppkey").alias("name"), F.col("l_partkey").alias("item"))
    return graphs.set_jaccard(sets, 0.05).select("a", "b", F.col("both").alias("common"), F.round("jaccard", 6).alias("jaccard"))


@query("""
WITH p AS (SELECT s_suppkey, 35 + (s_suppkey * 7919 % 1000) / 50000.0 AS lat, 139 + (s_suppkey * 104729 % 1000) / 50000.0 AS lon FROM supplier),
d AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS m,
      abs(CAST(floor(a.lat / (300 / 111000.0)) AS BIGINT) - CAST(floor(b.lat / (300 / 111000.0)) AS BIGINT)) AS dy, abs(CAST(floor(a.lon / (300 / 111000.0)) AS BIGINT) - CAST(floor(b.lon / (300 / 111000.0)) AS BIGINT)) AS dx
      FROM p a JOIN p b ON a.s_suppkey % 2 = 1 AND b.s_suppkey % 2 = 0)
SELECT a, b, round(m, 1) AS metres FROM d WHERE m <= 300 AND dy <= 1 AND dx <= 1""")
def grid_radius_link(spark, sf_dir):
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k, (35 + (k * 7919 % 1000) / 50000.0).alias("lat"), (139 + (k * 104729 % 1000) / 50000.0).alias("lon"))
    left = points.filter("s_suppkey % 2 = 1").withColumnRenamed("s_suppkey", "a")
    right = points.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return graphs.near_pairs(left, right, 300 / 111000.0, 300, Scratch(spark, "near")).select("a", "b", F.round("metres", 1).alias("metres"))


def user_days(spark, sf_dir) -> DataFrame:
    """(user_id, day, seq): the event types of each user's day in order."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", "event_type").alias("e"))
    return events.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["event_type"]).alias("seq"))


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, '>' ORDER BY ts, event_id) AS pattern FROM events GROUP BY ALL)
SELECT pattern, count(*) AS user_days FROM s GROUP BY pattern""")
def sequence_patterns(spark, sf_dir):
    return user_days(spark, sf_dir).groupBy(F.array_join("seq", ">").alias("pattern")).agg(F.count("*").alias("user_days"))


@query()
def lcs_similarity(spark, sf_dir):
    """How alike each user's day is to the next one that has events. Distinct pairs of sequences are compared once."""
    nxt = F.lead("seq").over(Window.partitionBy("user_id").orderBy("day"))
    pairs = user_days(spark, sf_dir).withColumn("after", nxt).filter("after IS NOT NULL")

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    scored = pairs.select("seq", "after").distinct().withColumn("lcs", common("seq", "after"))
    ratio = F.col("lcs") / F.greatest(F.size("seq"), F.size("after"))
    return pairs.join(scored, ["seq", "after"]).select("user_id", "day", "lcs", F.round(ratio, 6).alias("ratio"))


@query("""
WITH o AS MATERIALIZED (SELECT l_partkey % 100 AS part, l_returnflag, l_linestatus, l_linenumber, l_orderkey,
    row_number() OVER (PARTITION BY l_partkey % 100, l_returnflag, l_linestatus, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_orderkey % 2 = 0),
n AS MATERIALIZED (SELECT l_partkey % 100 AS part, l_returnflag, l_linestatus, l_linenumber, l_orderkey,
    row_number() OVER (PARTITION BY l_partkey % 100, l_returnflag, l_linestatus, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT part, l_returnflag, l_linestatus, l_linenumber, o.l_orderkey AS old_order, n.l_orderkey AS new_order FROM o JOIN n USING (part, l_returnflag, l_linestatus, l_linenumber, i)""")
def exact_signature_pairs(spark, sf_dir):
    by = ["part", "l_returnflag", "l_linestatus", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(F.expr("l_partkey % 100").alias("part"), *by[1:], "l_orderkey", "l_partkey", "l_suppkey")
    side = lambda r, name: lines.filter(F.expr(f"l_orderkey % 2 = {r}")).select(*by, F.col("l_orderkey").alias(f"{name}_order"), F.col("l_partkey").alias(f"{name}_part"), F.col("l_suppkey").alias(f"{name}_supp"))
    order = lambda n: [f"{n}_order", f"{n}_part", f"{n}_supp"]
    return diff.rank_zip(side(0, "old"), side(1, "new"), by, order("old"), order("new")).select(*by, "old_order", "new_order")


@query()
def greedy_assignment(spark, sf_dir):
    """A customer's even orders against its odd ones, cheapest pairs first: days apart, then price apart."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block"), "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    side = lambda r, n: orders.filter(F.expr(f"o_orderkey % 2 = {r}")).select("block", F.col("o_orderkey").alias(f"{n}_id"), F.col("day").alias(f"{n}_day"), F.col("o_totalprice").alias(f"{n}_price"))
    pairs = side(0, "old").join(side(1, "new"), "block")
    cost = pairs.select("block", "old_id", "new_id", F.abs(F.datediff("new_day", "old_day")).alias("days"), F.round(F.abs(F.col("new_price") - F.col("old_price")), 2).alias("price")).filter("days <= 365")
    return graphs.greedy_assignment(cost, Scratch(spark, "assignment"), ["days", "price"])


def order_claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Differences of the generations with ids, and what three events in turn claim of them."""
    ids = order_diff(spark, sf_dir).select(F.concat_ws("|", "kind", F.col("key")[0], "column").alias("rawdiff_id"), "kind", F.col("key")[0].cast("long").alias("k"), "column")
    claim = lambda seq, name, what: ids.filter(what).select("rawdiff_id", F.lit(seq).alias("event_seq"), F.lit(name).alias("event_id"))
    claims = claim(1, "EVEN", "k % 2 = 0 AND kind <> 'row_added'").unionByName(claim(2, "PRIORITY", "column = 'o_orderpriority'")).unionByName(claim(3, "REMOVED", "kind = 'row_removed' AND k % 5 = 0"))
    return ids, claims


CLAIMS = ORDER_DIFF + """,
ids AS (SELECT kind || '|' || key || '|' || "column" AS rawdiff_id, kind, CAST(key AS BIGINT) AS k, "column" AS col FROM d),
claims AS (SELECT rawdiff_id, 1 AS event_seq, 'EVEN' AS event_id FROM ids WHERE k % 2 = 0 AND kind <> 'row_added' UNION ALL SELECT rawdiff_id, 2, 'PRIORITY' FROM ids WHERE col = 'o_orderpriority'
           UNION ALL SELECT rawdiff_id, 3, 'REMOVED' FROM ids WHERE kind = 'row_removed' AND k % 5 = 0)"""


@query(CLAIMS + " SELECT rawdiff_id, arg_min(event_id, event_seq) AS event_id FROM claims GROUP BY rawdiff_id")
def evidence_first_claim(spark, sf_dir):
    return ledger.primary(order_claims(spark, sf_dir)[1])


@query(CLAIMS + " SELECT kind, count(*) AS residual FROM ids ANTI JOIN claims USING (rawdiff_id) GROUP BY kind")
def residual_by_group(spark, sf_dir):
    return ledger.residual_by(*order_claims(spark, sf_dir), "kind")


@query(CLAIMS + " SELECT count(*) AS total, count(c.rawdiff_id) AS explained, round(count(c.rawdiff_id) / count(*), 6) AS ratio FROM ids LEFT JOIN (SELECT DISTINCT rawdiff_id FROM claims) c USING (rawdiff_id)")
def explained_ratio(spark, sf_dir):
    return ledger.accounting(*order_claims(spark, sf_dir)).select("total", "explained", F.round("ratio", 6).alias("ratio"))


@query("""
WITH g AS (SELECT lag(event_type) OVER w AS a, event_type AS b, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER w)) AS BIGINT) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a AS from_type, b AS to_type, count(*) AS n, CAST(floor(median(gap)) AS BIGINT) AS median_s, list_sort(list(gap))[CAST(least(count(*), floor(0.9 * count(*)) + 1) AS BIGINT)] AS p90_s FROM g WHERE a IS NOT NULL GROUP BY a, b""")
def segment_stats(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_timestamp(F.date_trunc("second", "ts"))
    gaps = table(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("from_type"), F.col("event_type").alias("to_type"), (seconds - F.lag(seconds).over(w)).alias("gap")).filter("from_type IS NOT NULL")
    return groups.middle_and_rank(gaps, ["from_type", "to_type"], "gap").select("from_type", "to_type", "n", F.floor("middle").cast("long").alias("median_s"), F.col("ranked").alias("p90_s"))


@query("""
WITH m AS (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE)) AS delta FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)
SELECT o_orderpriority, count(*) AS n, round(avg(delta), 6) AS mean_days, round(stddev_pop(delta), 6) AS spread_days, stddev_pop(delta) <= 2 AS uniform FROM m GROUP BY o_orderpriority""")
def uniform_shift(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    moved = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate").join(first, "o_orderkey").withColumn("delta", F.datediff(F.to_date("shipped"), F.to_date("o_orderdate")))
    spread = F.stddev_pop("delta")
    return moved.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_days"), F.round(spread, 6).alias("spread_days"), (spread <= 2).alias("uniform"))


@query("""
WITH m AS (SELECT o_orderkey, count(*) AS n, avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS mean, stddev_pop(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS spread
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, n, round(mean, 4) AS mean_days, round(spread, 4) AS spread_days, spread <= 20 AS uniform FROM m""")
def order_shift(spark, sf_dir):
    """How evenly an order's lines are moved from its date, as a trip's times are."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("shipped"))
    moved = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(lines, "o_orderkey")
    shifts = moved.groupBy("o_orderkey").agg(F.collect_list(F.datediff("shipped", "day")).alias("shift"))
    mean, spread = groups.mean_and_spread(F.col("shift"))
    return shifts.select("o_orderkey", F.size("shift").cast("long").alias("n"), F.round(mean, 4).alias("mean_days"), F.round(spread, 4).alias("spread_days"), (spread <= 20).alias("uniform"))


@query("""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus), (l_returnflag))""")
def subtotals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    sets = [["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag", "l_linestatus"], ["l_returnflag"]]
    return groups.subtotals(lines, sets, F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""
SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 20""")
def topk_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    found = diff.top_k(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], order, 20)
    return found.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query(ORDER_DIFF + """
SELECT o.k AS old_id, n.k AS new_id, CASE WHEN n.k IS NULL THEN 'removed' WHEN o.k IS NULL THEN 'added' WHEN o.p <> n.p THEN 'modified' ELSE 'exact' END AS relation FROM old o FULL JOIN new n ON o.k = n.k""")
def id_mapping(spark, sf_dir):
    old, new = order_generations(spark, sf_dir)
    pairs = old.alias("o").join(new.alias("n"), "o_orderkey").select(
        F.col("o_orderkey").alias("old_id"), F.col("o_orderkey").alias("new_id"), F.when(F.col("o.o_orderpriority") != F.col("n.o_orderpriority"), "modified").otherwise("exact").alias("relation"), F.lit(1.0).alias("confidence")
    )
    gone, come = (a.join(b, "o_orderkey", "left_anti").select("o_orderkey") for a, b in ((old, new), (new, old)))
    return report.id_rows("order", pairs, gone, come).select(F.get("old_ids", F.lit(0)).alias("old_id"), F.get("new_ids", F.lit(0)).alias("new_id"), "relation")


@query("""
WITH m AS (SELECT event_id, user_id, event_type, value, count(*) OVER () AS matched FROM events WHERE event_type LIKE '%c%' AND value > 10)
SELECT event_id, user_id, event_type, value, matched FROM m ORDER BY value DESC, event_id LIMIT 200""")
def events_filter_search(spark, sf_dir):
    """The first 200 of what a filter finds, in a total order, and how many there are."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return groups.search(events, [F.col("event_type").contains("c"), F.col("value") > 10], [F.desc("value"), F.col("event_id")], 200).drop("total")
