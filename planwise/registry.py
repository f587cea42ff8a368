"""Registered queries: each Spark query next to its DuckDB oracle SQL.

Every query reads the driver's tables (or data Spark derives from them) in
full.  ``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the
equivalent SQL over views named like the tables.  Values that are sums of
money are rounded to cents and means/ratios to 6 decimals in *both* engines,
so floating-point summation order cannot change the compared digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.dataset import Dataset
from planwise.plans.compile import compile_plan
from planwise.plans.plan import Filter, Plan
from planwise.sources.parquet import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, name: str, derive: dict | None = None) -> Dataset:
    df = table(spark, sf_dir, name)
    if derive:
        df = df.select("*", *[expr.alias(col) for col, expr in derive.items()])
    return Dataset.from_frame(df, source=name)


def plan_query(name: str, tbl: str, plan: Plan, sql: str, decimals: int | None = None,
               derive: Callable[[], dict] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = dataset(spark, sf_dir, tbl, derive() if derive else None)
        return compile_plan(ds, plan, decimals=decimals).df
    register(name, sql)(run)


# ---------------------------------------------------------------- flagship
FLAGSHIP = Plan(
    goal="monthly revenue by return flag",
    group_by=("l_shipdate", "l_returnflag"),
    metric="l_extendedprice",
    aggregation="sum",
    time_grain="month",
    sort="label",
)
plan_query("plan_monthly_revenue", "lineitem", FLAGSHIP, """
SELECT strftime(l_shipdate, '%Y-%m') AS l_shipdate, l_returnflag,
       round(sum(l_extendedprice), 2) AS value
FROM lineitem GROUP BY 1, 2
""", decimals=2)


# ---------------------------------------------------------------- filters
def _nullable_lineitem() -> dict:
    # Manufactured nulls: zero discounts and return flag 'A' become null.
    return {"l_discount_n": F.nullif(F.col("l_discount"), F.lit(0.0)),
            "l_returnflag_n": F.nullif(F.col("l_returnflag"), F.lit("A"))}


NULLABLE_LINEITEM_SQL = ("(SELECT *, nullif(l_discount, 0.0) AS l_discount_n, "
                         "nullif(l_returnflag, 'A') AS l_returnflag_n FROM lineitem)")

plan_query("flt_eq", "lineitem",
           Plan(group_by=("l_linestatus",), metric="l_quantity", filters=(Filter("l_returnflag", "eq", "R"),)),
           "SELECT l_linestatus, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
plan_query("flt_ne_null_number", "lineitem",
           Plan(group_by=("l_returnflag",), aggregation="count",
                filters=(Filter("l_discount_n", "ne", 0.05),)),
           f"SELECT l_returnflag, count(*) AS value FROM {NULLABLE_LINEITEM_SQL} "
           "WHERE l_discount_n IS DISTINCT FROM 0.05 GROUP BY 1",
           derive=_nullable_lineitem)
plan_query("flt_ne_null_string", "lineitem",
           Plan(group_by=("l_linestatus",), aggregation="count",
                filters=(Filter("l_returnflag_n", "ne", "N"),)),
           f"SELECT l_linestatus, count(*) AS value FROM {NULLABLE_LINEITEM_SQL} "
           "WHERE l_returnflag_n <> 'N' GROUP BY 1",
           derive=_nullable_lineitem)
plan_query("flt_gt", "lineitem",
           Plan(group_by=("l_returnflag",), metric="l_extendedprice", filters=(Filter("l_quantity", "gt", 30),)),
           "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS value FROM lineitem "
           "WHERE l_quantity > 30 GROUP BY 1", decimals=2)
plan_query("flt_gte", "lineitem",
           Plan(group_by=("l_returnflag",), aggregation="count", filters=(Filter("l_quantity", "gte", 30),)),
           "SELECT l_returnflag, count(*) AS value FROM lineitem WHERE l_quantity >= 30 GROUP BY 1")
plan_query("flt_lt_date", "lineitem",
           Plan(group_by=("l_linestatus",), aggregation="count", filters=(Filter("l_shipdate", "lt", "1997-01-01"),)),
           "SELECT l_linestatus, count(*) AS value FROM lineitem "
           "WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1")
plan_query("flt_lte", "lineitem",
           Plan(group_by=("l_linestatus",), metric="l_tax", aggregation="mean",
                filters=(Filter("l_discount", "lte", 0.03),)),
           "SELECT l_linestatus, round(avg(l_tax), 6) AS value FROM lineitem WHERE l_discount <= 0.03 GROUP BY 1",
           decimals=6)
plan_query("flt_contains", "orders",
           Plan(group_by=("o_orderstatus",), aggregation="count",
                filters=(Filter("o_orderpriority", "contains", "URG"),)),
           "SELECT o_orderstatus, count(*) AS value FROM orders "
           "WHERE contains(o_orderpriority, 'URG') GROUP BY 1")
plan_query("flt_contains_number", "orders",
           Plan(group_by=("o_orderpriority",), aggregation="count",
                filters=(Filter("o_orderkey", "contains", "77"),)),
           "SELECT o_orderpriority, count(*) AS value FROM orders "
           "WHERE contains(CAST(o_orderkey AS VARCHAR), '77') GROUP BY 1")
plan_query("flt_in", "orders",
           Plan(group_by=("o_orderstatus",), metric="o_totalprice",
                filters=(Filter("o_orderpriority", "in", ["1-URGENT", "5-LOW"]),)),
           "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS value FROM orders "
           "WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1", decimals=2)
plan_query("flt_in_date", "orders",
           Plan(group_by=("o_orderstatus",), aggregation="count",
                filters=(Filter("o_orderdate", "in", ["1996-01-01", "1997-03-15", "1999-12-31"]),)),
           "SELECT o_orderstatus, count(*) AS value FROM orders WHERE o_orderdate IN "
           "(TIMESTAMP '1996-01-01', TIMESTAMP '1997-03-15', TIMESTAMP '1999-12-31') GROUP BY 1")
plan_query("flt_conjunction", "lineitem",
           Plan(group_by=("l_returnflag", "l_linestatus"), metric="l_quantity",
                filters=(Filter("l_shipdate", "gte", "1996-01-01"), Filter("l_shipdate", "lt", "1998-01-01"),
                         Filter("l_discount", "gt", 0.02), Filter("l_returnflag", "ne", "N"))),
           "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS value FROM lineitem "
           "WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' "
           "AND l_discount > 0.02 AND l_returnflag <> 'N' GROUP BY 1, 2")

# ---------------------------------------------------------------- aggregations
KEYS2 = ("l_returnflag", "l_linestatus")
plan_query("agg_sum", "lineitem", Plan(group_by=KEYS2, metric="l_extendedprice"),
           "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS value "
           "FROM lineitem GROUP BY 1, 2", decimals=2)
plan_query("agg_mean", "lineitem", Plan(group_by=KEYS2, metric="l_extendedprice", aggregation="mean"),
           "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS value "
           "FROM lineitem GROUP BY 1, 2", decimals=6)
plan_query("agg_min", "lineitem", Plan(group_by=KEYS2, metric="l_extendedprice", aggregation="min"),
           "SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2")
plan_query("agg_max", "lineitem", Plan(group_by=KEYS2, metric="l_extendedprice", aggregation="max"),
           "SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2")
plan_query("agg_count", "lineitem", Plan(group_by=KEYS2, aggregation="count"),
           "SELECT l_returnflag, l_linestatus, count(*) AS value FROM lineitem GROUP BY 1, 2")
plan_query("agg_ratio_total", "lineitem",
           Plan(group_by=KEYS2, metric="l_extendedprice", denominator="l_quantity", aggregation="ratio_total"),
           "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 6) AS value "
           "FROM lineitem GROUP BY 1, 2", decimals=6)
plan_query("agg_ratio_mean", "lineitem",
           Plan(group_by=KEYS2, metric="l_extendedprice", denominator="l_quantity", aggregation="ratio_mean"),
           "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice / l_quantity), 6) AS value "
           "FROM lineitem GROUP BY 1, 2", decimals=6)
plan_query("agg_raw", "lineitem",
           Plan(group_by=("l_orderkey", "l_linenumber"), metric="l_extendedprice", aggregation="raw"),
           "SELECT l_orderkey, l_linenumber, l_extendedprice AS value FROM lineitem")
plan_query("agg_global", "lineitem", Plan(metric="l_quantity"),
           "SELECT 'All / 全部' AS _all, sum(l_quantity) AS value FROM lineitem")
plan_query("agg_3keys", "lineitem",
           Plan(group_by=("l_returnflag", "l_linestatus", "l_linenumber"), aggregation="count"),
           "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS value FROM lineitem GROUP BY 1, 2, 3")
plan_query("agg_null_key", "lineitem",
           Plan(group_by=("l_returnflag_n",), metric="l_quantity", aggregation="mean", missing="keep"),
           f"SELECT l_returnflag_n, round(avg(l_quantity), 6) AS value FROM {NULLABLE_LINEITEM_SQL} GROUP BY 1",
           decimals=6, derive=_nullable_lineitem)

# ---------------------------------------------------------------- missing values, duplicates
plan_query("missing_exclude", "lineitem",
           Plan(group_by=("l_returnflag",), metric="l_discount_n", aggregation="mean", missing="exclude"),
           f"SELECT l_returnflag, round(avg(l_discount_n), 6) AS value FROM {NULLABLE_LINEITEM_SQL} "
           "WHERE l_discount_n IS NOT NULL GROUP BY 1", decimals=6, derive=_nullable_lineitem)
plan_query("missing_keep", "lineitem",
           Plan(group_by=("l_returnflag_n", "l_linestatus"), metric="l_discount_n", missing="keep"),
           f"SELECT l_returnflag_n, l_linestatus, round(sum(l_discount_n), 2) AS value "
           f"FROM {NULLABLE_LINEITEM_SQL} GROUP BY 1, 2", decimals=2, derive=_nullable_lineitem)
plan_query("missing_keep_count", "lineitem",
           Plan(group_by=("l_returnflag_n",), aggregation="count", missing="keep"),
           f"SELECT l_returnflag_n, count(*) AS value FROM {NULLABLE_LINEITEM_SQL} GROUP BY 1",
           derive=_nullable_lineitem)


def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    ds = Dataset.from_frame(df, source="lineitem")
    plan = Plan(group_by=("l_returnflag",), metric="l_quantity", duplicates="drop_exact")
    return compile_plan(ds, plan).df


register("dedupe_exact", """
SELECT l_returnflag, sum(l_quantity) AS value
FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem) GROUP BY 1
""")(_dedupe)

# ---------------------------------------------------------------- time buckets
plan_query("grain_day", "events", Plan(group_by=("ts",), aggregation="count", time_grain="day"),
           "SELECT strftime(ts, '%Y-%m-%d') AS ts, count(*) AS value FROM events GROUP BY 1")
plan_query("grain_week", "events",
           Plan(group_by=("ts", "event_type"), metric="value", time_grain="week", sort="label"),
           "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || "
           "strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS ts, event_type, "
           "round(sum(value), 2) AS value FROM events GROUP BY 1, 2", decimals=2)
plan_query("grain_month", "orders",
           Plan(group_by=("o_orderdate",), metric="o_totalprice", time_grain="month", sort="label"),
           "SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, round(sum(o_totalprice), 2) AS value "
           "FROM orders GROUP BY 1", decimals=2)
plan_query("grain_year", "orders",
           Plan(group_by=("o_orderdate", "o_orderstatus"), aggregation="count", time_grain="year"),
           "SELECT strftime(o_orderdate, '%Y') AS o_orderdate, o_orderstatus, count(*) AS value "
           "FROM orders GROUP BY 1, 2")

# ---------------------------------------------------------------- sorts (O1-O2)
plan_query("sort_desc", "orders",
           Plan(group_by=("o_orderpriority",), metric="o_totalprice", sort="desc"),
           "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1", decimals=2)
plan_query("sort_asc", "orders",
           Plan(group_by=("o_custkey",), metric="o_totalprice", aggregation="max", sort="asc"),
           "SELECT o_custkey, max(o_totalprice) AS value FROM orders GROUP BY 1")
plan_query("sort_label", "customer",
           Plan(group_by=("c_mktsegment",), metric="c_acctbal", aggregation="mean", sort="label"),
           "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS value FROM customer GROUP BY 1", decimals=6)


# ---------------------------------------------------------------- top-k evidence
def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import top_evidence
    res = compile_plan(dataset(spark, sf_dir, "orders"),
                       Plan(group_by=("o_custkey",), metric="o_totalprice"), decimals=2).df
    return top_evidence(res, "value", ["o_custkey"])


register("top_evidence", """
WITH r AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1),
     t AS (SELECT count(*) AS total_groups FROM r)
SELECT o_custkey, value, row_number() OVER (ORDER BY value DESC, o_custkey) AS evidence_id, total_groups,
       least(total_groups, 100) AS included_groups
FROM r, t ORDER BY value DESC, o_custkey LIMIT 100
""")(_evidence)


# ---------------------------------------------------------------- profile / inference / review (T, G)
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import profile
    return profile(dataset(spark, sf_dir, "orders")).select("field", "dtype", "nulls", "unique")


register("profile_orders", """
SELECT * FROM (VALUES
 ('o_orderkey', 'number'), ('o_custkey', 'number'), ('o_orderstatus', 'string'),
 ('o_totalprice', 'number'), ('o_orderdate', 'date'), ('o_orderpriority', 'string')) AS f(field, dtype)
JOIN (
 SELECT 'o_orderkey' AS field, count(*) - count(o_orderkey) AS nulls, count(DISTINCT o_orderkey) AS "unique" FROM orders
 UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders
 UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
 UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), count(DISTINCT o_totalprice) FROM orders
 UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), count(DISTINCT o_orderdate) FROM orders
 UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders
) USING (field)
""")(_profile)


def _profile_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import profile
    ds = dataset(spark, sf_dir, "lineitem").with_frame(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate"))
    ds = Dataset.from_frame(ds.df, source="lineitem")
    return profile(ds).select("field", "min", "max")


register("profile_minmax", """
SELECT 'l_orderkey' AS field, CAST(min(l_orderkey) AS VARCHAR) AS min, CAST(max(l_orderkey) AS VARCHAR) AS max FROM lineitem
UNION ALL SELECT 'l_quantity', CAST(min(l_quantity) AS VARCHAR), CAST(max(l_quantity) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'l_shipdate', CAST(min(l_shipdate) AS VARCHAR), CAST(max(l_shipdate) AS VARCHAR) FROM lineitem
""")(_profile_minmax)


def _text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as text cells, as a delimited import would hold it."""
    o = table(spark, sf_dir, "orders")
    return o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])


def _infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import infer_types
    return infer_types(_text_orders(spark, sf_dir)).select("field", "nonnull", "numeric", "dtype")


register("infer_types", """
SELECT 'o_orderkey' AS field, count(o_orderkey) AS nonnull, count(o_orderkey) AS numeric, 'number' AS dtype FROM orders
UNION ALL SELECT 'o_custkey', count(o_custkey), count(o_custkey), 'number' FROM orders
UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), 0, 'string' FROM orders
UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(o_totalprice), 'number' FROM orders
UNION ALL SELECT 'o_orderdate', count(o_orderdate), 0, 'date' FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), 0, 'string' FROM orders
""")(_infer)


def _typed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells -> inferred, strictly cast dataset."""
    from planwise.operators.profile import type_dataset
    text = Dataset.from_frame(_text_orders(spark, sf_dir), positional_ids=True, source="orders-text")
    return type_dataset(text).df


register("typed_roundtrip", """
SELECT CAST(o_orderkey AS DOUBLE) AS f1, CAST(o_custkey AS DOUBLE) AS f2, o_orderstatus AS f3,
       o_totalprice AS f4, o_orderdate AS f5, o_orderpriority AS f6 FROM orders
""")(_typed_roundtrip)


def _events_with_labels():
    # Summary-like labels manufactured from whole categories, both engines.
    return {"event_label": F.when(F.col("event_type") == "error", F.lit(" Total "))
            .when(F.col("event_type") == "signup", F.lit("合计")).otherwise(F.col("event_type"))}


EVENTS_LABELLED_SQL = ("(SELECT *, CASE WHEN event_type = 'error' THEN ' Total ' WHEN event_type = 'signup' "
                       "THEN '合计' ELSE event_type END AS event_label FROM events)")


def _suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.review import summary_suspects
    return summary_suspects(dataset(spark, sf_dir, "events", _events_with_labels()))


register("review_suspects", f"""
SELECT 'event_label' AS field, lower(trim(event_label)) AS value, count(*) AS rows
FROM {EVENTS_LABELLED_SQL}
WHERE lower(trim(event_label)) IN ('all', 'total', 'subtotal', 'grand total', '合计', '总计', '小计', '全部')
GROUP BY 1, 2
""")(_suspects)


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.review import review_frame
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    return review_frame(Dataset.from_frame(df))


register("review_summary", """
SELECT 'rows' AS metric, count(*) AS value FROM lineitem
UNION ALL
SELECT 'exact_duplicate_rows', count(*) - (SELECT count(*) FROM
  (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_shipdate FROM lineitem)) FROM lineitem
UNION ALL
SELECT 'suspect_rows', 0
""")(_review)


def _dup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import duplicate_rows
    return duplicate_rows(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate"))


register("dup_count", """
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, o_orderdate FROM orders))
  AS duplicate_rows FROM orders
""")(_dup_count)


def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import fingerprint
    return fingerprint(table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"),
                                                                "text", "source", "n_chars")).select("rows", "checksum")


register("fingerprint", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS a, nullif(lang, 'fr') AS b, text AS c, source AS d, CAST(n_chars AS VARCHAR) AS e
           FROM documents),
     h AS (SELECT md5('0' || coalesce('=' || length(a) || ':' || a, '-') || '1' || coalesce('=' || length(b) || ':' || b, '-')
                      || '2' || coalesce('=' || length(c) || ':' || c, '-') || '3' || coalesce('=' || length(d) || ':' || d, '-')
                      || '4' || coalesce('=' || length(e) || ':' || e, '-')) AS m FROM d),
     s AS (SELECT count(*) AS rows, coalesce(sum(CAST('0x' || substr(m, 1, 15) AS BIGINT)), 0) AS x,
                  coalesce(sum(CAST('0x' || substr(m, 16, 15) AS BIGINT)), 0) AS y FROM h)
SELECT rows, sha256(concat_ws(':', rows, x, y)) AS checksum FROM s
""")(_fingerprint)


# ---------------------------------------------------------------- guarded SQL (Q1-Q11)
SQL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "labels", "conversations", "pages")


def register_views(spark: SparkSession, sf_dir: str, names=SQL_TABLES, sql: str | None = None) -> None:
    """Views over the tables; with ``sql``, only the tables it names."""
    import re
    for name in names:
        if sql is None or re.search(rf"(?i)\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def sql_query(name: str, sql: str, spark_sql: str | None = None):
    """Same text in both engines unless a dialect difference forces two."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from planwise.sources.sql import guarded_sql
        register_views(spark, sf_dir, sql=spark_sql or sql)
        return guarded_sql(spark, spark_sql or sql)
    register(name, sql)(run)


sql_query("sql_join_inner", """
SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name
""")
sql_query("sql_join_left", """
SELECT c.c_custkey, count(o.o_orderkey) AS n_orders
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey
""")
sql_query("sql_join_full", """
SELECT coalesce(s.k, c.k) AS nationkey, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers
FROM (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1) s
FULL OUTER JOIN (SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1) c ON s.k = c.k
""")
sql_query("sql_join_right", """
SELECT n.n_name, coalesce(s.n, 0) AS suppliers
FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s
RIGHT JOIN nation n ON s.k = n.n_nationkey
""")
sql_query("sql_join_semi", """
SELECT c.c_custkey, c.c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
""")
sql_query("sql_join_anti", """
SELECT c.c_custkey, c.c_mktsegment FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
""")
sql_query("sql_join_nonequi", """
SELECT p.p_partkey, count(*) AS pricier_lines
FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_extendedprice > p.p_retailprice * 10
GROUP BY p.p_partkey
""")
sql_query("sql_window_rank", """
SELECT c_custkey, c_mktsegment, c_acctbal,
       CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rnk
FROM customer
""")
sql_query("sql_window_running", """
SELECT o_orderkey, o_custkey,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total,
       CAST(coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS BIGINT)
         AS prev_order
FROM orders
""")
sql_query("sql_union", """
SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer
UNION SELECT s_nationkey, 'supplier' FROM supplier
""")
sql_query("sql_union_all", """
SELECT kind, count(*) AS n FROM (
  SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier
) u GROUP BY kind
""")
sql_query("sql_intersect", """
SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier
""")
sql_query("sql_except", """
SELECT o_custkey AS custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
""")
sql_query("sql_rollup", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
sql_query("sql_cube", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
sql_query("sql_grouping_sets", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
""")
sql_query("sql_having", """
SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 15
""")
sql_query("sql_cte_subquery", """
WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey)
SELECT c.c_mktsegment, count(*) AS big_customers FROM customer c JOIN big b ON c.c_custkey = b.o_custkey
WHERE b.spend > (SELECT avg(spend) FROM big) GROUP BY c.c_mktsegment
""")
sql_query("sql_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
""")
sql_query("sql_scalar_functions", """
SELECT upper(substr(p_name, 1, 4)) AS prefix, length(p_brand) AS brand_len, count(*) AS n,
       round(avg(p_retailprice), 6) AS avg_price
FROM part GROUP BY 1, 2
""")


def _sql_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded query's result as a dataset (positional IDs), then a plan on it."""
    from planwise.sources.sql import sql_dataset
    register_views(spark, sf_dir)
    ds = sql_dataset(spark, "SELECT r.r_name, n.n_name, s.s_acctbal FROM supplier s "
                            "JOIN nation n ON s.s_nationkey = n.n_nationkey "
                            "JOIN region r ON n.n_regionkey = r.r_regionkey", limit=None)
    return compile_plan(ds, Plan(group_by=("r_name",), metric="s_acctbal", aggregation="mean"), decimals=6).df


register("sql_to_dataset_plan", """
SELECT r.r_name AS f1, round(avg(s.s_acctbal), 6) AS value FROM supplier s
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1
""")(_sql_dataset)


# ---------------------------------------------------------------- chart data
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _mark_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import histogram
    return histogram(_events(spark, sf_dir), "value").select("bin", "count")


register("mark_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
     b AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 10) + 1, 10) AS BIGINT) AS bin, count(*) AS count
           FROM events, s WHERE value IS NOT NULL GROUP BY 1)
SELECT r.bin, coalesce(b.count, 0) AS count FROM (SELECT range AS bin FROM range(1, 11)) r LEFT JOIN b USING (bin)
""")(_mark_histogram)


def _mark_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import box_stats
    out = box_stats(_events(spark, sf_dir), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")],
                      "lower_whisker", "upper_whisker", "outliers")


register("mark_box", """
WITH s AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT s.event_type, s.n, round(s.q1, 6) AS q1, round(s.median, 6) AS median, round(s.q3, 6) AS q3,
       min(CASE WHEN e.value >= s.q1 - 1.5 * (s.q3 - s.q1) THEN e.value END) AS lower_whisker,
       max(CASE WHEN e.value <= s.q3 + 1.5 * (s.q3 - s.q1) THEN e.value END) AS upper_whisker,
       count(CASE WHEN e.value < s.q1 - 1.5 * (s.q3 - s.q1) OR e.value > s.q3 + 1.5 * (s.q3 - s.q1) THEN 1 END)
         AS outliers
FROM events e JOIN s USING (event_type) WHERE e.value IS NOT NULL
GROUP BY s.event_type, s.n, s.q1, s.median, s.q3
""")(_mark_box)


def _mark_quartiles_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import exact_quantiles
    out = exact_quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", (0.1, 0.5, 0.9))
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("q0", "q1", "q2")])


register("mark_quantiles", """
SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS q0,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.9), 6) AS q2
FROM lineitem GROUP BY 1
""")(_mark_quartiles_lineitem)


def _mark_violin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import violin_density
    # one kind of event loses its name
    events = _events(spark, sf_dir).select(F.nullif("event_type", F.lit("view")).alias("event_type"), "value")
    out = violin_density(events, "event_type", "value")
    return out.select("event_type", "idx", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 3).alias("density_e6"),
                      "flat")


register("mark_violin", """
WITH ev AS (SELECT coalesce(nullif(event_type, 'view'), '') AS event_type, value FROM events),
     s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
           FROM ev WHERE value IS NOT NULL GROUP BY 1),
     p AS (SELECT event_type, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, lo, hi FROM s WHERE n > 1 AND sd > 0),
     g AS (SELECT event_type, n, bw, lo - 2.0 * bw AS start, (hi - lo + 2 * 2.0 * bw) / 99 AS step FROM p)
SELECT nullif(event_type, '') AS event_type, 0 AS idx, round(lo, 6) AS x, CAST(NULL AS DOUBLE) AS density_e6, true AS flat
FROM s WHERE n = 1 OR sd = 0
UNION ALL
SELECT nullif(g.event_type, '') AS event_type, CAST(i.range AS INTEGER) AS idx, round(g.start + i.range * g.step, 6) AS x,
       round(sum(exp(-0.5 * ((g.start + i.range * g.step - e.value) / g.bw) * ((g.start + i.range * g.step - e.value) / g.bw)))
             / (g.n * g.bw * sqrt(2 * pi())) * 1e6, 3) AS density_e6, false AS flat
FROM ev e JOIN g USING (event_type), range(100) i
WHERE e.value IS NOT NULL
GROUP BY g.event_type, i.range, g.start, g.step, g.n, g.bw
""")(_mark_violin)


def _mark_violin_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import violin_density
    # all events, and beside them a group of one value and one without a name
    extra = spark.createDataFrame([("single", 1.0), (None, 1.0), (None, 3.0)], "event_type string, value double")
    out = violin_density(_events(spark, sf_dir).select("event_type", "value").unionByName(extra), "event_type", "value")
    return out.select("event_type", "idx", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 3).alias("density_e6"),
                      "flat")


register("mark_violin_all", """
WITH ev AS (SELECT event_type, value FROM events
            UNION ALL SELECT * FROM (VALUES ('single', 1.0::DOUBLE), ('', 1.0::DOUBLE), ('', 3.0::DOUBLE))),
     s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
           FROM ev WHERE value IS NOT NULL GROUP BY 1),
     p AS (SELECT event_type, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, lo, hi FROM s WHERE n > 1 AND sd > 0),
     g AS (SELECT event_type, n, bw, lo - 2.0 * bw AS start, (hi - lo + 2 * 2.0 * bw) / 99 AS step FROM p)
SELECT nullif(event_type, '') AS event_type, 0 AS idx, round(lo, 6) AS x, CAST(NULL AS DOUBLE) AS density_e6, true AS flat
FROM s WHERE n = 1 OR sd = 0
UNION ALL
SELECT nullif(g.event_type, '') AS event_type, CAST(i.range AS INTEGER) AS idx, round(g.start + i.range * g.step, 6) AS x,
       round(sum(exp(-0.5 * ((g.start + i.range * g.step - e.value) / g.bw) * ((g.start + i.range * g.step - e.value) / g.bw)))
             / (g.n * g.bw * sqrt(2 * pi())) * 1e6, 3) AS density_e6, false AS flat
FROM ev e JOIN g USING (event_type), range(100) i
WHERE e.value IS NOT NULL
GROUP BY g.event_type, i.range, g.start, g.step, g.n, g.bw
""")(_mark_violin_all)


def _mark_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import heatmap_matrix
    res = compile_plan(dataset(spark, sf_dir, "lineitem"),
                       Plan(group_by=("l_returnflag", "l_linestatus"), metric="l_quantity")).df
    return heatmap_matrix(res, "l_returnflag", "l_linestatus", "value")


register("mark_heatmap", """
SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS "F",
       sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS "O"
FROM lineitem GROUP BY 1
""")(_mark_heatmap)


def _mark_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import density_raster
    return density_raster(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 64, 48)


register("mark_density", """
WITH s AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                  max(l_extendedprice) AS y1 FROM lineitem)
SELECT CAST(least(floor((l_quantity - x0) / (x1 - x0) * 64), 63) AS BIGINT) AS px,
       CAST(least(floor((l_extendedprice - y0) / (y1 - y0) * 48), 47) AS BIGINT) AS py, count(*) AS count
FROM lineitem, s GROUP BY 1, 2
""")(_mark_density)


def _mark_density_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import density_raster, density_stats
    raster = density_raster(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 64, 48,
                            x_range=(10.0, 30.0), y_range=(10000.0, 50000.0))
    return density_stats(raster)


register("mark_density_viewport", """
WITH c AS (SELECT count(*) AS count FROM lineitem
           WHERE l_quantity BETWEEN 10 AND 30 AND l_extendedprice BETWEEN 10000 AND 50000
           GROUP BY CAST(least(floor((l_quantity - 10.0) / 20.0 * 64), 63) AS BIGINT),
                    CAST(least(floor((l_extendedprice - 10000.0) / 40000.0 * 48), 47) AS BIGINT))
SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS points_in_view, coalesce(max(count), 0) AS max_count FROM c
""")(_mark_density_viewport)


def _flow_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_plan(dataset(spark, sf_dir, "orders"),
                        Plan(group_by=("o_orderstatus", "o_orderpriority"), metric="o_totalprice"), decimals=2).df


def _mark_sankey_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import sankey_links
    return sankey_links(_flow_result(spark, sf_dir), "o_orderstatus", "o_orderpriority", "value")


register("mark_sankey_links", """
SELECT o_orderstatus AS source, o_orderpriority AS target, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2
""")(_mark_sankey_links)


def _mark_sankey_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import sankey_nodes
    return sankey_nodes(_flow_result(spark, sf_dir), "o_orderstatus", "o_orderpriority")


register("mark_sankey_nodes", """
SELECT o_orderstatus AS name FROM orders UNION SELECT o_orderpriority FROM orders
""")(_mark_sankey_nodes)


def _mark_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import tree_rows
    res = compile_plan(dataset(spark, sf_dir, "customer"), Plan(group_by=("c_mktsegment",), aggregation="count")).df
    return tree_rows(res, "c_mktsegment", "value", "customers")


register("mark_tree", """
SELECT 'customers' AS parent, c_mktsegment AS name, count(*) AS value FROM customer GROUP BY 2
""")(_mark_tree)


def _mark_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import funnel_stages
    res = compile_plan(dataset(spark, sf_dir, "events"),
                       Plan(group_by=("event_type",), aggregation="count", sort="desc")).df
    return funnel_stages(res, "event_type", "value")


register("mark_funnel", """
SELECT event_type AS stage, count(*) AS value FROM events GROUP BY 1
""")(_mark_funnel)


def _mark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import bar_marks
    res = compile_plan(dataset(spark, sf_dir, "lineitem", _nullable_lineitem()),
                       Plan(group_by=("l_returnflag_n",), metric="l_quantity", missing="keep")).df
    return bar_marks(res, "l_returnflag_n", "value")


register("mark_bars_missing_label", f"""
SELECT coalesce(l_returnflag_n, '(missing)') AS category, sum(l_quantity) AS value
FROM {NULLABLE_LINEITEM_SQL} GROUP BY l_returnflag_n
""")(_mark_bars)


def _mark_color_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import color_scale
    res = compile_plan(dataset(spark, sf_dir, "orders"),
                       Plan(group_by=("o_orderpriority",), metric="o_totalprice"), decimals=2).df
    return color_scale(res, "value").withColumn("color_t", F.round("color_t", 6))


register("mark_color_scale", """
WITH r AS (SELECT o_orderpriority, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
SELECT o_orderpriority, value, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6)
  AS color_t FROM r
""")(_mark_color_scale)


def _mark_color_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import color_codes
    res = compile_plan(dataset(spark, sf_dir, "nation"), Plan(group_by=("n_name",), aggregation="count")).df
    return color_codes(res, "n_name")


register("mark_color_codes", """
SELECT n_name, count(*) AS value, CAST((dense_rank() OVER (ORDER BY n_name) - 1) % 10 AS INTEGER) AS color_code
FROM nation GROUP BY n_name
""")(_mark_color_codes)


def _mark_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import kpi_table
    res = compile_plan(dataset(spark, sf_dir, "nation"), Plan(group_by=("n_regionkey",), aggregation="count")).df
    return kpi_table(res, "n_regionkey", "value")


register("mark_kpi_table", """
SELECT n_regionkey, count(*) AS value,
       CAST(row_number() OVER (ORDER BY count(*) DESC, n_regionkey) AS INTEGER) AS rank
FROM nation GROUP BY n_regionkey
""")(_mark_kpi)


def _mark_brush(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.filters import brush
    sel = brush(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (5, 25), (0.02, 0.06))
    ds = Dataset.from_frame(sel, source="lineitem")
    return compile_plan(ds, Plan(group_by=("l_returnflag",), metric="l_extendedprice"), decimals=2).df


register("mark_brush_linked", """
SELECT l_returnflag, round(sum(l_extendedprice), 2) AS value FROM lineitem
WHERE l_quantity BETWEEN 5 AND 25 AND l_discount BETWEEN 0.02 AND 0.06 GROUP BY 1
""")(_mark_brush)


def _mark_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import facet_values
    return facet_values(_flow_result(spark, sf_dir), "o_orderpriority")


register("mark_facets", "SELECT DISTINCT o_orderpriority FROM orders")(_mark_facets)


def _edge_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.timegrain import bucket_coverage
    return bucket_coverage(table(spark, sf_dir, "events"), "ts", "month")


register("edge_months", """
WITH b AS (SELECT strftime(ts, '%Y-%m') AS bucket, CAST(date_trunc('month', min(ts)) AS DATE) AS bucket_start,
                  CAST(date_trunc('month', min(ts)) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS bucket_end,
                  count(*) AS rows FROM events GROUP BY 1),
     r AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events)
SELECT bucket, rows, (bucket_start < lo OR bucket_end > hi) AS is_edge FROM b, r
""")(_edge_months)


# ---------------------------------------------------------------- run log (L1-L3, O8) on events
# events as a run log: user_id = run, event_id = sequence, event_type = status.
def _log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.runlog import latest_state
    return latest_state(_events(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "event_type", "ts")


register("log_latest", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(ts, event_id) AS ts
FROM events GROUP BY user_id
""")(_log_latest)


def _log_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.runlog import latest_state, overdue_runs
    ev = _events(spark, sf_dir)
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running") \
        .otherwise(F.col("event_type"))
    latest = latest_state(ev.withColumn("status", status), "user_id", "event_id")
    as_of = ev.agg(F.max("ts")).scalar()
    return overdue_runs(latest, "status", "ts", as_of).select("user_id", "status", "deadline_s")


register("log_overdue", """
WITH l AS (SELECT user_id, arg_max(CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running'
                                   ELSE event_type END, event_id) AS status,
                  arg_max(ts, event_id) AS ts FROM events GROUP BY user_id),
     a AS (SELECT max(ts) AS as_of FROM events)
SELECT user_id, status, CASE status WHEN 'queued' THEN 60 ELSE 150 END AS deadline_s FROM l, a
WHERE status IN ('queued', 'running')
  AND epoch_us(as_of) - epoch_us(ts) > (CASE status WHEN 'queued' THEN 60 ELSE 150 END) * 1000000
""")(_log_overdue)


def _log_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.runlog import superseded
    return superseded(_requests(spark, sf_dir), "user_id", "event_id", "status")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # views and clicks stand for requests that are queued and running
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("done")
    return _events(spark, sf_dir).select("event_id", "user_id", status.alias("status"))


_REQUESTS_SQL = """SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running'
                                   ELSE 'done' END AS status FROM events"""
register("log_superseded", f"""
SELECT event_id, user_id, status,
       status <> 'done' AND event_id < max(event_id) OVER (PARTITION BY user_id) AS superseded FROM ({_REQUESTS_SQL})
""")(_log_superseded)


def _log_superseded_nullkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.runlog import superseded
    few = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    return superseded(_requests(spark, sf_dir).withColumn("user_id", few.cast("string")), "user_id", "event_id", "status")


register("log_superseded_nullkey", f"""
SELECT event_id, user_id, status,
       status <> 'done' AND event_id < max(event_id) OVER (PARTITION BY user_id) AS superseded
FROM (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id, status FROM ({_REQUESTS_SQL}))
""")(_log_superseded_nullkey)


def _log_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.runlog import recent_per_key
    return recent_per_key(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), "user_id", "event_id", 30)


register("log_recent30", """
SELECT * FROM (SELECT event_id, user_id, event_type,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM events)
WHERE rank <= 30
""")(_log_recent)


# ---------------------------------------------------------------- revisions (L4, L5) on conversations
# conversations as revision chains: each turn revises the previous turn of its
# conversation; an assistant turn is a result computed for the user turn before
# it, and a conversation's head is its latest user turn.
def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    rev = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"),
                                                    (F.col("turn") - 1).cast("string")))
    # the chains of every seventh conversation start from a revision that does not exist
    parent = F.when((F.col("turn") == 0) & (F.col("conv_id") % 7 == 0), F.lit("none")).otherwise(parent)
    return conv.select(rev.alias("rev_id"), parent.alias("parent_id"))


def _log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.runlog import history_depth
    out = history_depth(_revisions(spark, sf_dir), "rev_id", "parent_id")
    return out.withColumn("depth", F.col("depth").cast("string"))


register("log_history_depth", """
WITH RECURSIVE revs AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS rev_id,
         CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR)
              WHEN conv_id % 7 = 0 THEN 'none' END AS parent_id
  FROM conversations),
chain(id, root, depth) AS (
  SELECT rev_id, rev_id, 0 FROM revs WHERE parent_id IS NULL
  UNION ALL
  SELECT r.rev_id, c.root, c.depth + 1 FROM revs r JOIN chain c ON r.parent_id = c.id)
SELECT r.rev_id, c.root, CAST(c.depth AS VARCHAR) AS depth, CASE WHEN c.id IS NULL THEN 'unrooted' ELSE 'rooted' END AS status
FROM revs r LEFT JOIN chain c ON c.id = r.rev_id
""")(_log_history)


def _log_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.runlog import compare_and_set
    conv = table(spark, sf_dir, "conversations")
    results = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("generation"), "turn")
    head = conv.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("generation"))
    return compare_and_set(results, head, ["conv_id", "generation"])


register("log_compare_and_set", """
WITH r AS (SELECT conv_id, turn - 1 AS generation, turn FROM conversations WHERE role = 'assistant'),
     s AS (SELECT conv_id, max(turn) AS generation FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT r.conv_id, r.generation, r.turn, s.conv_id IS NOT NULL AS accepted
FROM r LEFT JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.generation IS NOT DISTINCT FROM s.generation
""")(_log_publish)


# ---------------------------------------------------------------- streaming
def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.streaming import event_stream
    schema = table(spark, sf_dir, "events").schema
    return event_stream(spark, sf_dir.rstrip("/"), schema, glob="events.parquet", time_col="ts")


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.session import scratch_dir
    from planwise.streaming import read_latest, run_available, stream_plan
    stream = stream_plan(_events_stream(spark, sf_dir), "ts", "day", ["event_type"], "sum", "value")
    data = run_available(stream, scratch_dir(spark, "stream-daily"), mode="update")
    return read_latest(spark, data, ["ts", "event_type"]).withColumn("value", F.round("value", 2))


register("stream_daily_sum", """
SELECT strftime(ts, '%Y-%m-%d') AS ts, event_type, round(sum(value), 2) AS value FROM events GROUP BY 1, 2
""")(_stream_daily)


def _stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.session import scratch_dir
    from planwise.streaming import run_available, tail_terminal
    stream = tail_terminal(_events_stream(spark, sf_dir), "event_type", ("purchase", "error"))
    data = run_available(stream.select("event_id", "user_id", "event_type"), scratch_dir(spark, "stream-tail"))
    return spark.read.parquet(data).drop("batch")


register("stream_terminal_tail", """
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'error')
""")(_stream_tail)


def _deadline_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.streaming import deadline_sessions
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running") \
        .otherwise(F.col("event_type"))
    out = deadline_sessions(ev.withColumn("status", status).withColumn("ts", F.col("ts").cast("timestamp")),
                            "user_id", "ts", "status", "event_id", "150 seconds")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events", "last_status", "overdue")


register("log_deadline_sessions", """
WITH e AS (SELECT user_id, event_id, ts,
                  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' ELSE event_type END AS status,
                  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                         OR ts >= max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 150 SECOND
                       THEN 1 ELSE 0 END AS brk
           FROM events),
     s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 150 SECOND AS session_end, count(*) AS events,
       arg_max(status, event_id) AS last_status, arg_max(status, event_id) IN ('queued', 'running') AS overdue
FROM s GROUP BY user_id, sid
""")(_deadline_sessions)


# ---------------------------------------------------------------- delimited round trip
def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole orders table written as CSV by Spark, then strictly imported
    and typed; must equal the Parquet original (keys become numbers)."""
    from planwise.session import scratch_dir
    from planwise.sources.delimited import read_delimited
    out = scratch_dir(spark, "csv-roundtrip")
    (table(spark, sf_dir, "orders").write.mode("errorifexists").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{out}/orders"))
    return read_delimited(spark, f"{out}/orders", infer=True).df


register("csv_roundtrip", """
SELECT CAST(o_orderkey AS DOUBLE) AS f1, CAST(o_custkey AS DOUBLE) AS f2, o_orderstatus AS f3,
       o_totalprice AS f4, o_orderdate AS f5, o_orderpriority AS f6 FROM orders
""")(_csv_roundtrip)


# ---------------------------------------------------------------- ordering, report, formatting
plan_query("plan_first_seen", "events", Plan(group_by=("event_type",), aggregation="count"),
           "SELECT event_type, count(*) AS value FROM events GROUP BY 1")
QUERIES["plan_first_seen"] = lambda spark, sf_dir: compile_plan(
    dataset(spark, sf_dir, "events"), Plan(group_by=("event_type",), aggregation="count"), first_seen=True).df


def _plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount_n"))
    plan = Plan(group_by=("l_returnflag",), metric="l_discount_n", aggregation="mean", missing="exclude",
                duplicates="drop_exact", filters=(Filter("l_quantity", "gt", 10),))
    rep = compile_plan(Dataset.from_frame(df), plan).report_frame()
    return rep.withColumn("min_value", F.round("min_value", 6)).withColumn("max_value", F.round("max_value", 6))


register("plan_report", """
WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, nullif(l_discount, 0.0) AS l_discount_n FROM lineitem),
     f AS (SELECT * FROM d WHERE l_quantity > 10),
     g AS (SELECT l_returnflag, avg(l_discount_n) AS v FROM f
           WHERE l_returnflag IS NOT NULL AND l_discount_n IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM lineitem) AS input_rows,
       (SELECT count(*) FROM f) AS filtered_rows,
       (SELECT count(*) FROM f WHERE l_returnflag IS NOT NULL AND l_discount_n IS NOT NULL) AS analyzed_rows,
       (SELECT count(*) FROM f WHERE l_returnflag IS NULL OR l_discount_n IS NULL) AS missing_rows,
       (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM d) AS duplicate_rows_removed,
       (SELECT count(*) FROM g) AS groups,
       (SELECT round(min(v), 6) FROM g) AS min_value, (SELECT round(max(v), 6) FROM g) AS max_value,
       'number' AS value_format
""")(_plan_report)


def _value_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.functions.exprs import format_value
    res = compile_plan(dataset(spark, sf_dir, "lineitem"),
                       Plan(group_by=("l_returnflag",), metric="l_discount", denominator="l_quantity",
                            aggregation="ratio_total")).df
    return res.select("l_returnflag", format_value(F.col("value"), "percent", 4).alias("label"))


register("plan_value_format", """
SELECT l_returnflag, format('{:,.4f}', sum(l_discount) / sum(l_quantity) * 100) || '%' AS label
FROM lineitem GROUP BY 1
""")(_value_format)


# ---------------------------------------------------------------- snapshots, cache, preview, sources
def _snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.session import scratch_dir
    from planwise.sources.snapshot import read_snapshot, write_snapshot
    root = scratch_dir(spark, "snapshots")
    meta = write_snapshot(dataset(spark, sf_dir, "orders"), root)
    return read_snapshot(spark, root, meta["id"]).df


register("snapshot_roundtrip", "SELECT * FROM orders")(_snapshot_roundtrip)


def _plan_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import fingerprint
    from planwise.operators.suggest import cache_key, cached_result
    from planwise.session import scratch_dir
    ds = dataset(spark, sf_dir, "orders")
    plan = Plan(group_by=("o_orderstatus",), metric="o_totalprice", aggregation="mean")
    key = cache_key(fingerprint(ds.df).first()["checksum"], ds, plan)
    root = scratch_dir(spark, "result-cache")
    first, hit = cached_result(compile_plan(ds, plan, decimals=6).df, root, key)
    again, hit_again = cached_result(compile_plan(ds, plan, decimals=6).df, root, key)
    assert not hit and hit_again
    return again


register("plan_cached", """
SELECT o_orderstatus, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1
""")(_plan_cached)


def _row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.marks import with_row_index
    return with_row_index(table(spark, sf_dir, "region").select("r_name"), ["r_name"])


register("mark_row_index", """
SELECT r_name, CAST(row_number() OVER (ORDER BY r_name) - 1 AS INTEGER) AS _index FROM region
""")(_row_index)


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.sources.catalog import preview_frame
    return preview_frame(dataset(spark, sf_dir, "nation"), 50)


register("preview_nation", """
SELECT *, CAST(count(*) OVER () AS BIGINT) AS total_rows FROM nation
""")(_preview)


def _browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.sources.catalog import SourceCatalog
    cat = SourceCatalog(spark)
    cat.add_parquet("warehouse", {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("region", "nation", "orders")})
    return cat.browse("warehouse")


register("source_browse", """
SELECT table_name AS "table", column_name AS "column",
       CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
                      WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type
FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'orders')
""")(_browse)


def _sql_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.sources.sql import sql_dataset
    register_views(spark, sf_dir)
    return sql_dataset(spark, "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey").df


register("sql_capped_result", """
SELECT n_regionkey AS f1, count(*) AS f2 FROM nation GROUP BY n_regionkey
""")(_sql_capped)


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.suggest import proposals_frame
    return proposals_frame(dataset(spark, sf_dir, "orders"), goal="order value by segment")


# Shape of a proposal's plan, as the library spells it; names and ranks come from the table's statistics.
register("suggest_plans", """
WITH n AS (SELECT count(*) AS rows, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders),
     g AS (SELECT 'o_orderstatus' AS name, 2 AS place, false AS trend FROM n WHERE s <= greatest(10, 0.7 * rows)
           UNION ALL SELECT 'o_orderdate', 4, true
           UNION ALL SELECT 'o_orderpriority', 5, false FROM n WHERE p <= greatest(10, 0.7 * rows))
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position,
       name || CASE WHEN trend THEN ' · Trend' ELSE ' · Compare' END AS title,
       CASE WHEN trend THEN 'line' ELSE 'bar' END AS chart,
       '{"aggregation":"sum","denominator":null,"duplicates":"keep","filters":[],"goal":"order value by segment","group_by":["'
       || name || '"],"limitations":["Describes the data; it does not show causes"],"metric":"o_totalprice","missing":"keep",'
       || '"schema_version":"1.0","sort":"' || CASE WHEN trend THEN 'label' ELSE 'desc' END || '","time_grain":"'
       || CASE WHEN trend THEN 'month' ELSE 'none' END || '","unit":""}' AS plan
FROM g ORDER BY place LIMIT 3
""")(_proposals)


# ---------------------------------------------------------------- more stream grains
def _stream_week_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.session import scratch_dir
    from planwise.streaming import read_latest, run_available, stream_plan
    stream = stream_plan(_events_stream(spark, sf_dir), "ts", "week", [], "mean", "value", watermark="7 days")
    data = run_available(stream, scratch_dir(spark, "stream-week"), mode="update")
    return read_latest(spark, data, ["ts"]).withColumn("value", F.round("value", 6))


register("stream_week_mean", """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' ||
       strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS ts, round(avg(value), 6) AS value
FROM events GROUP BY 1
""")(_stream_week_mean)


def _stream_month_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.session import scratch_dir
    from planwise.streaming import read_latest, run_available, stream_plan
    stream = stream_plan(_events_stream(spark, sf_dir), "ts", "month", ["event_type"], "count")
    data = run_available(stream, scratch_dir(spark, "stream-month"), mode="update")
    return read_latest(spark, data, ["ts", "event_type"])


register("stream_month_count", """
SELECT strftime(ts, '%Y-%m') AS ts, event_type, count(*) AS value FROM events GROUP BY 1, 2
""")(_stream_month_count)


# ---------------------------------------------------------------- text tables (whole texts)
plan_query("docs_by_lang", "documents", Plan(group_by=("lang",), metric="n_chars", aggregation="mean"),
           "SELECT lang, round(avg(n_chars), 6) AS value FROM documents GROUP BY 1", decimals=6)
plan_query("docs_contains_license", "documents",
           Plan(group_by=("lang",), aggregation="count", filters=(Filter("text", "contains", "license"),)),
           "SELECT lang, count(*) AS value FROM documents WHERE contains(text, 'license') GROUP BY 1")
plan_query("labels_quality_by_toxic", "labels", Plan(group_by=("toxic",), metric="quality", aggregation="mean"),
           "SELECT toxic, round(avg(quality), 6) AS value FROM labels GROUP BY 1", decimals=6)
plan_query("conversations_roles", "conversations", Plan(group_by=("role",), metric="turn", aggregation="max"),
           "SELECT role, max(turn) AS value FROM conversations GROUP BY 1")


def _docs_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset.from_frame(table(spark, sf_dir, "documents").select("lang", "text"), source="documents")
    return compile_plan(ds, Plan(group_by=("lang",), aggregation="count", duplicates="drop_exact"),
                        dedupe_strategy="hash").df


register("docs_dedupe_text", """
SELECT lang, count(*) AS value FROM (SELECT DISTINCT lang, text FROM documents) GROUP BY 1
""")(_docs_dedupe)


def _docs_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import duplicate_rows
    return duplicate_rows(table(spark, sf_dir, "documents").select("lang", "source", "text"))


register("docs_duplicate_rows", """
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) AS duplicate_rows
FROM documents
""")(_docs_dups)


def _pages_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.profile import profile
    return profile(dataset(spark, sf_dir, "pages")).select("field", "nulls", "unique")


register("pages_profile", """
SELECT 'page_id' AS field, count(*) - count(page_id) AS nulls, count(DISTINCT page_id) AS "unique" FROM pages
UNION ALL SELECT 'url', count(*) - count(url), count(DISTINCT url) FROM pages
UNION ALL SELECT 'html', count(*) - count(html), count(DISTINCT html) FROM pages
""")(_pages_profile)


def _docs_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwise.operators.review import summary_suspects
    return summary_suspects(dataset(spark, sf_dir, "documents"))


register("docs_review_suspects", """
SELECT field, value, count(*) AS rows FROM (
  SELECT 'text' AS field, lower(trim(text)) AS value FROM documents
  UNION ALL SELECT 'lang', lower(trim(lang)) FROM documents
  UNION ALL SELECT 'source', lower(trim(source)) FROM documents)
WHERE value IN ('all', 'total', 'subtotal', 'grand total', '合计', '总计', '小计', '全部') GROUP BY 1, 2
""")(_docs_suspects)

sql_query("sql_docs_labels", """
SELECT l.quality, l.toxic, count(*) AS docs, round(avg(d.n_chars), 6) AS avg_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality, l.toxic
""")


def _docs_dedupe_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-first exact dedupe of whole documents (wide text rows)."""
    from planwise.operators.dedupe import drop_exact_duplicates
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    return drop_exact_duplicates(docs, "hash").groupBy("lang").agg(F.count(F.lit(1)).alias("distinct_docs"))


register("docs_dedupe_hash", """
SELECT lang, count(*) AS distinct_docs FROM (SELECT DISTINCT lang, source, text FROM documents) GROUP BY 1
""")(_docs_dedupe_hash)
