"""Queries over the driver's tables: relational ones as SQL that Spark and DuckDB both run, guarded ones over GuardedFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anonymity
from .frame import GuardedFrame, col, lit, offset_by, when
from .plans.context import PolicyContext
from .policy import PolicyViolation, parse
from .sources import policies as files
from .sources.policies import MICRO
from .sources.rows import positions
from .varied import ByRow

TABLES = "region nation customer supplier part orders lineitem events".split()

#: Run as they are by both engines. Money is rounded, as sums of doubles depend on their order.
SQL: dict[str, str] = {
    "filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND NOT (l_returnflag = 'R' OR l_discount < 0.03)",
    "projection": "SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus AS status FROM orders",
    "hstack": "SELECT p_partkey, p_size, p_size + 1 AS size_1, (p_size + 1) * p_retailprice AS scaled FROM part",
    "early_projection": "SELECT c_custkey, c_mktsegment FROM customer",
    "inner_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "composite_join": "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey",
    "left_outer_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'",
    "right_outer_join": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'",
    "full_outer_join": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "self_join": "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber",
    "union": "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "agg_sum": "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_mean": "SELECT l_returnflag, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_min": "SELECT l_suppkey, min(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey",
    "agg_max": "SELECT l_suppkey, max(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey",
    "agg_count": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_count_nonnull": "SELECT o_orderstatus, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n FROM orders GROUP BY o_orderstatus",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_nunique": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_std": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd0 FROM lineitem GROUP BY l_returnflag",
    "agg_var": "SELECT l_returnflag, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS v0 FROM lineitem GROUP BY l_returnflag",
    "agg_first": "SELECT l_suppkey, min_by(l_orderkey, l_orderkey * 100 + l_linenumber) AS f FROM lineitem GROUP BY l_suppkey",
    "agg_last": "SELECT l_suppkey, max_by(l_orderkey, l_orderkey * 100 + l_linenumber) AS f FROM lineitem GROUP BY l_suppkey",
    "agg_quantile": "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS lo, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, max(l_extendedprice) FILTER (WHERE l_discount < 0.05) AS hi FROM lineitem GROUP BY l_returnflag",
    "global_agg": "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "is_in": "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 14, 49) AND p_type IN ('PROMO', 'SMALL')",
    "like_contains": "SELECT p_partkey, p_name FROM part WHERE p_brand LIKE 'Brand#1%' AND p_type LIKE '%MO'",
    "date_year": "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1",
    "substring": "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1",
    "scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 10 FROM customer)",
    "correlated_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > 1000 AND p_size < (SELECT max(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)",
    "having": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 8",
    "rollup": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS m, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS m, grouping(c_mktsegment) AS g FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "joined_sum": "SELECT o_orderpriority, round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "window_mean": "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 4) AS m FROM orders",
    "window_frame": "SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM lineitem",
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS r FROM orders",
    "substring_key": "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-05' GROUP BY l_returnflag, l_linestatus",
    "tpch_q2": "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND c_mktsegment = 'BUILDING' AND o_totalprice = (SELECT min(x.o_totalprice) FROM orders x WHERE x.o_custkey = c_custkey) ORDER BY o_totalprice, o_orderkey LIMIT 100",
    "tpch_q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q4": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY) GROUP BY o_orderpriority",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q7": "SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_name = 'NATION_1' AND b.n_name = 'NATION_2' OR a.n_name = 'NATION_2' AND b.n_name = 'NATION_1' GROUP BY 1, 2, 3",
    "tpch_q8": "SELECT CAST(year(o_orderdate) AS INT) AS y, round(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' GROUP BY 1",
    "tpch_q9": "SELECT n_name, CAST(year(o_orderdate) AS INT) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_type LIKE '%MALL%' GROUP BY 1, 2",
    "tpch_q10": "SELECT c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q11": "SELECT l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3')",
    "tpch_q12": "SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'N') AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_returnflag",
    "tpch_q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) x GROUP BY c_count",
    "tpch_q14": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'",
    "tpch_q15": "WITH r AS (SELECT l_suppkey AS k, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN r ON s_suppkey = k WHERE total = (SELECT max(total) FROM r)",
    "tpch_q16": "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#12' AND p_size IN (1, 7, 14) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size",
    "tpch_q17": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#12' AND l_quantity < (SELECT 0.2 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)",
    "tpch_q18": "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "tpch_q19": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5 OR p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10 OR p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15",
    "tpch_q20": "SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'SMALL%') GROUP BY l_suppkey HAVING sum(l_quantity) > 100)",
    "tpch_q21": "SELECT s_name, count(*) AS n FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY s_name ORDER BY n DESC, s_name LIMIT 100",
    "tpch_q22": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY c_mktsegment",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(text: str) -> list[str]:
    """The tables that a query names; only these are opened."""
    words = set(re.findall(r"\w+", text))
    return [t for t in TABLES if t in words]


def run_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in named(text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def guarded_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 where quantities and prices may be seen as sums and means over 20 rows or more only."""
    g = GuardedFrame.register(table(spark, sf_dir, "lineitem"), {"l_quantity": "A{sum>=20, mean>=20}", "l_extendedprice": "A{sum>=20, mean>=20}"})
    g = g.filter(col("l_shipdate") <= lit("2001-08-05").cast("timestamp")).group_by("l_returnflag", "l_linestatus").agg(sum_qty=("sum", col("l_quantity")), avg_price=("mean", col("l_extendedprice")), n=("len", None))
    out = g.release()
    return out.select("l_returnflag", "l_linestatus", F.round("sum_qty", 2).alias("sum_qty"), F.round("avg_price", 4).alias("avg_price"), "n")


def groupsize_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GuardedFrame.register(table(spark, sf_dir, "orders"), {"o_totalprice": "A{max>=5}"})
    return g.group_by("o_orderstatus").agg(m=("max", col("o_totalprice"))).release()


def groupsize_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GuardedFrame.register(table(spark, sf_dir, "customer"), {"c_acctbal": "A{max>=60}"})
    return g.group_by("c_nationkey").agg(True, m=("max", col("c_acctbal"))).release()


def offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GuardedFrame.register(table(spark, sf_dir, "events"), {"ts": "T{dt.offset_by:5s}"})
    return g.select("event_id", later=offset_by(col("ts"), "5s")).release()


#: Columns that differ from row to row: a join on them repeats no row of the other side.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def revenue(k: int) -> dict[str, str]:
    """Prices and discounts may be seen only together, as sums over k rows or more."""
    return {"l_extendedprice": f"A{{sum>={k}}}", "l_discount": f"T{{-:1}} => A{{sum>={k}}}"}


#: For each query of SQL policies that it meets: columns that only choose rows or aren't asked for (top), those that it aggregates over
#: groups of a least size, and those that it must transform.
GUARDS: dict[str, dict[str, str]] = {
    "filter": {"l_discount": "top"}, "projection": {"o_totalprice": "T{*:2}"}, "hstack": {"p_name": "top"}, "early_projection": {"c_acctbal": "top"}, "inner_join": {"o_custkey": "top", "c_custkey": "top"},
    "composite_join": {"s_nationkey": "top", "c_nationkey": "top"}, "left_outer_join": {"o_orderpriority": "top"}, "right_outer_join": {"o_orderpriority": "top"}, "full_outer_join": {"s_name": "top"},
    "semi_join": {"o_totalprice": "top"}, "anti_join": {"o_custkey": "top"}, "cross_join": {"r_regionkey": "top"}, "self_join": {"l_suppkey": "top"}, "union": {"n_regionkey": "top"}, "distinct": {"o_totalprice": "top"},
    "sort_limit": {"o_custkey": "top"}, "agg_sum": {"l_quantity": "A{sum>=20}"}, "agg_mean": {"l_quantity": "A{mean>=20}"}, "agg_min": {"l_extendedprice": "A{min>=5}"}, "agg_max": {"l_extendedprice": "A{max>=5}"},
    "agg_count": {"o_totalprice": "top"}, "agg_count_nonnull": {"o_totalprice": "top"}, "agg_median": {"l_quantity": "A{median>=20}"}, "agg_nunique": {"l_suppkey": "A{nunique>=20}"},
    "agg_std": {"l_quantity": "A{std>=20}"}, "agg_var": {"l_quantity": "A{var>=20}"}, "agg_first": {"l_orderkey": "A{first>=5}"}, "agg_last": {"l_orderkey": "A{last>=5}"},
    "agg_quantile": {"l_quantity": "A{quantile>=20}", "l_extendedprice": "A{quantile>=20, mean>=5}"}, "agg_filter": {"l_extendedprice": "A{max>=20}", "l_quantity": "top", "l_discount": "top"},
    "global_agg": {"o_totalprice": "A{min>=20, max>=20}"}, "case_when": {"o_totalprice": "top"}, "is_in": {"p_size": "top", "p_type": "top"}, "like_contains": {"p_brand": "top", "p_type": "top"},
    "date_year": {"o_orderdate": "T{year}"}, "substring": {"o_totalprice": "top"}, "scalar_subquery": {"c_acctbal": "A{mean>=20}"}, "correlated_subquery": {"p_retailprice": "top"}, "having": {"l_quantity": "top"},
    "tpch_q1": {"l_quantity": "A{sum>=20, mean>=20}", "l_linenumber": "top"}, "tpch_q2": {"r_name": "top", "c_mktsegment": "top"}, "tpch_q3": {"l_shipdate": "top", "c_mktsegment": "top"} | revenue(1),
    "tpch_q4": {"l_shipdate": "top", "o_totalprice": "top"}, "tpch_q5": {"r_name": "top", "o_orderdate": "top"} | revenue(2), "tpch_q6": {"l_shipdate": "top", "l_quantity": "top", "l_extendedprice": "A{sum>=20}", "l_discount": "A{sum>=20}"},
    "tpch_q7": {"c_nationkey": "top", "s_nationkey": "top"} | revenue(3), "tpch_q8": {"r_name": "top", "p_type": "top"} | revenue(4), "tpch_q9": {"p_type": "top"} | revenue(5), "tpch_q10": {"l_returnflag": "top"} | revenue(1),
    "tpch_q11": {"l_extendedprice": "A{sum>=1}", "n_name": "top"}, "tpch_q12": {"o_orderpriority": "top"}, "tpch_q13": {"o_orderpriority": "top", "o_orderkey": "A{count>=1}"}, "tpch_q14": {"p_type": "top", "l_shipdate": "top"} | revenue(20),
    "tpch_q15": {"l_shipdate": "top"} | revenue(5), "tpch_q16": {"s_acctbal": "top", "l_suppkey": "A{nunique>=10}"}, "tpch_q17": {"l_extendedprice": "A{sum>=20}", "l_quantity": "A{mean>=10}", "p_brand": "top"},
    "tpch_q18": {"l_quantity": "A{sum>=1}"}, "tpch_q19": {"l_quantity": "top", "p_brand": "top"} | revenue(20), "tpch_q20": {"l_quantity": "A{sum>=20}", "p_type": "top"}, "tpch_q21": {"o_orderstatus": "top", "l_returnflag": "top"},
    "tpch_q22": {"c_acctbal": "A{sum>=5, mean>=5}"},
    "rollup": {"l_quantity": "A{sum>=20}"}, "joined_sum": {"l_quantity": "A{sum>=20}"}, "cube": {"o_totalprice": "A{mean>=20}"}, "grouping_sets": {"c_acctbal": "A{max>=20}"}, "window_mean": {"o_totalprice": "A{mean>=20}"}, "window_frame": {"l_quantity": "A{sum>=3}"},
    "window_rank": {"o_totalprice": "T{rank}"}, "substring_key": {"o_orderpriority": "T{substring:1:1}"},
}


def guarded_sql(name: str, keys: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """A query of SQL, released under its policies of GUARDS. Without keys any join may repeat rows, and their ids are counted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = PolicyContext(spark)
        for t in named(SQL[name]):
            df = table(spark, sf_dir, t)
            ctx.register(t, df, {c: p for c, p in GUARDS[name].items() if c in df.columns}, keys=[[KEYS[t]]] if keys and t in KEYS else [])
        return ctx.sql(SQL[name]).release()

    return run


def sql_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies from a file, SQL over them."""
    path = f"{files.scratch_dir(spark)}/orders.policy.json"
    orders = table(spark, sf_dir, "orders")
    files.write_parquet(orders.where("o_totalprice > 300000").select("o_orderkey", F.lit(0).alias("o_totalprice")), {"o_totalprice": [parse("A{mean>=20}")]}, path)
    ctx = PolicyContext(spark)
    ctx.register("orders", orders, path, on=["o_orderkey"], missing="clean")
    return ctx.sql("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS m, count(*) AS n FROM orders GROUP BY o_orderstatus").release()


def dsl_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first, last, quantiles, population deviation and a filtered maximum, under policies that allow just these."""
    g = GuardedFrame.register(table(spark, sf_dir, "lineitem"), {"l_quantity": "A{quantile>=20, std>=20, max>=20}", "l_partkey": "A{first>=20, last>=20}"})
    g = g.with_columns(at=col("l_orderkey") * 100 + col("l_linenumber"))
    g = g.group_by("l_returnflag").agg(
        f=("first", col("l_partkey"), "at"), z=("last", col("l_partkey"), "at"), q=("quantile", col("l_quantity"), 0.25), lo=("quantile", col("l_quantity"), 0.9, "lower"),
        sd=("std", col("l_quantity"), 0), hi=("max", col("l_quantity"), col("l_discount") < 0.02), n=("len", None, col("l_tax") > 0.05),
    )
    return g.release().withColumn("sd", F.round("sd", 6))


def dsl_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and largest of a column with NaNs, which go first or are left out, and its values as a list; all columns by a wildcard."""
    g = GuardedFrame.register(table(spark, sf_dir, "lineitem"), {"l_quantity": "A{min>=20, nanmin>=20, nanmax>=20, implode>=20}"})
    g = g.with_columns(v=when(col("l_linenumber") == 3, lit(float("nan")), col("l_quantity"))).select("*").group_by("l_returnflag")
    out = g.agg(lo=("min", col("v")), nlo=("nanmin", col("v")), nhi=("nanmax", col("v")), every=("implode", col("l_quantity"), col("l_linenumber") < 3)).release()
    total = F.aggregate("every", F.lit(0.0), lambda a, x: a + x)
    return out.select("l_returnflag", F.isnan("lo").alias("lo_is_nan"), "nlo", "nhi", F.size("every").cast("long").alias("n"), F.round(total, 2).alias("total"))


def file_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as CSV, JSON and ORC, under policies."""
    part, path = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice"), files.scratch_dir(spark)
    ctx = PolicyContext(spark)
    for form in ("csv", "json", "orc"):
        part.write.format(form).save(f"{path}/{form}")
        ctx.scan(form, f"{path}/{form}", form, schema="p_partkey long, p_type string, p_retailprice double", policies={"p_retailprice": "A{max>=5}"})
    one = "SELECT p_type, max(p_retailprice) AS m, count(*) AS n FROM {} GROUP BY p_type"
    return ctx.sql(" UNION ALL ".join(one.format(form) for form in ("csv", "json", "orc"))).release()


def dsl_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates, unary operators, functions and a ternary, of which some discharge a policy."""
    g = GuardedFrame.register(table(spark, sf_dir, "orders"), {"o_orderdate": "T{year}", "o_totalprice": "T{neg}", "o_custkey": "top"})
    g = g.filter(~col("o_orderpriority").is_in("1-URGENT", "2-HIGH") & col("o_orderpriority").contains("[A-Z]") & (col("o_custkey") > 100) & col("o_totalprice").between(1000, 250000))
    return g.select("o_orderkey", y=col("o_orderdate").year().cast("int"), minus=-col("o_totalprice"), p=col("o_orderpriority").substring(3, 4), band=when(col("o_orderstatus").like("F%") | col("o_orderstatus").ends_with("O"), "x", "y")).release()


def by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances below zero may be seen only as means of 20 customers or more; the others freely."""
    g = GuardedFrame.register(table(spark, sf_dir, "customer"), {"c_acctbal": ByRow(((F.col("c_acctbal") < 0, "A{mean>=20}"),))})
    return g.group_by("c_mktsegment").agg(m=("mean", col("c_acctbal")), n=("len", None)).release().withColumn("m", F.round("m", 4))


def by_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without the protected ones are released as they are."""
    g = GuardedFrame.register(table(spark, sf_dir, "customer"), {"c_acctbal": ByRow(((F.col("c_acctbal") < 0, "top"),))})
    return g.filter(col("c_acctbal") >= 0).select("c_custkey", "c_acctbal").release()


def by_row_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Balances below zero only as means of 20 or more, those of two segments not at all, the others freely; by SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = PolicyContext(spark)
        rules = ((F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "top"), (F.col("c_acctbal") < 0, "A{mean>=20}"))
        ctx.register("customer", table(spark, sf_dir, "customer"), {"c_acctbal": ByRow(rules)}, keys=[["c_custkey"]])
        ctx.register("orders", table(spark, sf_dir, "orders"))
        ctx.register("nation", table(spark, sf_dir, "nation"), keys=[["n_nationkey"]])
        return ctx.sql(text).release()

    return run


#: SQL over policies that vary by row; DuckDB runs the same.
BY_ROW = {
    "by_row_sql": "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment",
    "by_row_sql_filter": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "by_row_sql_join": "SELECT n_name, o_orderkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' WHERE c_acctbal > 5000 AND c_mktsegment = 'HOUSEHOLD'",
    "by_row_sql_case": "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0.0 ELSE c_acctbal END AS shown FROM customer",
    "by_row_sql_cte": "WITH good AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'HOUSEHOLD'), bad AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'HOUSEHOLD') SELECT x.mean, y.k, y.best FROM (SELECT round(avg(v), 4) AS mean FROM (SELECT v FROM good UNION ALL SELECT v FROM bad) u) x CROSS JOIN (SELECT k, max(v) AS best FROM good GROUP BY k) y",
}


def dense_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each cell by the place of its row, from a file."""
    path = f"{files.scratch_dir(spark)}/customer.cells"
    customer = table(spark, sf_dir, "customer")
    ids = positions(customer).select(F.col("_position").alias("position"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("c_acctbal"))
    files.write_dense(ids, {"c_acctbal": [parse("clean"), parse("A{mean>=20}")]}, path)
    ctx = PolicyContext(spark)
    ctx.register("customer", customer, path)
    return ctx.sql("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY c_mktsegment").release()


def agg_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each group by their places in the table."""
    g = GuardedFrame.indexed(table(spark, sf_dir, "orders"), {"o_totalprice": "top"}).group_by("o_orderpriority").agg(rows=("groups", col("row")))
    at = F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x * (x % 97))
    return g.release().select("o_orderpriority", F.size("rows").cast("long").alias("n"), F.col("rows")[0].alias("lo"), F.element_at("rows", -1).alias("hi"), at.alias("mixed"))


def one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GuardedFrame.indexed(table(spark, sf_dir, "orders"), {"o_totalprice": "top"})
    return g.group(o_orderstatus="F", o_orderpriority="1-URGENT").select("row", "o_orderkey").release()


def nary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of several arguments, which the policy names."""
    g = GuardedFrame.register(table(spark, sf_dir, "customer"), {"c_name": "T{regexp_replace:[0-9]:#}", "c_mktsegment": "T{substring:1:3}"})
    return g.select("c_custkey", name=col("c_name").regexp_replace("[0-9]", "#"), seg=col("c_mktsegment").substring(1, 3)).release()


def people(spark: SparkSession, sf_dir: str, **policies: str) -> GuardedFrame:
    return GuardedFrame.register(table(spark, sf_dir, "customer"), policies).with_columns(band=when(col("c_acctbal") < 0, "owes", when(col("c_acctbal") < 5000, "low", "high")))


def k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = people(spark, sf_dir, c_nationkey="T{k_anonymous:15}", c_mktsegment="T{k_anonymous:15}")
    return anonymity.k_anonymous(g, ["c_nationkey", "c_mktsegment"], 15, suppress=True).select("c_custkey", "c_nationkey", "c_mktsegment").release()


def l_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = people(spark, sf_dir)
    return anonymity.l_diverse(g, ["c_nationkey", "c_mktsegment"], "band", 3, suppress=True).select("c_custkey", "band").release()


def t_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = people(spark, sf_dir)
    return anonymity.t_close(g, ["c_nationkey"], "band", 0.08, suppress=True).select("c_custkey", "c_nationkey").release()


GUARDED_SQL = list(SQL)
#: Queries that also run without declared keys.
BY_IDS = ("joined_sum", "tpch_q14", "tpch_q20")


def micro(which: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = GuardedFrame.register(table(spark, sf_dir, "lineitem"), {"l_discount": MICRO[which]})
        e = col("l_discount") + 1.0 if which in "cd" else col("l_discount")
        return g.group_by("l_returnflag").agg(m=("max", e)).release()

    return run


DAYS, SUMS = {"o_orderdate": "T{dt.offset_by:5s}"}, {"o_totalprice": "A{sum>=2}"}
ROWS = {"o_totalprice": ByRow((("o_orderstatus = 'F'", "top"), ("o_orderstatus = 'O'", "A{sum>=2}")))}


def dsl_cases(orders: DataFrame, nation: DataFrame) -> dict[str, tuple[Callable[[], GuardedFrame], str]]:
    """Of GuardedFrames: what makes one, and whether it may be released."""
    days, sums = lambda: GuardedFrame.register(orders, DAYS), lambda p="A{sum>=2}": GuardedFrame.register(orders, {"o_totalprice": p})
    later = lambda s="5s": days().select("o_orderstatus", "o_totalprice", at=offset_by(col("o_orderdate"), s))
    price, n = col("o_totalprice"), nation.select(F.col("n_nationkey").alias("n"))
    first, noise = col("o_orderkey") == orders.agg(F.min("o_orderkey")).first()[0], {"o_totalprice": "N{0.5,}"}
    noisy = lambda e: GuardedFrame.register(orders, noise).select(x=price.clip(0, 10**6).laplace(e))
    return {
        "query_fail": (lambda: days().filter(lit(1) < col("o_orderkey")).group_by("o_orderstatus").agg(s=("max", col("o_orderdate"))), "deny"),
        "query_ok": (lambda: later().group_by("at").agg(s=("sum", price)), "allow"),
        "non_single": (lambda: days().filter(col("o_orderdate") < lit("1999-01-01").cast("timestamp")).select("o_orderkey", at=offset_by(col("o_orderdate"), "5s")), "allow"),
        "expr_in_agg_ok": (lambda: later().group_by("o_orderstatus").agg(s=("max", col("at"))), "allow"),
        "expr_in_agg_fail": (lambda: later("4s").group_by("at").agg(s=("sum", price)), "deny"),
        "expr_within_agg_ok": (lambda: days().group_by("o_orderstatus").agg(s=("max", offset_by(col("o_orderdate"), "5s"))), "allow"),
        "union_ok": (lambda: later().union(later()), "allow"), "union_fail": (lambda: days().union(days()), "deny"),
        "join_fail": (lambda: days().select("o_orderdate", "o_orderkey").join(days().select("o_orderdate", c=col("o_custkey")), ["o_orderdate"]), "deny"),
        "groupsize_fail": (lambda: sums().group_by("o_orderkey").agg(s=("sum", price)), "deny"),
        "groupsize_ok": (lambda: sums().group_by("o_orderstatus").agg(s=("sum", price)), "allow"),
        "wrong_method": (lambda: sums().group_by("o_orderstatus").agg(s=("mean", price)), "deny"),
        "ternary_fail": (lambda: days().select(x=when(col("o_orderkey") > 0, col("o_orderdate"), lit("2000-01-01").cast("timestamp"))), "deny"),
        "ternary_ok": (lambda: days().select(x=when(col("o_orderkey") < 0, col("o_orderdate"), lit("2000-01-01").cast("timestamp"))), "allow"),
        "ternary_one": (lambda: sums().select(x=when(first, price, 0.0)).agg(s=("sum", col("x"))), "deny"),
        "ternary_two": (lambda: sums().select(x=when(col("o_orderstatus") == "F", price, 0.0)).agg(s=("sum", col("x"))), "allow"),
        "ternary_beside": (lambda: sums().agg(s=("sum", price - when(first, 0.0, price))), "deny"),
        "ternary_kept_beside": (lambda: sums().with_columns(x=when(first, 0.0, price)).agg(s=("sum", price - col("x"))), "deny"),
        "chain_ok": (lambda: sums("T{+:1} => A{max>=5}").group_by("o_orderstatus").agg(m=("max", price + 1)), "allow"),
        "chain_fail": (lambda: sums("T{+:1} => A{max>=5}").group_by("o_orderkey").agg(m=("max", price + 1)), "deny"),
        "filter_one": (lambda: sums().agg(s=("sum", price, first)), "deny"),
        "repeated_one": (lambda: sums().filter(first).with_columns(k=lit(1)).join(GuardedFrame.register(n).with_columns(k=lit(1)), ["k"]).agg(s=("sum", price)), "deny"),
        "repeated_all": (lambda: sums().with_columns(k=lit(1)).join(GuardedFrame.register(n).with_columns(k=lit(1)), ["k"]).agg(s=("sum", price)), "allow"),
        "twice_one": (lambda: sums().filter(first).union(sums().filter(first)).agg(s=("sum", price)), "deny"),
        "other_case": (lambda: GuardedFrame.register(orders, {"o_totalprice": "top"}).with_columns(O_OrderKey=price).select("o_orderkey"), "deny"),
        "noise_ok": (lambda: noisy(0.5), "allow"), "noise_fail": (lambda: noisy(2.0), "deny"),
        "noisy_sum": (lambda: GuardedFrame.register(orders, noise).group_by("o_orderstatus").agg(s=("laplace_sum", price.clip(0, 10**6), 0.5)), "allow"),
        "by_row_fail": (lambda: GuardedFrame.register(orders, ROWS).select("o_totalprice"), "deny"),
        "by_row_ok": (lambda: GuardedFrame.register(orders, ROWS).filter(col("o_orderstatus") == "P").select("o_totalprice"), "allow"),
    }


#: (policies of orders, SQL over orders and nation, verdict); %d is the least o_orderkey.
SQL_CASES: dict[str, tuple[dict, str, str]] = {
    "sql_fail": (DAYS, "SELECT o_orderdate, o_custkey + 1 AS c FROM orders WHERE o_custkey > 1", "deny"),
    "sql_ok": (DAYS, "SELECT o_orderdate + INTERVAL '5' SECOND AS later, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-02'", "allow"),
    "outer_column": ({"o_totalprice": "top"}, "SELECT (SELECT o.o_totalprice) AS x FROM orders o", "deny"),
    "outer_lateral": ({"o_totalprice": "top"}, "SELECT t.x FROM orders o, LATERAL (SELECT o.o_totalprice AS x) t", "deny"),
    "outer_lateral_union": ({"o_totalprice": "top"}, "SELECT t.x FROM orders o, LATERAL (SELECT o.o_totalprice AS x UNION ALL SELECT o.o_totalprice) t", "deny"),
    "outer_explode": ({"o_totalprice": "top"}, "SELECT t.x FROM orders o, LATERAL (SELECT explode(array(o.o_totalprice)) AS x) t", "deny"),
    "outer_in_aggregate": ({"o_totalprice": "A{max>=9}"}, "SELECT max(x) AS m FROM (SELECT (SELECT o.o_totalprice) AS x FROM orders o)", "deny"),
    "lateral": ({"o_totalprice": "top"}, "SELECT t.p FROM nation n, LATERAL (SELECT o_totalprice AS p FROM orders LIMIT 1) t", "deny"),
    "lateral_ok": ({"o_totalprice": "top"}, "SELECT t.p FROM nation n, LATERAL (SELECT o_orderkey AS p FROM orders WHERE o_custkey = n.n_nationkey) t", "allow"),
    "exists_ok": ({"o_totalprice": "top"}, "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = n_nationkey AND o_totalprice > 9)", "allow"),
    "command": ({"o_totalprice": "top"}, "INSERT OVERWRITE DIRECTORY '/tmp/never-written' USING parquet SELECT o_totalprice FROM orders", "deny"),
    "create_view": ({"o_totalprice": "top"}, "CREATE OR REPLACE TEMP VIEW never_made AS SELECT o_totalprice FROM orders", "deny"),
    "other_view": ({"o_totalprice": "top"}, "SELECT o_totalprice FROM never_registered", "deny"),
    "other_database": ({"o_totalprice": "top"}, "SELECT o_totalprice FROM global_temp.orders", "deny"),
    "agg_filter_one": (SUMS, "SELECT sum(o_totalprice) FILTER (WHERE o_orderkey = %d) AS s FROM orders", "deny"),
    "agg_filter_two": (SUMS, "SELECT sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS s FROM orders", "allow"),
    "case_one": (SUMS, "SELECT sum(CASE WHEN o_orderkey = %d THEN o_totalprice END) AS s FROM orders", "deny"),
    "case_one_below": (SUMS, "SELECT sum(x) AS s FROM (SELECT CASE WHEN o_orderkey = %d THEN o_totalprice ELSE 0 END AS x FROM orders)", "deny"),
    "case_two": (SUMS, "SELECT sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS s FROM orders", "allow"),
    "case_difference": (SUMS, "SELECT sum(o_totalprice - CASE WHEN o_orderkey = %d THEN 0 ELSE o_totalprice END) AS s FROM orders", "deny"),
    "joined_one": (SUMS, "SELECT sum(o_totalprice) AS s FROM orders, nation WHERE o_orderkey = %d", "deny"),
    "joined_all": (SUMS, "SELECT n_name, sum(o_totalprice) AS s FROM orders, nation GROUP BY n_name", "allow"),
    "joined_by_key": (SUMS, "SELECT sum(o_totalprice) AS s FROM orders JOIN nation ON o_orderkey = n_nationkey", "allow"),
    "padded_one": (SUMS, "SELECT sum(o_totalprice) AS s FROM nation LEFT JOIN orders ON o_orderkey = %d AND n_nationkey = 1", "deny"),
    "twice_one_sql": (SUMS, "SELECT sum(p) AS s FROM (SELECT o_totalprice AS p FROM orders WHERE o_orderkey = %d UNION ALL SELECT o_totalprice FROM orders WHERE o_orderkey = %d)", "deny"),
    "distinct_one": (SUMS, "SELECT sum(p) AS s FROM (SELECT DISTINCT o_totalprice AS p, n_name FROM orders, nation WHERE o_orderkey = %d)", "deny"),
    "cte_self_join": (SUMS, "WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS g, o_totalprice AS p FROM orders) SELECT x.g, sum(y.p) AS s FROM t x JOIN t y ON x.k = y.k GROUP BY x.g", "allow"),
    "cte_self_join_one": (SUMS, "WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS g, o_totalprice AS p FROM orders) SELECT x.k, sum(y.p) AS s FROM t x JOIN t y ON x.g = y.g WHERE y.k = %d GROUP BY x.k", "deny"),
    "correlated_groups": (SUMS, "SELECT n_name, (SELECT sum(o_totalprice) FROM orders WHERE o_custkey % 7 = n_nationkey) AS s FROM nation", "allow"),
    "correlated_ones": (SUMS, "SELECT n_name, (SELECT sum(o_totalprice) FROM orders WHERE o_orderkey = n_nationkey) AS s FROM nation", "deny"),
    "having_one": (SUMS, "SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING sum(o_totalprice) > 100", "deny"),
    "rollup_ok": (SUMS, "SELECT o_orderstatus, sum(o_totalprice) AS s FROM orders GROUP BY ROLLUP (o_orderstatus)", "allow"),
    "rollup_one": (SUMS, "SELECT o_orderkey, sum(o_totalprice) AS s FROM orders GROUP BY ROLLUP (o_orderkey)", "deny"),
    "window_ok": (SUMS, "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS s FROM orders", "allow"),
    "window_sliding": (SUMS, "SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS s FROM orders", "deny"),
    "window_by_row": (ROWS, "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS s FROM orders WHERE o_orderstatus <> 'F'", "allow"),
    "window_by_row_top": (ROWS, "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS s FROM orders", "deny"),
    "window_first": (SUMS, "SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderkey) AS s FROM orders", "deny"),
    "window_rank_fail": ({"o_totalprice": "top"}, "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) AS r FROM orders", "deny"),
    "window_order": ({"o_totalprice": "top"}, "SELECT o_orderkey, count(*) OVER (ORDER BY o_totalprice) AS r FROM orders", "deny"),
    "by_row_all": (ROWS, "SELECT o_totalprice FROM orders", "deny"),
    "by_row_clean": (ROWS, "SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P'", "allow"),
    "by_row_sum": (ROWS, "SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority", "allow"),
    "by_row_top": (ROWS, "SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY o_orderpriority", "deny"),
    "by_row_padded": (ROWS, "SELECT n_name, o_totalprice FROM nation LEFT JOIN orders ON o_orderkey = n_nationkey AND o_orderstatus = 'P'", "allow"),
    "nary_ok": ({"o_orderpriority": "T{substring:1:1}"}, "SELECT substring(o_orderpriority, 1, 1) AS p FROM orders", "allow"),
    "nary_more": ({"o_orderpriority": "T{substring:1:1}"}, "SELECT substring(o_orderpriority, 1, 2) AS p FROM orders", "deny"),
    "quantile_ok": ({"o_totalprice": "A{quantile>=3}"}, "SELECT percentile(o_totalprice, 0.5) AS m FROM orders", "allow"),
}


def cases(spark: SparkSession, sf_dir: str) -> dict[str, tuple[Callable[[], GuardedFrame], str]]:
    """The acceptance cases, over orders and nation: what makes a frame, and the verdict on it."""
    orders, nation = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    orders.createOrReplaceTempView("never_registered")
    orders.createOrReplaceGlobalTempView("orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]

    def sql(policies: dict, text: str) -> GuardedFrame:
        ctx = PolicyContext(spark)
        ctx.register("orders", orders, policies, keys=[["o_orderkey"]])
        ctx.register("nation", nation, keys=[["n_nationkey"]])
        return ctx.sql(text.replace("%d", str(first)))

    made = {k: (lambda p=p, text=text: sql(p, text), verdict) for k, (p, text, verdict) in SQL_CASES.items()}
    return dsl_cases(orders, nation) | made


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(make: Callable[[], GuardedFrame]) -> str:
        try:
            return make().verdict()
        except PolicyViolation:
            return "deny"

    return spark.createDataFrame([(k, of(f)) for k, (f, _) in cases(spark, sf_dir).items()], "name string, verdict string")


EXPECTED = {k: v for k, (_, _, v) in SQL_CASES.items()} | {
    "query_fail": "deny", "query_ok": "allow", "non_single": "allow", "expr_in_agg_ok": "allow", "expr_in_agg_fail": "deny", "expr_within_agg_ok": "allow", "union_ok": "allow", "union_fail": "deny", "join_fail": "deny",
    "groupsize_fail": "deny", "groupsize_ok": "allow", "wrong_method": "deny", "ternary_fail": "deny", "ternary_ok": "allow", "ternary_one": "deny", "ternary_two": "allow", "ternary_beside": "deny", "ternary_kept_beside": "deny",
    "chain_ok": "allow", "chain_fail": "deny", "filter_one": "deny", "repeated_one": "deny", "repeated_all": "allow", "twice_one": "deny", "other_case": "deny", "noise_ok": "allow", "noise_fail": "deny", "noisy_sum": "allow",
    "by_row_fail": "deny", "by_row_ok": "allow",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: run_sql(v) for k, v in SQL.items()} | {
    "guarded_q1": guarded_q1, "groupsize_ok": groupsize_ok, "groupsize_suppress": groupsize_suppress, "offset_by": offset, "verdicts": verdicts, "by_row": by_row, "by_row_filter": by_row_filter, "sql_entry": sql_entry, "dsl_aggregates": dsl_aggregates, "dsl_expressions": dsl_expressions,
    "dsl_nan": dsl_nan, "file_scans": file_scans, "dense_policies": dense_policies, "agg_groups": agg_groups, "one_group": one_group, "nary": nary, "k_anonymity": k_anonymity, "l_diversity": l_diversity, "t_closeness": t_closeness,
} | {k: by_row_sql(v) for k, v in BY_ROW.items()} | {f"guarded_sql_{k}": guarded_sql(k) for k in GUARDED_SQL} | {f"guarded_by_ids_{k}": guarded_sql(k, False) for k in BY_IDS} | {f"micro_policy_{k}": micro(k) for k in MICRO}
BAND = "SELECT *, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer"
ORACLES: dict[str, str] = SQL | BY_ROW | {
    "dsl_nan": "SELECT l_returnflag, true AS lo_is_nan, min(v) AS nlo, max(v) AS nhi, count(*) FILTER (WHERE l_linenumber < 3) AS n, round(sum(l_quantity) FILTER (WHERE l_linenumber < 3), 2) AS total FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS v FROM lineitem) GROUP BY 1",
    "file_scans": "SELECT p_type, max(p_retailprice) AS m, count(*) AS n FROM part, range(3) GROUP BY p_type, range",
    "dense_policies": "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1",
    "agg_groups": "SELECT o_orderpriority, count(*) AS n, min(r) AS lo, max(r) AS hi, CAST(sum(r * (r % 97)) AS BIGINT) AS mixed FROM (SELECT *, row_number() OVER () - 1 AS r FROM orders) GROUP BY 1",
    "one_group": "SELECT r AS row, o_orderkey FROM (SELECT *, row_number() OVER () - 1 AS r FROM orders) WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "nary": "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '#', 'g') AS name, substring(c_mktsegment, 1, 3) AS seg FROM customer",
    "k_anonymity": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= 15",
    "l_diversity": f"WITH p AS ({BAND}), ok AS (SELECT c_nationkey, c_mktsegment FROM p GROUP BY 1, 2 HAVING count(DISTINCT band) >= 3) SELECT c_custkey, band FROM p JOIN ok USING (c_nationkey, c_mktsegment)",
    "t_closeness": f"WITH p AS ({BAND}), v AS (SELECT band, count(*) * 1.0 / (SELECT count(*) FROM p) AS whole FROM p GROUP BY 1), c AS (SELECT c_nationkey, count(*) AS size FROM p GROUP BY 1), cv AS (SELECT c_nationkey, v.band, whole, (SELECT count(*) FROM p WHERE p.c_nationkey = c.c_nationkey AND p.band = v.band) * 1.0 / size AS own FROM c CROSS JOIN v) SELECT c_custkey, c_nationkey FROM p WHERE c_nationkey IN (SELECT c_nationkey FROM cv GROUP BY 1 HAVING sum(abs(own - whole)) / 2 <= 0.08)",
    "guarded_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-05' GROUP BY 1, 2",
    "groupsize_ok": "SELECT o_orderstatus, max(o_totalprice) AS m FROM orders GROUP BY 1",
    "groupsize_suppress": "SELECT c_nationkey, max(c_acctbal) AS m FROM customer GROUP BY 1 HAVING count(*) >= 60",
    "by_row": "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m, count(*) AS n FROM customer GROUP BY 1",
    "by_row_filter": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0",
    "sql_entry": "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS m, count(*) AS n FROM orders GROUP BY 1",
    "dsl_aggregates": "SELECT l_returnflag, min_by(l_partkey, l_orderkey * 100 + l_linenumber) AS f, max_by(l_partkey, l_orderkey * 100 + l_linenumber) AS z, quantile_cont(l_quantity, 0.25) AS q, list_sort(list(l_quantity))[1 + CAST(floor((count(*) - 1) * CAST(0.9 AS DOUBLE)) AS BIGINT)] AS lo, round(stddev_pop(l_quantity), 6) AS sd, max(l_quantity) FILTER (WHERE l_discount < 0.02) AS hi, count(*) FILTER (WHERE l_tax > 0.05) AS n FROM lineitem GROUP BY 1",
    "dsl_expressions": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, -o_totalprice AS minus, substring(o_orderpriority, 3, 4) AS p, CASE WHEN o_orderstatus LIKE 'F%' OR o_orderstatus LIKE '%O' THEN 'x' ELSE 'y' END AS band FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND regexp_matches(o_orderpriority, '[A-Z]') AND o_custkey > 100 AND o_totalprice BETWEEN 1000 AND 250000",
    "offset_by": "SELECT event_id, ts + INTERVAL '5' SECOND AS later FROM events",
    "verdicts": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EXPECTED.items()) + ") t(name, verdict)",
} | {f"guarded_sql_{k}": SQL[k] for k in GUARDED_SQL} | {f"guarded_by_ids_{k}": SQL[k] for k in BY_IDS} | {f"micro_policy_{k}": f"SELECT l_returnflag, max(l_discount{' + 1.0' if k in 'cd' else ''}) AS m FROM lineitem GROUP BY 1" for k in MICRO}
