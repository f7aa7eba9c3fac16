"""The SQL front end: tables, views, joins, conditions, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rulespark.queries import Tables, query
from rulespark.sql import Database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def run(t: Tables, *statements: str) -> DataFrame:
    db = Database(t.spark)
    text = " ".join(statements)
    for name in TABLES:
        if name in text:
            db.register(name, getattr(t, name))
    for s in statements[:-1]:
        db.execute(s)
    return db.execute(statements[-1])


def same(name: str, sql: str, spark_sql: str | None = None):
    """A query whose SQL is the same for both, or nearly so."""

    def f(t: Tables) -> DataFrame:
        return run(t, spark_sql or sql)

    f.__name__ = name
    query(sql)(f)


same("q_sql_left", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
same("q_sql_right", "SELECT c_custkey AS k, user_id AS u FROM customer RIGHT JOIN (SELECT DISTINCT user_id FROM events) e ON c_custkey = user_id AND c_acctbal > 0")
same("q_sql_full", "SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT user_id * 2 AS k FROM events) b ON a.k = b.k")
same("q_sql_using", "SELECT k, n_name AS n, r_name AS r FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
same("q_sql_natural", "SELECT k, n_name AS n, r_name AS r FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
same("q_sql_non_equi", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
same("q_sql_comma_cross", "SELECT r_name AS r, s_name AS s FROM region, supplier WHERE s_suppkey < 20")
same("q_in_list", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_size IN (3, 14, 15)")
same("q_in_subquery", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
same("q_not_in_subquery", "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
same("q_sql_aggs", "SELECT o_orderstatus AS s, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS ids, bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 0) AS every FROM orders GROUP BY o_orderstatus")
same("q_having", "SELECT o_custkey AS c, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
same("q_agg_expr", "SELECT p_brand AS b, CAST(sum(p_size) + count(*) * 2 AS BIGINT) AS x, CAST(max(p_size) - min(p_size) AS BIGINT) AS spread FROM part GROUP BY p_brand")
same("q_case_in_agg", "SELECT o_custkey AS c, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders GROUP BY o_custkey")
same("q_array_agg", "SELECT n_regionkey AS r, array_to_string(list_sort(array_agg(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, array_join(array_sort(array_agg(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey")
same("q_sql_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1")
same("q_sql_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
same("q_case_if_between", "SELECT p_partkey AS k, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS word, CASE WHEN p_retailprice BETWEEN 900 AND 1200 THEN 'mid' ELSE 'out' END AS band FROM part")
same("q_null_logic", "SELECT c_custkey AS k, o AS o, (o > 5 AND c_custkey > 100) AS both, (o > 5 OR c_custkey > 100) AS either, o IS NULL AS none, NOT (o > 5) AS low FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders WHERE o_orderkey % 7 = 0 GROUP BY o_custkey) x ON o_custkey = c_custkey")
same("q_concat_substr_abs", "SELECT c_custkey AS k, substr(c_name, 1, 4) || '-' || c_mktsegment AS label, abs(c_acctbal) AS size FROM customer")
same("q_coalesce", "SELECT c_custkey AS k, coalesce(o, -1) AS first FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey")
same("q_casts", "SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS text, CAST(p_size AS DOUBLE) AS size, CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS back, CAST(p_size > 10 AS BOOLEAN) AS big, CAST('2024-02-29' AS DATE) AS day FROM part", "SELECT p_partkey AS k, CAST(p_partkey AS STRING) AS text, CAST(p_size AS DOUBLE) AS size, CAST(CAST(p_size AS STRING) AS INTEGER) AS back, CAST(p_size > 10 AS BOOLEAN) AS big, CAST('2024-02-29' AS DATE) AS day FROM part")
same("q_date_extract", "SELECT event_id AS id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS m, CAST(extract(week FROM ts) AS INTEGER) AS w, CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(doy FROM ts) AS INTEGER) AS doy, CAST(extract(dow FROM ts) AS INTEGER) AS dow, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(minute FROM ts) AS INTEGER) AS mi FROM events", "SELECT event_id AS id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS m, CAST(extract(week FROM ts) AS INTEGER) AS w, CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(doy FROM ts) AS INTEGER) AS doy, CAST(extract(dow FROM ts) - 1 AS INTEGER) AS dow, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(minute FROM ts) AS INTEGER) AS mi FROM events")
same("q_array_contains_len", "SELECT p_partkey AS k, list_contains(string_split(p_type, ' '), 'BRASS') AS brass, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS words FROM part", "SELECT p_partkey AS k, array_contains(split(p_type, ' '), 'BRASS') AS brass, size(split(p_type, ' ')) AS words FROM part")
same("q_with", "WITH big AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(max(n) AS BIGINT) AS most, CAST(count(*) AS BIGINT) AS customers FROM big")

same("q_sql_window", "SELECT o_orderkey AS k, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders")
same("q_sql_limit", "SELECT s_suppkey AS k, s_acctbal AS balance FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
same("q_sql_distinct", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
same("q_sql_set_agg", "SELECT c_mktsegment AS s, CAST(len(list_distinct(array_agg(c_nationkey))) AS INTEGER) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment AS s, size(collect_set(c_nationkey)) AS n FROM customer GROUP BY c_mktsegment")
same("q_sql_subquery_from", "SELECT x.r AS r, CAST(sum(x.n) AS BIGINT) AS n FROM (SELECT n_regionkey AS r, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_regionkey, n_nationkey) x GROUP BY x.r")
same("q_sql_exists", "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")


@query("SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10 GROUP BY c_mktsegment")
def q_view_chain(t: Tables) -> DataFrame:
    return run(
        t,
        "CREATE VIEW rich AS SELECT DISTINCT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 0",
        "CREATE VIEW near AS SELECT c_custkey, c_mktsegment FROM rich WHERE c_nationkey < 10",
        "SELECT c_mktsegment AS segment, count(*) AS n FROM near GROUP BY c_mktsegment",
    )


@query("SELECT * FROM (VALUES ('a', 5, true), ('c', 9, false)) v(id, capacity, up)")
def q_sql_dml(t: Tables) -> DataFrame:
    return run(
        t,
        "create table hosts (id varchar(36) with (primary_key = true), capacity integer, up boolean)",
        "insert into hosts values ('a', 1, true), ('b', 2, true), ('c', 9, false)",
        "update hosts set capacity = 5 where id = 'a'",
        "delete from hosts where id = 'b'",
        "create index by_up on hosts (up)",
        "select id, capacity, up from hosts",
    )
