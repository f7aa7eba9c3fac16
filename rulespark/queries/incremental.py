"""Weighted relations, changes of commits, streams and their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.datalog import convert
from rulespark.queries import Tables, query
from rulespark.queries.recursion import DAG, edges
from rulespark.rules import Atom, Expr, GroupBy, Head, Not
from rulespark.session import Session
from rulespark.statements import For, If, Insert, rules
from rulespark.zset import WEIGHT, Stream, ZSet, incremental_join


@query("SELECT c AS customer, w AS weight FROM (SELECT c, CAST(sum(w) AS BIGINT) AS w FROM (SELECT o_custkey AS c, 1 AS w FROM orders UNION ALL SELECT c_custkey, -2 FROM customer) GROUP BY c) WHERE w <> 0")
def q_multiset_weights(t: Tables) -> DataFrame:
    plus = ZSet.of(t.orders.select(F.col("o_custkey").alias("customer")))
    minus = ZSet.of(t.customer.select(F.col("c_custkey").alias("customer")), -2)
    return plus.add(minus).df.withColumnRenamed(WEIGHT, "weight")


@query("SELECT k, w AS weight FROM (SELECT k, CAST(sum(w) AS BIGINT) AS w FROM (SELECT DISTINCT o_custkey AS k, 1 AS w FROM orders UNION ALL SELECT DISTINCT user_id, -1 FROM events) GROUP BY k) WHERE w <> 0")
def q_zset_minus(t: Tables) -> DataFrame:
    a, b = ZSet.of(t.orders.select(F.col("o_custkey").alias("k"))).distinct(), ZSet.of(t.events.select(F.col("user_id").alias("k"))).distinct()
    return a.minus(b).df.withColumnRenamed(WEIGHT, "weight")


@query("SELECT k, CAST(a.n * b.n AS BIGINT) AS weight FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b USING (k)")
def q_zset_join(t: Tables) -> DataFrame:
    a, b = (ZSet.of(d.select(F.col(c).alias("k"))).consolidate() for d, c in ((t.orders, "o_custkey"), (t.events, "user_id")))
    return a.join(b, ["k"]).df.withColumnRenamed(WEIGHT, "weight")


@query("SELECT p_brand AS brand, CAST(sum(2) AS BIGINT) AS n, CAST(count(DISTINCT p_size) AS BIGINT) AS sizes FROM part GROUP BY 1")
def q_zset_groupcount(t: Tables) -> DataFrame:
    z = ZSet.of(t.part.select(F.col("p_brand").alias("brand"), "p_size"), 2)
    both = z.group_by("brand").count("n").join(z.group_by("brand").distinct_count("sizes"), ["brand"])
    return both.df.select("brand", "n", "sizes")


@query("""WITH old AS (SELECT o_custkey AS c, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 100 <> 0 GROUP BY 1), new AS (SELECT o_custkey AS c, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 100 <> 1 GROUP BY 1)
SELECT c, n, CAST(1 AS BIGINT) AS weight FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT c, n, CAST(-1 AS BIGINT) FROM (SELECT * FROM old EXCEPT SELECT * FROM new)""")
def q_delta_commit(t: Tables) -> DataFrame:
    """Only the groups that a change touches are counted again."""
    key = F.col("o_orderkey") % 100
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("c"))
    old, fresh, gone = rows.where(key != 0), rows.where(key == 0), rows.where(key == 1)
    touched = fresh.unionByName(gone).select("c").distinct()
    count = lambda d: ZSet.of(d.join(touched, "c", "left_semi").groupBy("c").agg(F.count("*").alias("n")))
    new = old.unionByName(fresh).join(gone, "o_orderkey", "left_anti").select("o_orderkey", "c")
    return count(new).minus(count(old)).df.withColumnRenamed(WEIGHT, "weight")


@query("""SELECT k, status FROM (SELECT o_orderkey % 500 AS k, o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderkey % 500 ORDER BY o_orderkey DESC) AS i FROM orders) WHERE i = 1""")
def q_keyed_upsert(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.groupBy((k % 500).alias("k")).agg(F.max_by("o_orderstatus", k).alias("status"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'VIP' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer")
def q_modify(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    changes = base.where("k % 10 = 0").select("k", F.lit("VIP").alias("s"), (F.col("balance") + 1).alias("b"))
    return base.join(changes, "k", "left").select("k", F.coalesce("s", "segment").alias("segment"), F.coalesce("b", "balance").alias("balance"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) SELECT x.day AS day, x.n AS now, coalesce(y.n, 0) AS before, x.n - coalesce(y.n, 0) AS change FROM d x LEFT JOIN d y ON y.day = x.day - 1""")
def q_differentiate_delay(t: Tables) -> DataFrame:
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("now"))
    earlier = d.select(F.date_add("day", 1).alias("day"), F.col("now").alias("before"))
    return d.join(earlier, "day", "left").select("day", "now", F.coalesce("before", F.lit(0)).alias("before"), (F.col("now") - F.coalesce("before", F.lit(0))).alias("change"))


@query("SELECT event_id AS id, round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events")
def q_stream_fold(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select(F.col("event_id").alias("id"), F.round(F.sum("value").over(w), 2).alias("running"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type AS kind, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def q_tumbling_window(t: Tables) -> DataFrame:
    made = t.events.groupBy(F.window("ts", "6 hours").alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("w.start").alias("start"), "kind", "n", "total")


@query("""SELECT s AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS s FROM events, (SELECT unnest(generate_series(0, 2)) AS i) h) GROUP BY s""")
def q_sliding_window(t: Tables) -> DataFrame:
    made = t.events.groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), "n")


@query("SELECT u, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id AS u, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events) WHERE fresh = 1 GROUP BY u")
def q_session_window(t: Tables) -> DataFrame:
    made = t.events.groupBy(F.col("user_id").alias("u"), F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return made.groupBy("u").agg(F.count("*").alias("sessions"))


@query("SELECT event_type AS kind, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def q_unique_users(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("users"))


@query("""SELECT o_custkey AS k, CAST(sum(1) AS BIGINT) AS weight FROM orders JOIN (SELECT DISTINCT user_id FROM events) e ON user_id = o_custkey WHERE o_orderkey % 4 < 3 GROUP BY 1""")
def q_incremental_join(t: Tables) -> DataFrame:
    """Changes of three ticks on either side, joined change by change."""
    orders = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey")
    users = t.events.select(F.col("user_id").alias("k")).distinct()
    z = lambda d: ZSet.of(d.select("k")).consolidate()
    left = [z(orders.where(f"o_orderkey % 4 = {i}")) for i in range(3)]
    right = [z(users.where(f"k % 3 = {i}")) for i in range(3)]
    nothing = ZSet.of(users.select("k").limit(0))
    changes = incremental_join(Stream(left, nothing), Stream(right, nothing), ["k"])
    return changes.integrate()[2].df.withColumnRenamed(WEIGHT, "weight")


@query("""SELECT brand, n, CAST(1 AS BIGINT) AS weight FROM (SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 50 <> 1 GROUP BY 1 EXCEPT SELECT p_brand, CAST(count(*) AS BIGINT) FROM part WHERE p_partkey % 50 <> 0 GROUP BY 1)
UNION ALL SELECT brand, n, CAST(-1 AS BIGINT) FROM (SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 50 <> 0 GROUP BY 1 EXCEPT SELECT p_brand, CAST(count(*) AS BIGINT) FROM part WHERE p_partkey % 50 <> 1 GROUP BY 1)""")
def q_session_commit(t: Tables) -> DataFrame:
    """The change of the second of two transactions."""

    def build(p):
        p.relation("brands", "brand", "n", output=True)
        p.rule(Head("brands", brand="b", n="n"), Atom("part", k="k", brand="b"), GroupBy(("b",), {"n": "count(1)"}))

    rows = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"))
    s = Session(t.spark, {"part": ("k long, brand string", "set", ("k",))}, build)
    s.start()
    s.insert("part", rows.where("k % 50 <> 0"))
    s.commit()
    s.start()
    s.insert("part", rows.where("k % 50 = 0"))
    s.delete_key("part", rows.where("k % 50 = 1"))
    return s.commit()["brands"].df.select("brand", "n", F.col(WEIGHT).alias("weight"))


@query("SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS tag FROM part UNION SELECT p_partkey, 'brass' FROM part WHERE contains(p_type, 'BRASS')")
def q_statements(t: Tables) -> DataFrame:
    p = t.program("part")
    p.relation("tag", "k", "tag")
    rules(
        p,
        For(
            Atom("part", p_partkey="k", p_size="s", p_type="t"),
            If("s > 25", Insert("tag", k="k", tag=Expr("'large'")), Insert("tag", k="k", tag=Expr("'small'"))),
            If("contains(t, 'BRASS')", Insert("tag", k="k", tag=Expr("'brass'"))),
        ),
    )
    return p.result("tag")


@query(f"WITH RECURSIVE {DAG}, path AS (SELECT a, b FROM dag UNION SELECT path.a, dag.b FROM path JOIN dag ON path.b = dag.a), node AS (SELECT a AS n FROM dag UNION SELECT b FROM dag) SELECT n AS x, CAST(count(b) AS BIGINT) AS n FROM node LEFT JOIN path ON a = node.n GROUP BY node.n")
def q_datalog_text(t: Tables) -> DataFrame:
    text = """
    .decl edge(x: number, y: number)
    .decl node(x: number)
    .decl path(x: number, y: number)
    .decl reach(x: number, n: number)
    node(x) :- edge(x, _) ; edge(_, x).
    path(x, y) :- edge(x, y).
    path(x, z) :- path(x, y), edge(y, z).
    reach(x, n) :- node(x), n = count : { path(x, y) }.
    """
    return convert(t.spark, text, {"edge": edges(t).where("a < b")}).result("reach")


@query("SELECT c_custkey AS k, 'new' AS state FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'gone' FROM customer WHERE c_custkey % 3 = 1")
def q_rule_delay(t: Tables) -> DataFrame:
    """A relation now and one transaction ago, in one rule each."""
    keys = t.customer.select("c_custkey")
    p = t.program(who=keys.where("c_custkey % 3 <> 1"))
    p.past("who", [keys.where("c_custkey % 3 <> 0")])
    p.relation("old", "k")
    p.relation("state", "k", "state")
    p.rule(Head("old", k="k"), Atom("who", c_custkey="k", delay=1))
    p.rule(Head("state", k="k", state=Expr("'new'")), Atom("who", c_custkey="k"), Not("old", k="k"))
    p.rule(Head("state", k="k", state=Expr("'gone'")), Atom("old", k="k"), Not("who", c_custkey="k"))
    return p.result("state")
