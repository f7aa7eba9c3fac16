"""Projection, filters, joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.pairs import pairs_within
from rulespark.queries import Tables, query
from rulespark.rules import Atom, Expr, FlatMap, GroupBy, Head, Inspect, Let, Not, Where


@query("SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND o_totalprice > 1000 GROUP BY n_name")
def q_join_inner(t: Tables) -> DataFrame:
    p = t.program("customer", "orders", "nation")
    p.relation("revenue", "nation", "n_orders", "revenue")
    p.rule(
        Head("revenue", nation="name", n_orders="n", revenue="total"),
        Atom("orders", o_orderkey="order", o_custkey="c", o_totalprice="price"), Where("price > 1000"), Atom("customer", c_custkey="c", c_nationkey="k"), Atom("nation", n_nationkey="k", n_name="name"),
        GroupBy(("name",), {"n": "count(1)", "total": "round(sum(price), 2)"}, of=("name", "order", "price"), distinct=False),
    )
    return p.result("revenue")


@query("SELECT DISTINCT l_orderkey AS k, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")
def q_map_filter(t: Tables) -> DataFrame:
    p = t.program("lineitem")
    p.relation("net", "k", "line", "net")
    p.rule(Head("net", k="k", line="n", net="v"), Atom("lineitem", l_orderkey="k", l_linenumber="n", l_quantity="q", l_extendedprice="x", l_discount="d", l_returnflag="f"), Where("q > 40 and f = 'R'"), Let("v", "x * (1 - d)"))
    return p.result("net")


@query("SELECT DISTINCT s_suppkey AS k, s_name AS name FROM supplier WHERE s_nationkey = 3")
def q_pattern_constant(t: Tables) -> DataFrame:
    p = t.program("supplier")
    p.relation("out", "k", "name")
    p.rule(Head("out", k="k", name="n"), Atom("supplier", s_suppkey="k", s_name="n", s_nationkey=3))
    return p.result("out")


@query("SELECT DISTINCT o_custkey AS who, o_orderkey AS what FROM orders WHERE o_orderkey = o_custkey")
def q_pattern_repeated_variable(t: Tables) -> DataFrame:
    p = t.program("orders")
    p.relation("out", "who", "what")
    p.rule(Head("out", who="x", what="x"), Atom("orders", o_orderkey="x", o_custkey="x"))
    return p.result("out")


@query("SELECT c_custkey AS k, c_name || '/' || c_mktsegment AS label FROM customer WHERE c_acctbal > 5000")
def q_row_binding(t: Tables) -> DataFrame:
    p = t.program("customer")
    p.relation("out", "k", "label")
    p.rule(Head("out", k=Expr("row.c_custkey"), label=Expr("concat(row.c_name, '/', row.c_mktsegment)")), Atom("customer", bind="row"), Where("row.c_acctbal > 5000"))
    return p.result("out")


@query("SELECT DISTINCT n_name AS name, 'customer' AS kind FROM nation JOIN customer ON n_nationkey = c_nationkey UNION SELECT DISTINCT n_name, 'region ' || r_name FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey")
def q_multihead(t: Tables) -> DataFrame:
    p = t.program("nation", "customer", "region")
    p.relation("tag", "name", "kind")
    p.rule(
        (Head("tag", name="n", kind=Expr("'customer'")), Head("tag", name="n", kind=Expr("concat('region ', r)"))),
        Atom("nation", n_nationkey="k", n_name="n", n_regionkey="g"), Atom("customer", c_nationkey="k"), Atom("region", r_regionkey="g", r_name="r"),
    )
    return p.result("tag")


@query("SELECT DISTINCT p_partkey AS k, unnest(string_split(p_name, ' ')) AS word FROM part")
def q_flatmap_vec(t: Tables) -> DataFrame:
    p = t.program("part")
    p.relation("out", "k", "word")
    p.rule(Head("out", k="k", word="w"), Atom("part", p_partkey="k", p_name="n"), FlatMap("w", "split(n, ' ')"))
    return p.result("out")


@query("SELECT DISTINCT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def q_flatmap_events_json(t: Tables) -> DataFrame:
    p = t.program("events")
    p.relation("out", "id", "k")
    p.rule(Head("out", id="e", k="k"), Atom("events", event_id="e", props="j"), Let("k", "cast(get_json_object(j, '$.k') as bigint)", keep_null=False))
    return p.result("out")


@query("SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def q_self_join_pairs(t: Tables) -> DataFrame:
    p = t.program("supplier")
    p.relation("pair", "a", "b")
    p.apply(lambda s: pairs_within(s, "s_nationkey", "s_suppkey", "a", "b"), ["supplier"], ["pair"])
    return p.result("pair")


@query("SELECT CAST(d AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d) w ON ts >= d AND ts < d + INTERVAL 1 DAY GROUP BY d")
def q_theta_range_join(t: Tables) -> DataFrame:
    """Windows and events meet on the window's number, so the range needs no product."""
    days = t.spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-31')) as day").withColumn("bucket", F.unix_date("day"))
    events = t.events.select("event_id", "ts", F.unix_date(F.to_date("ts")).alias("bucket"))
    p = t.program(days=days, stamped=events)
    p.relation("out", "day", "n")
    p.rule(
        Head("out", day="d", n="c"), Atom("days", day="d", bucket="b"), Atom("stamped", event_id="e", ts="x", bucket="b"), Where("x >= d and x < d + interval 1 day"), GroupBy(("d",), {"c": "count(1)"}, of=("d", "e"))
    )
    return p.result("out")


@query("SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_semijoin(t: Tables) -> DataFrame:
    p = t.program("customer", "orders")
    p.relation("out", "k")
    p.rule(Head("out", k="k"), Atom("customer", c_custkey="k"), Atom("orders", o_custkey="k", o_orderpriority=Expr("'1-URGENT'")))
    return p.result("out")


@query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_antijoin(t: Tables) -> DataFrame:
    p = t.program("customer", "orders")
    p.relation("out", "k")
    p.rule(Head("out", k="k"), Atom("customer", c_custkey="k"), Not("orders", o_custkey="k"))
    return p.result("out")


@query("SELECT c_custkey AS k, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def q_left_by_negation(t: Tables) -> DataFrame:
    p = t.program("customer", "orders")
    p.relation("has", "k", "n")
    p.relation("out", "k", "n")
    p.rule(Head("has", k="k", n="c"), Atom("orders", o_custkey="k", o_orderkey="o"), GroupBy(("k",), {"c": "count(1)"}, distinct=False))
    p.rule(Head("out", k="k", n="n"), Atom("customer", c_custkey="k"), Atom("has", k="k", n="n"))
    p.rule(Head("out", k="k", n=Expr("0L")), Atom("customer", c_custkey="k"), Not("has", k="k"))
    return p.result("out")


@query("SELECT r_name AS r, n_name AS n FROM region, nation")
def q_cross_join(t: Tables) -> DataFrame:
    p = t.program("region", "nation")
    p.relation("out", "r", "n")
    p.rule(Head("out", r="a", n="b"), Atom("region", r_name="a"), Atom("nation", n_name="b"))
    return p.result("out")


@query("SELECT DISTINCT l_orderkey AS o, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5 AND l_quantity >= 45")
def q_join_filtered(t: Tables) -> DataFrame:
    p = t.program("lineitem", "part")
    p.relation("out", "o", "brand")
    p.rule(Head("out", o="o", brand="b"), Atom("part", p_partkey="k", p_brand="b", p_size="s"), Where("s < 5"), Atom("lineitem", l_partkey="k", l_orderkey="o", l_quantity="q"), Where("q >= 45"))
    return p.result("out")


@query("SELECT e.event_id AS id, c_name AS name FROM events e JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def q_stream_static_join(t: Tables) -> DataFrame:
    from rulespark.rules import Program

    p = Program(t.spark)
    p.input("events", t.events, kind="stream")
    p.input("customer", t.customer)
    p.relation("out", "id", "name", kind="stream")
    p.rule(Head("out", id="e", name="n"), Atom("events", event_id="e", user_id="u", event_type=Expr("'purchase'")), Atom("customer", c_custkey="u", c_name="n"))
    return p.result("out")


@query("SELECT DISTINCT e.event_id AS id FROM events e WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal < 0)")
def q_stream_semijoin(t: Tables) -> DataFrame:
    from rulespark.rules import Program

    p = Program(t.spark)
    p.input("events", t.events, kind="stream")
    p.input("poor", t.customer.where("c_acctbal < 0"))
    p.relation("out", "id", kind="stream")
    p.rule(Head("out", id="e"), Atom("poor", c_custkey="u"), Atom("events", event_id="e", user_id="u"))
    return p.result("out").distinct()


@query("SELECT DISTINCT x.a AS a, x.b AS b FROM (SELECT {'n': n_nationkey, 'r': n_regionkey} AS s, n_name AS a FROM nation) y JOIN (SELECT r_regionkey AS r, r_name AS b FROM region) z ON y.s.r = z.r, LATERAL (SELECT y.a AS a, z.b AS b) x")
def q_join_nested_field(t: Tables) -> DataFrame:
    nested = t.nation.select(F.struct(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r")).alias("s"), "n_name")
    p = t.program("region", nested=nested)
    p.relation("out", "a", "b")
    p.rule(Head("out", a="a", b="b"), Atom("nested", s={"r": "r"}, n_name="a"), Atom("region", r_regionkey="r", r_name="b"))
    return p.result("out")


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def q_union(t: Tables) -> DataFrame:
    p = t.program("nation", "region")
    p.relation("out", "name")
    p.rule(Head("out", name="x"), Atom("nation", n_name="x"))
    p.rule(Head("out", name="x"), Atom("region", r_name="x"))
    return p.result("out")


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def q_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events")
def q_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.events.select("user_id"))


@query("SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
def q_distinct_output(t: Tables) -> DataFrame:
    p = t.program("part")
    p.relation("out", "brand", "size")
    p.rule(Head("out", brand="b", size="s"), Atom("part", p_brand="b", p_size="s"))
    return p.result("out")


@query("SELECT DISTINCT p_partkey AS k, p_name AS name FROM part WHERE p_size = 1")
def q_inspect(t: Tables) -> DataFrame:
    p = t.program("part")
    p.relation("out", "k", "name")
    p.rule(Head("out", k="k", name="n"), Atom("part", p_partkey="k", p_name="n", p_size=1), Inspect("small parts", {"rows": "count(1)"}))
    return p.result("out")


@query("SELECT * FROM (VALUES (1, 'low'), (2, 'middle'), (3, 'high')) v(level, name)")
def q_ground_facts(t: Tables) -> DataFrame:
    p = t.program()
    p.relation("level", "level", "name")
    for n, name in enumerate(("low", "middle", "high"), 1):
        p.rule(Head("level", level=n, name=Expr(f"'{name}'")))
    return p.result("level")


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_custkey = 7")
def q_query_index(t: Tables) -> DataFrame:
    p = t.program("orders")
    p.index("by_customer", "orders", "o_custkey")
    return p.lookup("by_customer", 7).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))


@query("""WITH e AS (SELECT ts, user_id, event_id FROM events), o AS (SELECT o_orderdate, o_custkey, o_orderkey FROM orders)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e WHERE EXISTS (SELECT 1 FROM o WHERE o_custkey = user_id AND o_orderdate <= ts)""")
def q_exists_before(t: Tables) -> DataFrame:
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    p = t.program("events", first=first)
    p.relation("out", "n", "ids")
    p.rule(Head("out", n="c", ids="s"), Atom("events", event_id="e", user_id="u", ts="x"), Atom("first", o_custkey="u", first="f"), Where("f <= x"), GroupBy((), {"c": "count(1)", "s": "sum(e)"}, of=("e",)))
    return p.result("out")


@query("""WITH grp AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
allowed AS (SELECT a.n_name AS src, b.n_name AS dst FROM grp a JOIN grp b ON a.r_name = b.r_name WHERE a.n_name <> b.n_name),
blocked AS (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)
SELECT src, dst FROM allowed WHERE src NOT IN (SELECT n_name FROM blocked) AND dst NOT IN (SELECT n_name FROM blocked)""")
def q_firewall_policy(t: Tables) -> DataFrame:
    p = t.program("nation", "region")
    p.relation("member", "name", "zone")
    p.relation("allowed", "src", "dst")
    p.relation("blocked", "name")
    p.relation("policy", "src", "dst")
    p.rule(Head("member", name="n", zone="z"), Atom("nation", n_name="n", n_regionkey="k"), Atom("region", r_regionkey="k", r_name="z"))
    p.rule(Head("allowed", src="a", dst="b"), Atom("member", name="a", zone="z"), Atom("member", name="b", zone="z"), Where("a <> b"))
    p.rule(Head("blocked", name="n"), Atom("nation", n_nationkey="k", n_name="n"), Where("k % 5 = 0"))
    p.rule(Head("policy", src="a", dst="b"), Atom("allowed", src="a", dst="b"), Not("blocked", name="a"), Not("blocked", name="b"))
    return p.result("policy")


@query("""WITH used AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS used FROM lineitem GROUP BY 1)
SELECT s_suppkey AS k, 20000 - coalesce(used, 0) AS spare FROM supplier LEFT JOIN used ON l_suppkey = s_suppkey WHERE 20000 - coalesce(used, 0) > 0""")
def q_scheduler_spare_capacity(t: Tables) -> DataFrame:
    p = t.program("supplier", "lineitem")
    p.relation("used", "k", "q")
    p.relation("spare", "k", "spare")
    p.rule(Head("used", k="k", q="q"), Atom("lineitem", l_suppkey="k", l_quantity="x"), GroupBy(("k",), {"q": "round(sum(x), 2)"}, distinct=False))
    p.rule(Head("spare", k="k", spare=Expr("20000 - q")), Atom("supplier", s_suppkey="k"), Atom("used", k="k", q="q"), Where("20000 - q > 0"))
    p.rule(Head("spare", k="k", spare=Expr("20000D")), Atom("supplier", s_suppkey="k"), Not("used", k="k"))
    return p.result("spare")
