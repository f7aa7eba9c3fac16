"""Groups, windows, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions import groups as g
from rulespark.functions import sql as s
from rulespark.queries import Tables, query
from rulespark.rules import Atom, GroupBy, Head


@query("SELECT s AS segment, CAST(sum(k) AS BIGINT) AS total FROM (SELECT DISTINCT c_mktsegment AS s, c_nationkey AS k FROM customer) GROUP BY s")
def q_groupby_distinct_semantics(t: Tables) -> DataFrame:
    p = t.program("customer")
    p.relation("out", "segment", "total")
    p.rule(Head("out", segment="s", total="n"), Atom("customer", c_mktsegment="s", c_nationkey="k"), GroupBy(("s",), {"n": "sum(k)"}))
    return p.result("out")


@query("""SELECT p_brand AS brand, min(p_retailprice) AS low, max(p_retailprice) AS high,
arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest FROM part GROUP BY p_brand""")
def q_group_min_max_argmin(t: Tables) -> DataFrame:
    x = t.part
    return x.groupBy(F.col("p_brand").alias("brand")).agg(
        g.min(x.p_retailprice).alias("low"), g.max(x.p_retailprice).alias("high"), g.arg_min(x.p_partkey, x.p_retailprice).alias("cheapest"), g.arg_max(x.p_partkey, x.p_retailprice).alias("dearest")
    )


@query("SELECT o_custkey AS c, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds FROM orders GROUP BY 1")
def q_group_count_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("c")).agg(g.count_distinct(F.col("o_orderpriority")).alias("kinds"))


@query("""SELECT c, max(CASE WHEN i = 1 THEN k END) AS first, max(CASE WHEN i = 3 THEN k END) AS third
FROM (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY c""")
def q_group_nth_first(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.groupBy(F.col("o_custkey").alias("c")).agg(g.first(k).alias("first"), g.nth(k, 2).alias("third"))


@query("SELECT n_regionkey AS r, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS names FROM nation GROUP BY 1")
def q_group_to_set_vec(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.array_join(g.to_set(F.col("n_name")), ",").alias("names"))


@query("SELECT p_size AS size, bool_and(p_retailprice > 900) AS every, bool_or(p_retailprice > 1500) AS some, CAST(count(*) FILTER (p_brand = 'Brand#12') AS BIGINT) AS n FROM part GROUP BY 1")
def q_group_any_all_count_if(t: Tables) -> DataFrame:
    price = F.col("p_retailprice")
    return t.part.groupBy(F.col("p_size").alias("size")).agg(g.all(price > 900).alias("every"), g.any(price > 1500).alias("some"), g.count(F.col("p_brand") == "Brand#12").alias("n"))


@query("SELECT n_regionkey AS r, CAST(list_reduce(list_prepend(1, list_sort(list_distinct(list(n_nationkey + 1)))), lambda a, x: (a * x) % 1000003) AS BIGINT) AS f FROM nation GROUP BY 1")
def q_group_fold(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").alias("r")).agg(g.fold(F.col("n_nationkey").cast("long") + 1, F.lit(1).cast("long"), lambda a, x: (a * x) % 1000003).alias("f"))


@query("""SELECT n_regionkey AS r, array_to_string(list_sort(list_distinct(flatten(list(string_split(lower(n_name), '_'))))), ',') AS words FROM nation GROUP BY 1""")
def q_group_set_union(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.array_join(g.set_unions(F.split(F.lower("n_name"), "_")), ",").alias("words"))


@query("""SELECT r, string_agg(CAST(k AS VARCHAR) || '=' || v, ';' ORDER BY k) AS m FROM
(SELECT c_nationkey % 3 AS r, c_nationkey AS k, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS v FROM customer GROUP BY 1, 2) GROUP BY r""")
def q_group_setmap(t: Tables) -> DataFrame:
    made = t.customer.groupBy((F.col("c_nationkey") % 3).alias("r")).agg(g.to_setmap(F.col("c_nationkey"), F.col("c_mktsegment")).alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return made.select("r", F.array_join(F.transform(entries, lambda e: F.concat(e["k"].cast("string"), F.lit("="), F.array_join(e["v"], ","))), ";").alias("m"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total, min(l_shipdate) AS first FROM lineitem")
def q_global_agg(t: Tables) -> DataFrame:
    p = t.program("lineitem")
    p.relation("out", "n", "total", "first")
    p.rule(
        Head("out", n="n", total="x", first="d"),
        Atom("lineitem", l_extendedprice="e", l_shipdate="s"), GroupBy((), {"n": "count(1)", "x": "round(sum(e), 2)", "d": "min(s)"}, distinct=False),
    )
    return p.result("out")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def q_pricing_summary(t: Tables) -> DataFrame:
    p = t.program("lineitem")
    p.relation("out", "flag", "status", "qty", "net", "discount", "n")
    from rulespark.rules import Where

    p.rule(
        Head("out", flag="f", status="s", qty="a", net="b", discount="c", n="n"),
        Atom("lineitem", l_returnflag="f", l_linestatus="s", l_quantity="q", l_extendedprice="e", l_discount="d", l_shipdate="x"), Where("x <= timestamp'1998-09-02'"),
        GroupBy(("f", "s"), {"a": "round(sum(q), 2)", "b": "round(sum(e * (1 - d)), 2)", "c": "round(avg(d), 6)", "n": "count(1)"}, distinct=False),
    )
    return p.result("out")


@query("SELECT o_orderstatus AS s, CAST(sum(o_custkey) // count(o_custkey) AS BIGINT) AS a FROM orders GROUP BY 1")
def q_sql_int_avg(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("s")).agg(s.agg_avg_signed_N(F.col("o_custkey")).cast("long").alias("a"))


@query("SELECT p_partkey AS k, p_brand AS brand, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand), 2) AS off FROM part")
def q_window_partition(t: Tables) -> DataFrame:
    mean = F.avg("p_retailprice").over(Window.partitionBy("p_brand"))
    return t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.round(F.col("p_retailprice") - mean, 2).alias("off"))


@query("SELECT b AS brand, s AS size, round(x / sum(x) OVER (PARTITION BY b), 6) AS share FROM (SELECT p_brand AS b, p_size AS s, sum(p_retailprice) AS x FROM part GROUP BY 1, 2)")
def q_window_over_agg(t: Tables) -> DataFrame:
    x = t.part.groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.sum("p_retailprice").alias("x"))
    return x.select("brand", "size", F.round(F.col("x") / F.sum("x").over(Window.partitionBy("brand")), 6).alias("share"))


@query("SELECT p_partkey AS k, count(*) OVER (PARTITION BY p_brand) AS by_brand, count(*) OVER (PARTITION BY p_size) AS by_size FROM part")
def q_two_windows(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.part.select(F.col("p_partkey").alias("k"), n.over(Window.partitionBy("p_brand")).alias("by_brand"), n.over(Window.partitionBy("p_size")).alias("by_size"))


@query("SELECT o_custkey AS c, o_orderkey AS k, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders")
def q_window_ordered_frame(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.rank().over(w).cast("long").alias("r"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_limit_ordered(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")).orderBy(F.desc("price"), "k").limit(10)


@query("SELECT c, k, i FROM (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 3")
def q_topk_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.row_number().over(w).cast("long").alias("i")).where("i <= 3")


@query("SELECT conv_id AS c, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def q_conversation_to_vec(t: Tables) -> DataFrame:
    turn = F.struct("turn", F.concat(F.col("role"), F.lit(":"), F.length("text").cast("string")).alias("x"))
    return t.conversations.groupBy(F.col("conv_id").alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda e: e["x"]), " ").alias("shape"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def q_label_join(t: Tables) -> DataFrame:
    p = t.program("documents", "labels")
    p.relation("out", "lang", "n", "toxic")
    p.rule(Head("out", lang="g", n="n", toxic="x"), Atom("labels", doc_id="d", toxic="y"), Atom("documents", doc_id="d", lang="g"), GroupBy(("g",), {"n": "count(1)", "x": "sum(y)"}, of=("g", "d", "y")))
    return p.result("out")


@query("SELECT w AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w HAVING count(*) >= 20")
def q_explode_docs_tokens(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")
