"""Recursive rules and graph transformers, on graphs derived from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark import graph
from rulespark.queries import Tables, query
from rulespark.rules import Atom, Expr, GroupBy, Head, Not, Program, Where

EDGE = "edge AS (SELECT DISTINCT p_partkey % 100 AS a, (p_partkey * p_size + p_size) % 100 AS b FROM part WHERE p_partkey < 150 AND p_partkey % 100 <> (p_partkey * p_size + p_size) % 100)"
DAG = EDGE + ", dag AS (SELECT a, b FROM edge WHERE a < b)"
SMALL = "edge AS (SELECT DISTINCT p_partkey % 40 AS a, (p_partkey * p_size + p_size) % 40 AS b FROM part WHERE p_partkey < 200 AND p_partkey % 40 <> (p_partkey * p_size + p_size) % 40)"


def edges(t: Tables, modulus: int = 100, below: int = 150) -> DataFrame:
    """Distinct (a, b)."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    made = t.part.where(k < below).select((k % modulus).alias("a"), ((k * s + s) % modulus).alias("b"))
    return made.where("a <> b").distinct()


def with_edges(t: Tables, *, forward: bool = False, **options) -> Program:
    made = edges(t, **options)
    return t.program(edge=made.where("a < b") if forward else made)


@query(f"WITH RECURSIVE {DAG}, path AS (SELECT a, b FROM dag UNION SELECT path.a, dag.b FROM path JOIN dag ON path.b = dag.a) SELECT a, b FROM path")
def q_reachability(t: Tables) -> DataFrame:
    p = with_edges(t, forward=True)
    p.relation("path", "a", "b")
    p.rule(Head("path", a="x", b="y"), Atom("edge", a="x", b="y"))
    p.rule(Head("path", a="x", b="z"), Atom("path", a="x", b="y"), Atom("edge", a="y", b="z"))
    return p.result("path")


@query(f"WITH RECURSIVE {EDGE}, path AS (SELECT a, b FROM edge UNION SELECT path.a, edge.b FROM path JOIN edge ON path.b = edge.a) SELECT a, b FROM path")
def q_transitive_closure(t: Tables) -> DataFrame:
    """Not linear: a round doubles the length of the paths."""
    p = with_edges(t)
    p.relation("path", "a", "b")
    p.rule(Head("path", a="x", b="y"), Atom("edge", a="x", b="y"))
    p.rule(Head("path", a="x", b="z"), Atom("path", a="x", b="y"), Atom("path", a="y", b="z"))
    return p.result("path")


@query(f"WITH RECURSIVE {DAG}, walk AS (SELECT a, b, 1 AS odd FROM dag UNION SELECT walk.a, dag.b, 1 - odd FROM walk JOIN dag ON walk.b = dag.a) SELECT a, b, CAST(odd AS INTEGER) AS odd FROM walk")
def q_mutual_recursion_even_odd(t: Tables) -> DataFrame:
    p = with_edges(t, forward=True)
    p.relation("odd", "a", "b")
    p.relation("even", "a", "b")
    p.relation("walk", "a", "b", "odd")
    p.rule(Head("odd", a="x", b="y"), Atom("edge", a="x", b="y"))
    p.rule(Head("even", a="x", b="z"), Atom("odd", a="x", b="y"), Atom("edge", a="y", b="z"))
    p.rule(Head("odd", a="x", b="z"), Atom("even", a="x", b="y"), Atom("edge", a="y", b="z"))
    p.rule(Head("walk", a="x", b="y", odd=1), Atom("odd", a="x", b="y"))
    p.rule(Head("walk", a="x", b="y", odd=0), Atom("even", a="x", b="y"))
    return p.result("walk")


@query(f"WITH RECURSIVE {DAG}, sg AS (SELECT DISTINCT x.b AS a, y.b AS b FROM dag x JOIN dag y ON x.a = y.a WHERE x.b <> y.b UNION SELECT x.b, y.b FROM sg JOIN dag x ON x.a = sg.a JOIN dag y ON y.a = sg.b) SELECT a, b FROM sg")
def q_same_generation(t: Tables) -> DataFrame:
    p = with_edges(t, forward=True)
    p.relation("sg", "a", "b")
    p.rule(Head("sg", a="x", b="y"), Atom("edge", a="u", b="x"), Atom("edge", a="u", b="y"), Where("x <> y"))
    p.rule(Head("sg", a="x", b="y"), Atom("sg", a="u", b="v"), Atom("edge", a="u", b="x"), Atom("edge", a="v", b="y"))
    return p.result("sg")


@query(f"WITH RECURSIVE {DAG}, hop AS (SELECT a, b, 1 AS n FROM dag UNION SELECT hop.a, dag.b, n + 1 FROM hop JOIN dag ON hop.b = dag.a) SELECT a, b, CAST(min(n) AS INTEGER) AS hops FROM hop GROUP BY a, b")
def q_shortest_hops(t: Tables) -> DataFrame:
    p = with_edges(t, forward=True)
    p.relation("hop", "a", "b", "n")
    p.relation("least", "a", "b", "hops")
    p.rule(Head("hop", a="x", b="y", n=1), Atom("edge", a="x", b="y"))
    p.rule(Head("hop", a="x", b="z", n=Expr("n + 1")), Atom("hop", a="x", b="y", n="n"), Atom("edge", a="y", b="z"))
    p.rule(Head("least", a="x", b="y", hops="m"), Atom("hop", a="x", b="y", n="n"), GroupBy(("x", "y"), {"m": "min(n)"}))
    return p.result("least")


@query(f"WITH RECURSIVE {DAG}, path AS (SELECT a, b FROM dag UNION SELECT path.a, dag.b FROM path JOIN dag ON path.b = dag.a), node AS (SELECT a AS n FROM dag UNION SELECT b FROM dag) SELECT x.n AS a, y.n AS b FROM node x, node y WHERE x.n < y.n AND NOT EXISTS (SELECT 1 FROM path WHERE path.a = x.n AND path.b = y.n)")
def q_unreachable(t: Tables) -> DataFrame:
    p = with_edges(t, forward=True)
    for name in ("path", "gap"):
        p.relation(name, "a", "b")
    p.relation("node", "n")
    p.rule(Head("node", n="x"), Atom("edge", a="x"))
    p.rule(Head("node", n="x"), Atom("edge", b="x"))
    p.rule(Head("path", a="x", b="y"), Atom("edge", a="x", b="y"))
    p.rule(Head("path", a="x", b="z"), Atom("path", a="x", b="y"), Atom("edge", a="y", b="z"))
    p.rule(Head("gap", a="x", b="y"), Atom("node", n="x"), Atom("node", n="y"), Where("x < y"), Not("path", a="x", b="y"))
    return p.result("gap")


@query(f"WITH RECURSIVE {EDGE}, node AS (SELECT a AS n FROM edge UNION SELECT b FROM edge), path AS (SELECT n AS a, n AS b FROM node UNION SELECT path.a, edge.b FROM path JOIN edge ON path.b = edge.a) SELECT b AS node, min(a) AS label FROM path GROUP BY b")
def q_connected_components(t: Tables) -> DataFrame:
    p = with_edges(t)
    p.relation("component", "node", "label")
    p.apply(lambda e: graph.connected_components(e, "a", "b"), ["edge"], ["component"])
    return p.result("component")


@query(f"WITH RECURSIVE {EDGE}, node AS (SELECT a AS n FROM edge UNION SELECT b FROM edge), path AS (SELECT n AS a, n AS b FROM node UNION SELECT path.a, edge.b FROM path JOIN edge ON path.b = edge.a) SELECT x.b AS node, min(x.a) AS scc FROM path x JOIN path y ON x.a = y.b AND x.b = y.a GROUP BY x.b")
def q_scc(t: Tables) -> DataFrame:
    p = with_edges(t)
    p.relation("component", "node", "scc")
    p.apply(lambda e: graph.strongly_connected_components(e, "a", "b"), ["edge"], ["component"])
    return p.result("component")


@query(f"WITH {EDGE} SELECT x.a AS src, x.b AS dst FROM edge x JOIN edge y ON x.a = y.b AND x.b = y.a")
def q_bidirectional_edges(t: Tables) -> DataFrame:
    return graph.bidirectional_edges(edges(t), "a", "b")


@query(f"WITH {SMALL} SELECT DISTINCT x.a AS a, x.b AS b, y.b AS c FROM edge x JOIN edge y ON x.b = y.a JOIN edge z ON z.a = x.a AND z.b = y.b")
def q_triangles(t: Tables) -> DataFrame:
    p = with_edges(t, modulus=40, below=200)
    p.relation("triangle", "a", "b", "c")
    p.rule(Head("triangle", a="x", b="y", c="z"), Atom("edge", a="x", b="y"), Atom("edge", a="y", b="z"), Atom("edge", a="x", b="z"))
    return p.result("triangle")


@query("WITH edge AS (SELECT DISTINCT p_partkey % 20 AS a, (p_partkey * p_size + p_size) % 20 AS b FROM part WHERE p_partkey < 200 AND p_partkey % 20 <> (p_partkey * p_size + p_size) % 20) SELECT DISTINCT e1.a AS a, e1.b AS b, e2.b AS c, e3.b AS d FROM edge e1 JOIN edge e2 ON e2.a = e1.b JOIN edge e3 ON e3.a = e2.b JOIN edge e4 ON e4.a = e1.a AND e4.b = e3.b JOIN edge e5 ON e5.a = e1.a AND e5.b = e2.b JOIN edge e6 ON e6.a = e1.b AND e6.b = e3.b")
def q_quadclique(t: Tables) -> DataFrame:
    p = with_edges(t, modulus=20, below=200)
    p.relation("clique", "a", "b", "c", "d")
    e = lambda x, y: Atom("edge", a=x, b=y)
    p.rule(Head("clique", a="x", b="y", c="z", d="w"), e("x", "y"), e("y", "z"), e("x", "z"), e("z", "w"), e("x", "w"), e("y", "w"))
    return p.result("clique")
