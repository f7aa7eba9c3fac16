"""Transformers of graphs: components, reverse edges, closures of labels.

Labels spread in rounds; each round is a join on the edges and a minimum per
node, written to the shared folder. Labels also jump along the label of their
label, so that long paths need few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.storage import stored


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The least label that reaches each node along edges (src, dst)."""
    labels = stored(labels, "labels")
    while True:
        pushed = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        step = labels.unionByName(pushed).groupBy("node").agg(F.min("label").alias("label"))
        # the label of a node is itself a node that reaches it, so its label does too
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        fresh = stored(jump.select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = fresh.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        done = changed.isEmpty()
        labels = fresh
        if done:
            return labels


def _edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def connected_components(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label): the least node from which each one is reached along the
    edges' direction."""
    edges = stored(_edges(df, src, dst), "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return _spread(nodes.select("node", F.col("node").alias("label")), edges)


def strongly_connected_components(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, scc) of every node on a cycle or in an edge: scc is the least node
    of its component.

    Colours spread forward; within a colour, the nodes that reach its root
    backward are one component and leave. Roots all advance at once.
    """
    edges = stored(_edges(df, src, dst), "edges")
    found: DataFrame | None = None
    nodes = stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    left = edges
    while not nodes.isEmpty():
        colours = _spread(nodes.select("node", F.col("node").alias("label")), left)
        of = lambda c, name: colours.select(F.col("node").alias(c), F.col("label").alias(name))
        inner = stored(left.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").select("src", "dst"), "edges")
        # backward from each root, inside its colour
        reached = stored(colours.where("node = label").select("node", "label"), "reached")
        front = reached
        while True:
            back = front.select(F.col("node").alias("dst"), "label").join(inner, "dst").select(F.col("src").alias("node"), "label").distinct()
            front = stored(back.join(reached, ["node", "label"], "left_anti"), "reached")
            if front.isEmpty():
                break
            reached = stored(reached.unionByName(front), "reached")
        done = reached.select("node", F.col("label").alias("scc"))
        found = done if found is None else found.unionByName(done)
        nodes = stored(nodes.join(reached.select("node"), "node", "left_anti"), "nodes")
        gone = reached.select("node")
        left = stored(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    return found if found is not None else nodes.select("node", F.col("node").alias("scc"))


def bidirectional_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose reverse is an edge too."""
    edges = _edges(df, src, dst)
    return edges.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")
