"""Connected components of an edge table, without collecting edges or a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either the end of one edge or a label: then each label and its nodes are a component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: links every larger neighbour of a node to its least one; small star: every smaller neighbour and the node.

    The least neighbours are written first, so the join has an exchange on both sides and the
    runtime can split a node of many edges.
    """
    ways = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = materialise(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = ways.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("m").alias("b"), F.col("b").alias("a"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a")), F.struct(F.col("b").alias("a")))).alias("x"), F.col("m").alias("b")).select("x.a", "b")
    out = out.where("a != b")
    # A large star gives no more rows than it has read.
    return materialise(out if large else out.distinct(), "star")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (least node of its component), for the nodes of edges(a, b).

    Alternates large and small stars until only stars are left; each round is written to the
    shared folder.  Null ends and loops are left out; no edges give no rows.
    """
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rounds = 0
    while not _settled(edges):
        if rounds == most_rounds:
            raise RuntimeError("components did not settle")
        edges, rounds = _star(_star(edges, True), False), rounds + 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
