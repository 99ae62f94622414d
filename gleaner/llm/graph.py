"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, drop


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b).

    In each round every node points at the least neighbour in the order of a hash, or
    itself, and the links are drawn again between those. A star goes in one round, a
    path in a logarithmic number. All of it is joins and minima; each round is written
    to the shared folder. A null or a node linked with itself alone isn't returned.
    root is some node of the component, the same for all of its nodes.
    """
    links = cut(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    found = None
    for _ in range(rounds):
        if not links.take(1):
            break
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        both = links.select(F.col("a").alias("node"), key("b").alias("to")).union(
            links.select(F.col("b").alias("node"), key("a").alias("to"))
        )
        step = both.groupBy("node").agg(F.min("to").alias("to"))
        step = cut(step.select("node", F.least(F.col("to"), key("node"))["id"].alias("to")), "step")
        if found is None:
            found = cut(step.withColumnRenamed("to", "root"), "found")
        else:
            last, found = found, cut(
                found.join(step.withColumnRenamed("node", "root"), "root", "left").select(
                    "node", F.coalesce("to", "root").alias("root")
                ),
                "found",
            )
            drop(last)
        moved = (
            links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        last, links = links, cut(moved, "links")
        drop(last, step)
    else:
        raise RuntimeError("components did not settle")
    if found is None:
        node = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], edges.select("a", "b").schema).select(
            F.col("a").cast(node).alias("node"), F.col("b").cast(node).alias("root")
        )
    return found
