"""Connected components of an edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected edge list with the smallest node of its component.

    Each round hooks a node to the neighbour (itself included) that comes first in a hashed order, replaces both ends
    of every edge by what they hook to and drops loops and repeats. The hashed order makes the graph shrink by a
    constant factor a round in expectation, so long chains take a logarithmic number of rounds. Each round is a table
    in the shared folder.

    Rows with a null end, loops and repeated edges add nothing. An empty list gives an empty table.
    Returns node, component, one row for each node that has an edge.
    """
    kind = edges.schema[src].dataType
    left = edges.select(F.col(src).alias("a"), F.col(dst).cast(kind).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = materialize(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        hook = materialize(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
            .select("node", F.when(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v")) < F.col("m"), F.col("node")).otherwise(F.col("m.v")).alias("to")),
            "hooks",
        )
        hooks.append(hook)
        moved = (
            current.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        current = materialize(moved, "edges")
    if not hooks:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = hooks[0]
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        labels = labels.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    labels = materialize(labels, "labels")
    least = labels.groupBy("to").agg(F.min("node").alias("component"))
    return labels.join(least, "to").select("node", "component")
