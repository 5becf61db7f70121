"""Merging of graph fragments: disjoint nodes, all edges, and nodes made up for ends that no fragment has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(fragments: list[tuple[DataFrame, DataFrame]], kind: str = "external") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of fragments of (nodes (id, type, ...), edges (from, to, ...)): the fragments must not share a node.

    An id that stands in more than one fragment, or twice in one, fails the job and is named. Ends of edges without a node get one
    with this type and nulls otherwise; equal edges stand once. Columns that a fragment lacks are null. Null ids and edges with a
    null end go. Conflicts are found by one aggregation of ids, no id reaches the driver.
    """
    numbered = [nodes.where(F.col("id").isNotNull()).withColumn("__part", F.lit(i)) for i, (nodes, _) in enumerate(fragments)]
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [e for _, e in fragments]).where(F.col("from").isNotNull() & F.col("to").isNotNull()).distinct()
    names = [c for c in nodes.columns if c != "__part"]
    counted = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in names if c != "id"])
    message = F.concat(F.lit("node in more than one fragment: "), F.col("id").cast("string"))
    checked = counted.select(F.when(F.col("__n") > 1, F.raise_error(message).cast(nodes.schema["id"].dataType)).otherwise(F.col("id")).alias("id"), *[c for c in names if c != "id"])
    ends = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti").withColumn("type", F.lit(kind))
    return checked.select(*names).unionByName(missing, allowMissingColumns=True), edges
