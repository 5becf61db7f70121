"""Shared helpers of the training-data operators: shared-folder tables, batch maps, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a batch function gets at a time.
SLICE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent and all runs in one JVM (a local master) is a temporary folder made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("tessera.shared.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("tessera.shared.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(names: Iterable[str], base: str) -> str:
    """A column name made of base that none of names equals, in any case of letters."""
    taken = {n.lower() for n in names}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    """Null text counts as empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to slices of at most SLICE rows of df's Arrow batches, so that few texts are Python objects at a time.

    Where the session has Spark's default of 10 000 rows a batch, it is set to SLICE too: rows here hold whole texts. At the
    end of a task the worker gives back the memory that Arrow keeps for its next batch.
    """
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(rows)) == 10_000:
        conf.set(rows, SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                out = function(batch.slice(start, SLICE))
                if out is not None:
                    yield out
        batch = out = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph given by its edges (a, b): one row (node, root) per node, root the smallest node.

    Contraction in rounds: every node hooks to its smallest smaller neighbour, the hooks (decreasing, so without cycles) are
    followed to their ends by pointer jumping, and the edges are rewritten between the ends; at least half of the nodes that
    still have an edge vanish with each round. All state is in written tables; no edge or label reaches the driver.
    """
    spark = edges.sparkSession
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = materialize(left, name)
    labels: DataFrame | None = None
    while not left.isEmpty():
        hooks = materialize(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), name)
        while True:
            up = hooks.select(F.col("node").alias("at"), F.col("root").alias("above"))
            jumped = hooks.join(up, F.col("root") == F.col("at"), "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            jumped = materialize(jumped, name)
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "root")
            if not moved:
                break
        end_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        end_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        moved_a = materialize(left.join(end_a, "a", "left").select(F.coalesce("root_a", "a").alias("a"), "b"), name)
        both = moved_a.join(end_b, "b").select(F.col("a"), F.col("root_b").alias("b"))
        left = materialize(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        if labels is None:
            labels = hooks
        else:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved_labels = labels.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            labels = materialize(moved_labels.unionByName(hooks), name).groupBy("node").agg(F.min("root").alias("root"))
            labels = materialize(labels, name)
    if labels is None:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], "node long, root long").select(F.col("node").cast(kind).alias("node"), F.col("root").cast(kind).alias("root"))
    roots = labels.select("root").distinct().select(F.col("root").alias("node"), F.col("root"))
    return materialize(labels.unionByName(roots.join(labels.select("node"), "node", "left_anti")), name)
