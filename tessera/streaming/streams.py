"""Streams over the event log: keyed state, sessions, windows and an upsert sink, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import schemas
from tessera.operators import states
from tessera.sources import sinks
from tessera.sources.shared import shared_path


def events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The event log as a stream of Parquet files, times with a zone. The path may be one file: as a pattern it isn't taken for a folder.

    files_per_batch bounds a micro-batch, and with it what a keyed function holds of one key.
    """
    reader = spark.readStream.schema(schemas.EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, step: Callable[[DataFrame, int], None], folder: str) -> None:
    """Process all that is new, batch by batch, and stop. A later call with the same folder goes on where this one stopped or failed.

    A batch that failed is given again with the same number, so a step that writes by number writes once.
    """
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(step).trigger(availableNow=True).start()
    query.awaitTermination()


def to_table(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """The rows that a stream has given (append, update) or its last whole result (complete), over all calls with the folder.

    Every batch has a sub-folder of its number, which a repeated batch overwrites. Without a folder a new one is taken.
    """
    spark = stream.sparkSession
    folder = folder or shared_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/none")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'whole' if mode == 'complete' else number}")

    drain(stream, mode, step, folder)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def sessions(stream: DataFrame, gap: str, lateness: str = "30 days") -> DataFrame:
    """Sessions of each user by event time; events later than the lateness are dropped."""
    return stream.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("frames"), F.sum("value").alias("total"))


def windows(stream: DataFrame, width: str, lateness: str = "1 day") -> DataFrame:
    """Counts and sums by event type in tumbling windows."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def streaks(stream: DataFrame, threshold: float, needed: int) -> DataFrame:
    """Per user the run of consecutive values below a threshold, carried over batches; a breach or a missing value resets it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (streak,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for value in rows["value"]:
            streak = streak + 1 if value < threshold else 0
            out.append(streak)
        state.update((streak,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "streak": out, "converged": [s >= needed for s in out]})

    return stream.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, streak long, converged boolean", "streak long", "append", GroupStateTimeout.NoTimeout)


def transitions(stream: DataFrame) -> DataFrame:
    """The state machine over requested states (key, seq, target, reason): one row per request with the verdict and the event.

    An illegal request leaves the state as it is. State: current state and number of rollbacks.
    """
    legal = set(states.ALLOWED)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, rollbacks = state.get if state.exists else (states.INITIAL, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, target, reason in rows[["seq", "target", "reason"]].itertuples(index=False):
            back = current == "FINAL_QC" and target in ("COLOR_CORRECTING", "EXPOSURE_ALIGNING")
            verdict = "illegal" if (current, target) not in legal else "reason" if target == "MANUAL_REVIEW" and not (reason or "").strip() else "rollback_limit" if back and rollbacks >= states.MAX_ROLLBACKS else "ok"
            out.append((key[0], seq, current, target, verdict))
            if verdict == "ok":
                current, rollbacks = target, rollbacks + back
        state.update((current, rollbacks))
        yield pd.DataFrame(out, columns=["key", "seq", "before", "target", "verdict"])

    return stream.groupBy("key").applyInPandasWithState(step, "key long, seq long, before string, target string, verdict string", "state string, rollbacks long", "append", GroupStateTimeout.NoTimeout)


def upsert_table(stream: DataFrame, keys: list[str], order: str, folder: str | None = None, buckets: int = 64) -> DataFrame:
    """The last row per key of a stream, kept as a table that every batch is merged into, over all calls with the folder.

    Keys are dealt into buckets, and a batch writes only the buckets that it changes, under its number; a small log says which
    batch wrote a bucket last. A repeated batch starts from the versions before it and overwrites its own.
    """
    spark = stream.sparkSession
    folder = folder or shared_path(spark, "upsert")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    log = "bucket int, version long"
    spark.createDataFrame([], log).write.mode("overwrite").parquet(f"{folder}/log/none")

    def versions(until: int | None = None) -> dict[int, int]:
        """Bucket -> the batch that wrote it last: at most one entry per bucket."""
        entries = spark.read.schema(log).option("recursiveFileLookup", "true").parquet(f"{folder}/log")
        kept = entries if until is None else entries.where(F.col("version") < until)
        return {r.bucket: r.version for r in kept.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def rows(found: dict[int, int]) -> DataFrame:
        paths = [f"{folder}/rows/{version}/__bucket={at}" for at, version in sorted(found.items())]
        return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)

    def step(batch: DataFrame, number: int) -> None:
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        current = rows({at: version for at, version in versions(number).items() if at in touched})
        merged = sinks.upsert(current, batch, keys, order).withColumn("__bucket", bucket)
        merged.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{folder}/rows/{number}")
        spark.createDataFrame([(at, number) for at in touched], log).coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/{number}")

    drain(stream, "append", step, folder)
    return rows(versions())
