"""URL filter rules by a sort-merge range join.

A host is turned round label by label (`www.example.net` -> `net.example.www.`), so that a rule's host and all its subdomains
are one interval of keys. Rules and urls are dealt to the same stretches of keys, a rule to every stretch that its interval
meets, and sorted; one sweep per stretch keeps a stack of the rules whose intervals hold the current key, nested one in the
other, and asks them for the longest path that the url's path starts with.

Stretches are cut at sampled keys (which only balances the work); where one host fills a stretch, its urls are dealt to
several salted copies of the stretch by row, each with the stretch's rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Rows that a stretch should have, sampled keys per stretch, and the most stretches.
STRETCH_ROWS = 500
SAMPLED = 20
MAX_STRETCHES = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. Both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels of a host in reverse, each with a dot after it; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class _Sweep:
    """The stack of active rules while keys come in order."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, dict[str, str]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, path: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, max(0, len(key) - 1), {}))
        known = self.stack[-1][2]
        if known.get(path) != "block":
            known[path] = verdict

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, host and path together; of equal lengths the longer host's."""
        self.move(key)
        best, found = -1, (None, None)
        for own, size, paths in self.stack:
            lengths = {len(p) for p in paths} if len(paths) > 4 else None
            fits = [path[:n] for n in lengths if path[:n] in paths] if lengths is not None else [p for p in paths if path.startswith(p)]
            if fits:
                longest = max(fits, key=len)
                if size + len(longest) >= best:
                    best = size + len(longest)
                    found = ".".join(reversed(own[:-1].split("."))) + longest, paths[longest]
        return found


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url), by rules (rule string like `net/`, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest wins, and of equal
    rules block wins. Where none fits rule is null and the verdict is the default. Null urls and urls without `://` have an
    empty host and path. Rules without text or verdict are left out; repeated rows give repeated rows.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    slash = F.instr("rule", "/")
    rule_host = F.when(slash > 0, F.substring(F.col("rule"), F.lit(1), slash - 1)).otherwise(F.col("rule"))
    rule_path = F.when(slash > 0, F.substring(F.col("rule"), slash, F.length("rule"))).otherwise("")
    given = rules.where("rule is not null and verdict is not null").select(F.translate(rule_host, UPPER, LOWER).alias("host"), rule_path.alias("path"), "verdict")
    given = given.withColumn("key", host_key(F.col("host")))

    rows = urls.count()
    wanted = max(1, min(MAX_STRETCHES, rows // STRETCH_ROWS))
    every = max(1, rows // (wanted * SAMPLED))
    sampled = urls.where(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(every)) == 0).select("key")
    sample = sorted((r["key"].encode() for r in sampled.limit(4 * MAX_STRETCHES * SAMPLED).collect())) if wanted > 1 else []
    cuts = sorted({sample[k * len(sample) // wanted] for k in range(1, wanted)}) if sample else []
    filled = np.bincount([_place(cuts, k) for k in sample], minlength=len(cuts) + 1) if sample else np.zeros(1, int)
    salts = np.maximum(1, filled // SAMPLED).tolist()
    first = np.concatenate([np.zeros(1, int), np.cumsum(salts)]).tolist()

    @F.pandas_udf(LongType())
    def target(keys: pd.Series, salt: pd.Series) -> pd.Series:
        places = [_place(cuts, k.encode()) for k in keys]
        return pd.Series([first[p] + s % salts[p] for p, s in zip(places, salt.tolist(), strict=True)], dtype="int64")

    @F.pandas_udf(ArrayType(LongType()))
    def targets(keys: pd.Series) -> pd.Series:
        spans = [(_place(cuts, k.encode()), _place(cuts, k[:-1].encode() + b"/") if k else len(cuts)) for k in keys]
        return pd.Series([list(range(first[a], first[b + 1])) for a, b in spans])

    url_rows = urls.select(target("key", F.xxhash64("page_id", "path")).alias("target"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    rule_rows = given.select(F.explode(targets("key")).alias("target"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    ordered = url_rows.unionByName(rule_rows).repartition("target").sortWithinPartitions("target", "key", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sweep = None, _Sweep()
        for batch in batches:
            out: list[tuple] = []
            for at, key, kind, page_id, host_, path_, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != place:
                    place, sweep = at, _Sweep()
                if kind == 0:
                    sweep.add(key, path_, verdict)
                else:
                    rule, found = sweep.judge(key, path_)
                    out.append((page_id, host_, path_, rule, found or default))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], ["page_id", "host", "path", "rule", "verdict"])

    return ordered.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _place(cuts: list[bytes], key: bytes) -> int:
    """The stretch of a key: the number of cuts at or below it."""
    low, high = 0, len(cuts)
    while low < high:
        middle = (low + high) // 2
        if cuts[middle] <= key:
            low = middle + 1
        else:
            high = middle
    return low
