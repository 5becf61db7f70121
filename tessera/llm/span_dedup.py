"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; the shortest runs of several consecutive sentences with enough words, from each sentence on and
up to each sentence, are hashed; runs that occur more than once in the corpus are found by one aggregation and one join; the
sentences covered by any run but the corpus's first occurrence of it are removed. Any longer repeat is a chain of such runs, so
every sentence of a repeated passage of MIN_SENTENCES and MIN_WORDS or more goes.

Sentences are cut fine: they end at line ends, at words ending in a mark of punctuation, commas too, and at long words. These
rules look at one word only, so a passage is cut alike wherever it stands, even where it begins or ends inside another sentence
(of passages of 51 words in random places, full stops alone would find three quarters).

Texts of any length are read whole, in one pass; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialize, text_or_empty, unused

#: A run has at least this many sentences and this many words.
MIN_SENTENCES = 2
MIN_WORDS = 16
#: Words of at least this many bytes end a sentence.
LONG_WORD = 10
MARKS = frozenset(b".!?;:,")
#: Stands for a null doc_id in keys: such rows come last.
NO_ID = (1 << 63) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = [_powers(1024)]


def sentences(text: str) -> tuple[list[bytes], list[int]]:
    """The words of a text and, for each sentence, the number of words up to its end."""
    words: list[bytes] = []
    ends: list[int] = []
    for line in text.encode().split(b"\n"):
        own = line.split()
        if own:
            base = len(words) + 1
            words += own
            ends += [k for k, w in enumerate(own, base) if w[-1] in MARKS or len(w) >= LONG_WORD]
            if not ends or ends[-1] != len(words):
                ends.append(len(words))
    return words, ends


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, sentences) of each run of a text."""
    words, ends = sentences(text)
    n = len(ends)
    if n < MIN_SENTENCES or len(words) < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(b" ".join(words[s:e])) for s, e in zip(starts, ends, strict=True)], dtype=np.uint64)
    if n > len(_POWERS[0][0]):
        _POWERS[0] = _powers(2 * n)
    up, down = _POWERS[0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * up[:n], dtype=np.uint64)])
    begin, stop = np.array(starts), np.array(ends)
    last = np.maximum(np.searchsorted(stop, begin + MIN_WORDS) + 1, np.arange(n) + MIN_SENTENCES)
    first = np.minimum(np.searchsorted(begin, stop - MIN_WORDS, side="right") - 1, np.arange(1, n + 1) - MIN_SENTENCES)
    onward, back = np.flatnonzero(last <= n), np.flatnonzero(first >= 0)
    both = np.unique(np.concatenate([onward * (n + 1) + last[onward], first[back] * (n + 1) + back + 1]))
    first, last = both // (n + 1), both % (n + 1)
    found = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    return found.view(np.int64), first, last - first


def remove(text: str, covered: np.ndarray) -> tuple[str, int]:
    """A text without the sentences marked in covered (by number), and the number of words removed."""
    raw = text.encode()
    words, ends = sentences(text)
    places = [m.span() for m in WORD.finditer(raw)]
    keep, at, gone = [], 0, 0
    starts = [0, *ends[:-1]]
    k = 0
    while k < len(ends):
        if covered[k]:
            begin = k
            while k < len(ends) and covered[k]:
                k += 1
            keep.append(raw[at : places[starts[begin]][0]])
            at = places[starts[k]][0] if k < len(ends) else len(raw)
            gone += ends[k - 1] - starts[begin]
        else:
            k += 1
    keep.append(raw[at:])
    return b"".join(keep).decode(), gone


def occurrences(documents: DataFrame) -> DataFrame:
    """(key, mark, at, sentences, hash) of every run: key is doc_id, mark the text's hash, at the first sentence's number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for key, mark, text in zip(keys, marks, batch.column(2).to_pylist(), strict=True):
            found, first, count = runs(text)
            if len(found):
                out[0].append(np.full(len(found), key))
                out[1].append(np.full(len(found), mark))
                out[2].append(first.astype(np.int32))
                out[3].append(count.astype(np.int32))
                out[4].append(found)
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "mark", "at", "sentences", "hash"])

    return map_batches(documents.select(_key(), _mark(), text_or_empty().alias("text")), run, "key long, mark long, at int, sentences int, hash long")


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")


def _mark():
    """64 bits of a text's hash, which keep apart texts that share a doc_id or have none."""
    return F.xxhash64(text_or_empty()).alias("mark")


def covered_runs(documents: DataFrame) -> DataFrame:
    """(key, mark, runs array<struct<at, sentences>>): per document the repeated runs that aren't the corpus's first.

    First is by doc_id (null last), then text hash and position. A list holds the runs of one text, each once.
    """
    found = materialize(occurrences(documents), "span-runs")
    repeated = materialize(found.groupBy("hash").count().where("count > 1").select("hash"), "span-hashes")
    shared = materialize(found.join(repeated, "hash"), "span-shared")
    firsts = shared.groupBy("hash").agg(F.min(F.struct("key", "mark", "at")).alias("first"))
    firsts = materialize(firsts.select("hash", F.col("first.key").alias("first_key"), F.col("first.mark").alias("first_mark"), F.col("first.at").alias("first_at")), "span-firsts")
    later = shared.join(firsts, "hash").where("key <> first_key or mark <> first_mark or at <> first_at")
    return later.groupBy("key", "mark").agg(F.collect_set(F.struct("at", "sentences")).alias("runs"))


def deduplicate(documents: DataFrame, count_column: str = "removed_words") -> DataFrame:
    """documents with their repeated sentences removed: the same columns and rows, text shortened, plus count_column, the words removed.

    Null text stays null; texts of fewer than MIN_WORDS words never change; rows that repeat a doc_id and text count as one
    document and stay alike; a text that is covered whole becomes empty. An existing column of the name count_column is
    replaced; all others stay, whatever their names.
    """
    names = [c for c in documents.columns if c != count_column]
    plain = documents.select(*[F.col(f"`{c}`") for c in names])
    key, mark, found_runs = (unused(names, n) for n in ("key", "mark", "runs"))
    runs_of_text = covered_runs(documents).toDF(key, mark, found_runs)
    joined = plain.withColumn(key, _key()).withColumn(mark, _mark()).join(runs_of_text, [key, mark], "left").drop(key, mark)
    schema = plain.withColumn(count_column, F.lit(0).cast("long")).schema
    position = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(position).to_pylist()
        removed = np.zeros(len(texts), np.int64)
        for row, found in enumerate(batch.column(len(names)).to_pylist()):
            if found and texts[row]:
                ends = sentences(texts[row])[1]
                covered = np.zeros(len(ends), bool)
                for r in found:
                    covered[r["at"] : r["at"] + r["sentences"]] = True
                texts[row], removed[row] = remove(texts[row], covered)
        columns = [batch.column(k) for k in range(len(names))]
        columns[position] = pa.array(texts, columns[position].type)
        return pa.RecordBatch.from_arrays([*columns, pa.array(removed)], [*names, count_column])

    return map_batches(joined, run, schema)
