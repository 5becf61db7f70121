"""Ranked lexical search over a document FP-tree.

The documents' term vectors, restricted to the terms of the items and ordered by falling document frequency, are read in blocks.
A block's vectors form a tree in which equal beginnings share a path. Every subtree has the maxima of its documents' term
frequencies and the minimum of their m; scored like a document, these bound the scores of all documents below. The search goes
depth first and leaves a branch out when no item can gain from it: when the bound is below the score that the item's 50th
document already has. All items go down the tree together, each with its own bound, as one array operation per node.

Scores are 64-bit integers and bounds are computed by the same function, so nothing is lost to rounding. First a sixty-fourth of
the vectors is searched; its k-th scores are a floor that lets every task pass on only documents which can still count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialize

#: Documents of a tree.
BLOCK = 4096
#: One in so many vectors is searched first, for the floors.
FLOOR_SHARE = 64
#: Characters of items that one pass over the documents serves; more items take more passes.
PASS_CHARS = 4_000_000

# Bytes that aren't part of a term become blanks, A-Z become a-z; bytes above 0x7F belong to terms.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return text.translate(WORD_BYTES).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Items:
    """The items' terms: which items hold a term, and its weight. Term numbers follow falling document frequency."""

    def __init__(self, holders: list[np.ndarray], weights: np.ndarray, count: int) -> None:
        sizes = np.array([len(h) for h in holders], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.items = np.concatenate(holders) if holders else np.empty(0, np.int64)
        self.weights, self.count = weights, count

    def scores(self, of: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of several vectors for all items: entry i says that vector of[i], whose m is m[of[i]], has terms[i] tf[i] times."""
        worth = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
        sizes = self.ends[terms] - self.starts[terms]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[terms] - first, sizes)
        out = np.zeros(len(m) * self.count, np.int64)
        np.add.at(out, np.repeat(of * self.count, sizes) + self.items[at], np.repeat(worth, sizes))
        return out.reshape(len(m), self.count)


class Best:
    """The k best documents per item so far, and the score below which a document can't count."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.k, self.bars = k, floors.copy()
        self.found: list[list[tuple[int, tuple]]] = [[] for _ in floors]

    def offer(self, item: int, score: int, ids: list[tuple]) -> None:
        """Documents of one score, as (whether the id is null, id) in ascending order."""
        held = self.found[item]
        held.extend((-score, doc) for doc in ids[: self.k])
        if len(held) >= 4 * self.k:
            self.shrink(item)

    def shrink(self, item: int) -> None:
        held = self.found[item] = sorted(self.found[item])[: self.k]
        if len(held) == self.k:
            self.bars[item] = max(self.bars[item], -held[-1][0])


class Tree:
    """The FP-tree of a block: vectors in order of their term numbers, nodes found as the search goes down."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray, int, list]]) -> None:
        vectors.sort(key=lambda v: v[0].astype(">u4").tobytes())
        self.ids = [v[3] for v in vectors]
        self.m = np.array([v[2] for v in vectors], np.int64)
        sizes = np.array([len(v[0]) for v in vectors], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.terms = np.concatenate([v[0] for v in vectors]).astype(np.int64)
        self.tf = np.concatenate([v[1] for v in vectors]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(vectors)), sizes)

    def branches(self, low: int, high: int, depth: int) -> tuple[list[tuple[int, int]], int]:
        """The children of the node of vectors low..high, which share their first `depth` terms, and the depth where they part."""
        first = self.terms[self.starts[low] + depth : self.ends[low]]
        last = self.terms[self.starts[high - 1] + depth : self.ends[high - 1]]
        short = min(len(first), len(last))
        apart = np.flatnonzero(first[:short] != last[:short])
        depth += int(apart[0]) if len(apart) else short
        at = self.starts[low:high] + depth
        done = at >= self.ends[low:high]
        next_terms = np.where(done, -1, self.terms[np.minimum(at, len(self.terms) - 1)])
        edges = [low, *(np.flatnonzero(next_terms[1:] != next_terms[:-1]) + 1 + low).tolist(), high]
        children = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            children += [(i, i + 1) for i in range(a, b)] if next_terms[a - low] < 0 else [(a, b)]
        return children, depth

    def search(self, items: Items, best: Best) -> None:
        stack = [(0, len(self.m), 0)] if len(self.m) else []
        while stack:
            low, high, depth = stack.pop()
            children, depth = self.branches(low, high, depth) if high - low > 1 else ([(low, high)], depth)
            for start in range(0, len(children), 64):
                part = children[start : start + 64]
                bounds = items.scores(*self._maxima(part))
                open_ = (bounds > 0) & (bounds >= best.bars)
                deeper = []
                for k, (a, b) in enumerate(part):
                    wanted = np.flatnonzero(open_[k])
                    if len(wanted) and b - a == 1:
                        for item in wanted.tolist():
                            best.offer(item, int(bounds[k, item]), self.ids[a])
                    elif len(wanted):
                        deeper.append((int(bounds[k].max()), a, b))
                stack += [(a, b, depth) for _, a, b in sorted(deeper)]

    def _maxima(self, nodes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, term, largest tf) of each node's terms, and each node's smallest m; of a single vector these are its own."""
        low, high = nodes[0][0], nodes[-1][1]
        begin, end = self.starts[low], self.ends[high - 1]
        terms, tf = self.terms[begin:end], self.tf[begin:end]
        cuts = np.array([a for a, _ in nodes])
        m = np.minimum.reduceat(self.m[low:high], cuts - low)
        node = np.repeat(np.arange(len(nodes)), [b - a for a, b in nodes])[self.owner[begin:end] - low]
        if len(nodes) == high - low:
            return node, terms, tf, m
        order = np.lexsort((terms, node))
        node, terms, tf = node[order], terms[order], tf[order]
        new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (terms[1:] != terms[:-1])]))
        return node[new], terms[new], np.maximum.reduceat(tf, new), m


def _vectors(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): of every document its number of terms, and its item terms with their frequencies."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, sizes, terms, tfs = [], [], [], []
        for text in batch.column(1).cast(pa.binary()):
            words = terms_of(text.as_py() or b"")
            counts: dict[int, int] = {}
            for word in words:
                number = numbers.get(word)
                if number is not None:
                    counts[number] = counts.get(number, 0) + 1
            lengths.append(len(words))
            sizes.append(len(counts))
            terms += counts.keys()
            tfs += counts.values()
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, pa.array(values, pa.int32())) for values in (terms, tfs)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def _searched(vectors: DataFrame, ranks: np.ndarray, items: Items, documents: int, total: int, floors: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): of every task the documents that may be among an item's k best."""
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = Best(floors, k), None

        def gather(batch: pa.RecordBatch, alike: dict) -> None:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = batch.column(2).offsets.to_numpy()
            terms, tfs = (batch.column(c).values.to_numpy() for c in (2, 3))
            for i, doc in enumerate(ids):
                numbers = ranks[terms[starts[i] : starts[i + 1]]]
                order = np.argsort(numbers)
                numbers, tf = numbers[order], tfs[starts[i] : starts[i + 1]][order]
                m = 100 - 50 + (50 * n[i] * documents) // total
                key = (numbers.tobytes(), tf.tobytes(), m)
                held = alike.setdefault(key, (numbers, tf, m, []))[3]
                held.append((doc is None, doc))
                if len(held) > 8 * k:
                    held[:] = sorted(held)[:k]

        def search(alike: dict) -> None:
            for vector in alike.values():
                vector[3].sort()
            Tree(list(alike.values())).search(items, best)

        alike: dict = {}
        for batch in batches:
            id_type = batch.schema.field(0).type
            for start in range(0, batch.num_rows, BLOCK):
                gather(batch.slice(start, BLOCK), alike)
                if len(alike) >= BLOCK:
                    search(alike)
                    alike = {}
        if alike:
            search(alike)
        for item in range(items.count):
            best.shrink(item)
        rows = [(item, doc, -score) for item, held in enumerate(best.found) for score, (_, doc) in held if -score >= floors[item]]
        if rows:
            numbers, docs, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(docs, id_type), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"item int, doc_id {kind}, score long")


def _pass(documents: DataFrame, items: list[tuple], k: int, schema: str) -> DataFrame:
    """rank() for a bounded number of items: (item_id, its texts)."""
    spark = documents.sparkSession
    held = [sorted({t for text in texts for t in terms_of((text or "").encode())}) for _, texts in items]
    words = sorted({t for terms in held for t in terms})
    numbers = {word: i for i, word in enumerate(words)}
    vectors = materialize(_vectors(documents, numbers), "lexical-vectors")
    whole = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    if not whole["documents"] or not words:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("terms") > 0)
    holding = np.zeros(len(words), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[row["term"]] = row["count"]
    by_frequency = np.lexsort((np.arange(len(words)), -holding))
    ranks = np.empty(len(words), np.int64)
    ranks[by_frequency] = np.arange(len(words))
    holders: list[list[int]] = [[] for _ in words]
    for item, terms in enumerate(held):
        for term in terms:
            holders[int(ranks[numbers[term]])].append(item)
    weights = np.array([weight(whole["documents"], int(holding[t])) for t in by_frequency], np.int64)
    table = Items([np.array(h, np.int64) for h in holders], weights, len(items))

    def best(some: DataFrame, floors: np.ndarray) -> DataFrame:
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = _searched(some, ranks, table, whole["documents"], whole["total"], floors, k)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    floors = np.ones(len(items), np.int64)
    for row in best(vectors.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(FLOOR_SHARE)) == 0), floors).where(F.col("rank") == k).collect():
        floors[row["item"]] = row["score"]
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"item int, {schema.split(',')[0]}")
    return best(vectors, floors).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of items (item_id, text) its k best documents of (doc_id, text) with a score above 0.

    Terms are runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased; whole texts count. Equal
    scores go by ascending doc_id, null last. Null and empty texts have no terms: as documents they don't count, as items they
    get no rows. Repeated document rows are documents each; rows with one item_id are one item with the terms of all (null is
    an item_id like others). Empty tables give an empty result. Other columns aren't read. Items are served in passes of
    bounded size, each over all documents; a text of any length is one vector of its item terms.
    """
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {documents.schema['doc_id'].dataType.simpleString()}, score long"
    asked = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    passes = int(-(-size // PASS_CHARS)) or 1
    answers = documents.sparkSession.createDataFrame([], schema)
    for number in range(passes):
        texts: dict = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).orderBy("item_id", "text").collect():
            texts.setdefault(row["item_id"], []).append(row["text"])
        if texts:
            answers = answers.unionByName(_pass(documents, list(texts.items()), k, schema))
    return answers
