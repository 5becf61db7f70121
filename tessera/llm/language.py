"""Language identification by string kernels.

Two texts are compared by a blended-spectrum presence kernel: the character n-grams of one, two and three characters that
both contain, over the geometric mean of their numbers of n-grams. Nyström landmarks turn the kernel into features, and
one-versus-rest kernel ridge regression is solved on them. Texts are scored in batches: a presence matrix times the
landmarks' gives the kernel values, and those times the coefficients give a score per language.

N-grams are hashed into 2**20 numbers. The classifier is fitted on a bounded sample of labelled rows (parameters
per_language and max_rows), whose kernel values against the landmarks are computed in tasks.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialize

PER_LANGUAGE = 400
MAX_ROWS = 8000
LANDMARKS = 128
RIDGE = 1e-3
HASH_BITS = 20
UNKNOWN = "und"
BLOCK = 128


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_seen: list[np.ndarray] = []


def ngrams(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text: lower case, every run of other characters than letters one space. Empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint32)
    if codes[0] != 32:
        codes = np.concatenate([np.array([32], np.uint32), codes])
    if codes[-1] != 32:
        codes = np.concatenate([codes, np.array([32], np.uint32)])
    one = codes * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(0x85EBCA77) + one[1:]
    three = two[:-1] * np.uint32(0xC2B2AE3D) + one[2:]
    grams = np.concatenate([_finish(one, 1), _finish(two, 2), _finish(three, 3)])
    if not _seen:
        _seen.append(np.empty(1 << HASH_BITS, np.int32))
    order = np.arange(len(grams), dtype=np.int32)
    _seen[0][grams] = order
    return grams[_seen[0][grams] == order]


def _finish(values: np.ndarray, n: int) -> np.ndarray:
    values = (values ^ (values >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
    return (values ^ (values >> np.uint32(16))) >> np.uint32(32 - HASH_BITS)


@dataclass
class Model:
    """languages; vocabulary (hashed n-grams of the landmarks); landmarks (n-grams x landmarks, scaled); coefficients with bias."""

    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    coefficients: np.ndarray
    bias: np.ndarray

    def numbers(self) -> np.ndarray:
        """The column of each hashed n-gram, or -1."""
        table = np.full(1 << HASH_BITS, -1, np.int32)
        table[self.vocabulary] = np.arange(len(self.vocabulary))
        return table

    def scores(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores by language, whether the text has a letter)."""
        out = np.zeros((len(texts), len(self.languages)))
        known = np.zeros(len(texts), bool)
        for start in range(0, len(texts), BLOCK):
            block = texts[start : start + BLOCK]
            present = np.zeros((len(block), len(self.vocabulary)), np.float32)
            sizes = np.ones(len(block), np.float32)
            for row, text in enumerate(block):
                grams = ngrams(text)
                known[start + row] = len(grams) > 0
                sizes[row] = max(1, len(grams))
                columns = table[grams]
                present[row, columns[columns >= 0]] = 1.0
            kernel = (present @ self.landmarks) / np.sqrt(sizes)[:, None]
            out[start : start + len(block)] = kernel @ self.coefficients + self.bias
        return out, known


def _base(landmarks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' distinct n-grams, and a matrix (n-grams x landmarks) of presence over the root of a landmark's size."""
    vocabulary = np.unique(np.concatenate(landmarks))
    base = np.zeros((len(vocabulary), len(landmarks)), np.float32)
    for column, grams in enumerate(landmarks):
        base[np.searchsorted(vocabulary, grams), column] = 1.0 / np.sqrt(len(grams))
    return vocabulary, base


def _train(vocabulary: np.ndarray, base: np.ndarray, kernel: np.ndarray, langs: list[str], ridge: float) -> Model:
    """Ridge regression on Nyström features; kernel has a row per labelled text, the landmarks' own first."""
    languages = sorted(set(langs))
    values, vectors = np.linalg.eigh(kernel[: kernel.shape[1]])
    kept = values > max(1e-8, values.max() * 1e-8)
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel @ root
    targets = np.where(np.array(langs)[:, None] == np.array(languages)[None], 1.0, -1.0)
    mean_x, mean_y = features.mean(axis=0), targets.mean(axis=0)
    centred = features - mean_x
    weights = np.linalg.solve(centred.T @ centred + ridge * len(langs) * np.eye(centred.shape[1]), centred.T @ (targets - mean_y))
    return Model(languages, vocabulary, base, (root @ weights).astype(np.float64), mean_y - mean_x @ weights)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of doc_id as text leaves remainder 2 by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of text and lang of the rows that aren't held out; None if there are none with letters.

    At most per_language texts of each language, chosen by a hash of doc_id and text, and at most max_rows texts and languages
    in all; large languages are thinned by the same hash before any is ranked. Rows with null doc_id or lang and texts that are
    null or without a letter are left out before that, and repeated rows count once. Only the landmarks' n-grams and one
    kernel value per text and landmark come to the driver, whatever the texts' lengths.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("mark"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    shares = rows.groupBy("lang").agg(F.approx_count_distinct("mark").alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_rows)
    shares = shares.select("lang", F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("rows")).alias("share"))
    thinned = rows.join(F.broadcast(shares), "lang").where(F.pmod("mark", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "mark", "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id"))
    picked = thinned.withColumn("place", place).where(F.col("place") <= per_language).orderBy("place", "lang").limit(max_rows)
    texts = rows.join(F.broadcast(picked), ["lang", "mark", "doc_id"]).dropDuplicates(["lang", "mark", "doc_id"])
    texts = materialize(texts.select("lang", "place", "text"), "language-sample")

    def numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ngrams(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["lang", "place", "grams"])

    leading = texts.where("place <= %d" % landmarks).orderBy("place", "lang").limit(landmarks)
    chosen = sorted(map_batches(leading, numbers, "lang string, place int, grams array<int>").where("size(grams) > 0").collect(), key=lambda r: (r["place"], r["lang"]))
    if not chosen:
        return None
    vocabulary, base = _base([np.array(r["grams"], np.int64) for r in chosen])
    table = np.full(1 << HASH_BITS, -1, np.int32)
    table[vocabulary] = np.arange(len(vocabulary))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(2).to_pylist():
            grams = ngrams(text)
            columns = table[grams]
            found.append(base[columns[columns >= 0]].sum(axis=0, dtype=np.float64) / np.sqrt(len(grams)) if len(grams) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["lang", "place", "row"])

    sample = map_batches(texts, kernel, "lang string, place int, row array<double>").where("row is not null").toPandas()
    first = {(r["lang"], r["place"]): k for k, r in enumerate(chosen)}
    sample["order"] = [first.get(key, len(first)) for key in zip(sample["lang"], sample["place"], strict=True)]
    sample = sample.sort_values(["order", "place", "lang"], kind="stable")
    return _train(vocabulary, base, np.stack(sample["row"].tolist()), sample["lang"].tolist(), ridge)


def predict(documents: DataFrame, model: Model | None, lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """documents with the predicted language and its score (0 to 1) added last; every row stays and every other column.

    Null text, texts without a letter and a missing model give `und` and 0. score is half of one more than the winning
    language's regression value (which is 1 for a sure yes and -1 for a sure no), cut to 0..1; ties go to the language that
    sorts first. Existing columns of the two names are replaced. Texts of any length are read whole; repeated rows repeat; an
    empty table gives an empty table.
    """
    names = [c for c in documents.columns if c not in (lang_column, score_column)]
    plain = documents.select(*[F.col(f"`{c}`") for c in names])
    position = names.index("text")
    schema = plain.withColumns({lang_column: F.lit(""), score_column: F.lit(0.0)}).schema
    table = model.numbers() if model is not None else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(position).to_pylist()]
        if model is None:
            langs, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
        else:
            scores, known = model.scores(texts, table)
            best = scores.argmax(axis=1)
            langs = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            values = np.where(known, np.clip((scores.max(axis=1) + 1) / 2, 0.0, 1.0), 0.0)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(langs, pa.string()), pa.array(values)], [*names, lang_column, score_column])

    return map_batches(plain, run, schema)
