"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last keep the columns of documents, whatever their names.

Null and empty texts go with the first stage, which knows no language for them; rows with a null doc_id stay like others, after
them in order; repeated rows are copies; texts of any length are read whole; empty documents give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, near_copies, packing, secret_scan, simhash, span_dedup
from tessera.llm.common import materialize, unused

#: Rows below this score are in none of the learned languages: a text that shares no n-gram with any landmark scores 0.25 among
#: four equally frequent languages, the shortest clean texts more than 0.3.
MIN_LANGUAGE_SCORE = 0.27


def _counted(changed: DataFrame, before: DataFrame) -> DataFrame:
    """Columns as before, n_chars counted anew where a text has changed."""
    return changed.select(*[F.when(F.col("text").isNotNull(), F.length("text")).cast(before.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in before.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a learned language; texts without a letter and texts unlike all of them go."""
    lang, score = unused(docs.columns, "lang"), unused(docs.columns, "score")
    found = language.predict(docs, language.fit(docs), lang, score)
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest doc_id: first by SimHash, then at a five-word Jaccard of 0.8."""
    return near_copies.keep_first(materialize(simhash.keep_first(docs), "near-dedup"))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove sentences covered by a repeated span that isn't the corpus's first; documents of which nothing is left go."""
    count = unused(docs.columns, "removed")
    found = span_dedup.deduplicate(docs, count)
    return _counted(found.where((F.col(count) == 0) | (F.trim("text") != "")).drop(count), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark."""
    return _counted(secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 1024."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("span_dedup", drop_repeated_spans),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
