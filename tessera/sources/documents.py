"""Document sources and sinks that check what they carry: several shapes of JSON, file digests, results with error rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def document_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, place, id, title, content, tags) of all JSON files of a pattern: a list of documents, an object with `documents` or
    `docs`, or one document.

    place counts from 0 within a file; a document without id gets rag_doc_<place + 1>; title and content are empty texts where
    absent, tags an empty array. List entries that aren't objects are left out. A file that isn't JSON fails the job, named.
    """
    read = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    value = F.try_parse_json("text")
    checked = read.select("file", F.when(value.isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.col("file"))).cast("variant")).otherwise(value).alias("v"))

    def listed(path: str):
        return F.try_variant_get("v", path, "array<variant>")

    rows = checked.select("file", F.posexplode(F.coalesce(listed("$"), listed("$.documents"), listed("$.docs"), F.array("v"))).alias("place", "d"))
    rows = rows.where(F.schema_of_variant("d").startswith("OBJECT"))

    def text(name: str):
        return F.try_variant_get("d", f"$.{name}", "string")

    made = F.concat(F.lit("rag_doc_"), (F.col("place") + 1).cast("string"))
    tags = F.coalesce(F.try_variant_get("d", "$.tags", "array<string>"), F.array().cast("array<string>"))
    return rows.select("file", "place", F.coalesce(text("id"), made).alias("id"), F.coalesce(text("title"), F.lit("")).alias("title"), F.coalesce(text("content"), F.lit("")).alias("content"), tags.alias("tags"))


def file_digests(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, sha256) of the files of a folder; files are read whole, one a row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def attempted(rows: DataFrame, function: Callable[[dict], dict], name: str = "result") -> DataFrame:
    """Add to rows what function(row as a dict) gives, as JSON, and error: a row on which it fails has its error's kind and text
    and no result, and the others go on."""
    schema = StructType([*rows.schema.fields, StructField(name, StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, errors = [], []
            for row in batch.to_pylist():
                try:
                    results.append(json.dumps(function(row), sort_keys=True, ensure_ascii=False))
                    errors.append(None)
                except Exception as error:  # any failure of an item is its result
                    results.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, name, "error"])

    return rows.mapInArrow(run, schema)
