"""Sources: directory scans, JSON and text documents, knowledge packs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas

# File suffixes that count as raw images.
RAW_SUFFIXES = ("dng", "nef", "cr2", "cr3", "arw", "raf", "orf", "rw2", "pef")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_directory(spark: SparkSession, folder: str, suffixes: Sequence[str] = RAW_SUFFIXES, recursive: bool = False) -> DataFrame:
    """(path, name, stem, size) of files with one of the suffixes, hidden files left out. Contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    name = _name(F.col("path"))
    rows = found.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"))
    return rows.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes) & ~F.col("name").startswith("."))


def first_per_stem(files: DataFrame) -> DataFrame:
    """One file per stem, the first by path."""
    return files.withColumn("__n", F.row_number().over(Window.partitionBy("stem").orderBy("path"))).where("__n = 1").drop("__n")


def json_reports(spark: SparkSession, pattern: str, field: str, element: str) -> DataFrame:
    """The elements of an array in every JSON document of a pattern, with the document's path; malformed documents are left out."""
    read = spark.read.schema(f"{field} array<{element}>, _corrupt_record string").option("multiLine", "true").json(pattern)
    return read.where(F.col("_corrupt_record").isNull() & F.col(field).isNotNull()).select(F.col("_metadata.file_path").alias("report"), F.inline(field))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines rows; lines of another form are left out."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").json(path)
    return read.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def knowledge_packs(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all packs: the first pack's definition of an id stays, edges without an id get the pack's name and their place, edges without both ends go."""
    read = spark.read.schema(f"nodes array<struct<{_fields(schemas.NODE)}>>, edges array<struct<{_fields(schemas.EDGE)}>>").option("multiLine", "true").json(pattern)
    read = read.withColumn("pack", _name(F.col("_metadata.file_path")))
    nodes = read.select("pack", F.posexplode("nodes").alias("pos", "n")).select("pack", "pos", "n.*")
    nodes = nodes.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("pack", "pos"))).where("__n = 1").drop("__n", "pos")
    edges = read.select("pack", F.posexplode("edges").alias("pos", "e")).select("pack", "pos", "e.*")
    edges = edges.withColumn("id", F.coalesce("id", F.concat_ws(":", "pack", F.concat(F.lit("e"), F.col("pos") + 1))))
    edges = edges.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("pack", "pos"))).where("__n = 1").drop("__n", "pos")
    ids = nodes.select("id")
    kept = edges.join(ids.select(F.col("id").alias("from")), "from", "left_semi").join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    return nodes, kept


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in schema.split(", ")))


def style_cards(spark: SparkSession, folder: str) -> DataFrame:
    """(style_id, stages map, metadata map) of a folder of JSON cards; the id is the file's stem, cards without stages go."""
    read = spark.read.schema("stages map<string, map<string, double>>, metadata map<string, string>, _corrupt_record string").option("multiLine", "true").json(folder)
    stem = F.regexp_replace(_name(F.col("_metadata.file_path")), r"\.json$", "")
    return read.where(F.col("_corrupt_record").isNull() & F.col("stages").isNotNull()).select(stem.alias("style_id"), "stages", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def cube_table(spark: SparkSession, path: str) -> DataFrame:
    """(i, r, g, b) of a text lookup table, in file order, comments and headers left out."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda line: line.rlike(r"^\s*[-+0-9.]"))).alias("i", "line"))
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    return rows.select("i", *[F.try_element_at(numbers, F.lit(k)).alias(c) for k, c in enumerate("rgb", 1)])


def with_ids(documents: DataFrame, key: str, prefix: str, order: Sequence[str]) -> DataFrame:
    """Missing ids filled as prefix and row number within their source order."""
    place = F.row_number().over(Window.partitionBy(F.col(key).isNull()).orderBy(*order))
    return documents.withColumn(key, F.coalesce(key, F.concat(F.lit(prefix), place.cast("string"))))


# The schema tag of point clouds and the names of a point's values.
POINT_CLOUD, POINT_FIELDS = "hue_points.v1", ("h", "c", "l", "dh", "c_gain", "l_gain")


def point_clouds(spark: SparkSession, pattern: str, tag: str = POINT_CLOUD) -> DataFrame:
    """(cloud, strength, h, c, l, dh, c_gain, l_gain): the points of every JSON document of a pattern; cloud is its file name.

    A document that is malformed, has another schema tag or no points fails the job and is named; strength is 1 where absent.
    """
    values = ", ".join(f"{f}: double" for f in POINT_FIELDS)
    read = spark.read.schema(f"schema string, strength double, points array<struct<{values}>>, _corrupt_record string").option("multiLine", "true").json(pattern)
    name = _name(F.col("_metadata.file_path"))

    def refuse(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what}: "), name))

    sound = F.when(F.col("_corrupt_record").isNotNull(), refuse("malformed point cloud")).when(~F.col("schema").eqNullSafe(tag), refuse("unknown schema of a point cloud"))
    sound = sound.when(F.coalesce(F.size("points"), F.lit(0)) < 1, refuse("point cloud without points")).otherwise(F.col("points"))
    return read.select(name.alias("cloud"), F.coalesce("strength", F.lit(1.0)).alias("strength"), F.inline(sound))
