"""A tree of Python sources as rows: modules with their imports, and the graph that they form."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def imports_of(source: str, module: str) -> list[str] | None:
    """The modules that a module's source names in its imports, relative ones resolved, in order and once each; None if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    found: dict[str, None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found.update(dict.fromkeys(alias.name for alias in node.names))
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                kept = module.split(".")[: -node.level]
                base = ".".join([*kept, *([base] if base else [])])
            found.update({base: None} if base else {})
    return list(found)


def modules(spark: SparkSession, root: str) -> DataFrame:
    """(module, path, layer, imports, parsed) of every .py file below root; layer is the module's first part, dots are folders.

    Files are read whole, one a row; a file that doesn't parse stays with no imports and parsed false. Spark passes over files
    whose names begin with an underscore, so a package (a folder with modules) is a row without path, imports and parsed.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(root, wholetext=True)
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    inner = F.substring_index(F.url_decode("_metadata.file_path"), base + "/", -1)
    rows = read.select(inner.alias("path"), F.col("value").alias("source"))
    named = rows.select(F.translate(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"), "path", "source")

    @F.udtf(returnType="imports array<string>, parsed boolean")
    class Imports:
        def eval(self, source: str, module: str):
            found = imports_of(source or "", module)
            yield found or [], found is not None

    spark.udtf.register("source_imports", Imports)
    named.createOrReplaceTempView("source_tree_files")
    parsed = spark.sql("SELECT module, path, imports, parsed FROM source_tree_files, LATERAL source_imports(source, module)")
    parts = F.split("module", r"\.")
    folders = named.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("module")).distinct()
    packages = folders.join(named.select("module"), "module", "left_anti")
    return parsed.unionByName(packages, allowMissingColumns=True).withColumn("layer", F.element_at(F.split("module", r"\."), 1))


def import_edges(modules_: DataFrame) -> DataFrame:
    """(from, to): imports that lead to a module of the tree, the longest one that a name begins with; a module isn't its own import."""
    named = modules_.select("module", F.explode("imports").alias("name"))
    parts = F.split("name", r"\.")
    heads = named.select("module", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("to"))
    known = heads.join(modules_.select(F.col("module").alias("to")), "to")
    best = known.groupBy("module", "name").agg(F.max_by("to", F.length("to")).alias("to"))
    return best.where("module <> to").select(F.col("module").alias("from"), "to").distinct()
