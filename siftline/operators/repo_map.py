"""Semantic repository map: packages by their manifest, then conventional directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text

# Directories with a conventional role.
CONVENTIONS = {
    "src": ("source", "Primary source-code boundary."), "source": ("source", "Primary source-code boundary."),
    "test": ("tests", "Automated test boundary."), "tests": ("tests", "Automated test boundary."),
    "docs": ("documentation", "Project documentation and architecture knowledge."), "documentation": ("documentation", "Project documentation and architecture knowledge."),
    "config": ("configuration", "Repository configuration boundary."), "configuration": ("configuration", "Repository configuration boundary."),
    "examples": ("examples", "Runnable or illustrative project examples."), "benchmarks": ("benchmarks", "Benchmark inputs, fixtures, and evidence."),
}
PACKAGE = "workspace_package"


def modules(files: DataFrame) -> DataFrame:
    """path, id, kind, role, evidence of every module; files has path and content (of package.json at least).

    A directory with a named manifest is a package; a top directory of a conventional name
    is a module unless it is a package already.
    """
    spark = files.sparkSession
    safe = files.where(~paths.is_sensitive(F.col("path")))
    manifest = safe.where(paths.file_name(F.col("path")) == "package.json").select(paths.directory(F.col("path")).alias("dir"), F.from_json(F.col("content").cast("string"), "name string, description string").alias("m"))
    place, about = F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.nullif(F.trim("m.description"), F.lit(""))
    named = F.array_compact(F.array(F.concat(F.lit("package.json name="), F.col("m.name")), F.when(about.isNotNull(), "package.json description")))
    packages = manifest.where("m.name <> ''").select(
        place.alias("path"), _id(F.lit(PACKAGE), F.col("m.name")), F.lit(PACKAGE).alias("kind"), F.coalesce(about, F.concat(F.lit("Package "), F.col("m.name"), F.lit("."))).alias("role"), named.alias("evidence")
    )
    known = spark.createDataFrame([(d, k, r) for d, (k, r) in CONVENTIONS.items()], "folder string, kind string, role string")
    tops = safe.where(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("path")).distinct()
    plain = tops.join(known, F.lower("path") == F.col("folder")).join(packages, "path", "left_anti")
    plain = plain.select("path", _id(F.col("kind"), F.col("path")), "kind", "role", F.array(F.concat(F.lit("conventional directory: "), F.col("path"))).alias("evidence"))
    return packages.unionByName(plain).orderBy("path")


def _id(kind: Column, name: Column) -> Column:
    return text.module_slug(F.concat_ws(":", kind, name)).alias("id")
