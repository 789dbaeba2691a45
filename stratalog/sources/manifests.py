"""Manifests of archives as JSON, and folders of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "schema_version int, volume string, path string, size bigint, digest string, deleted boolean"
#: Versions of the manifest that can be read; the second one names deleted paths.
VERSIONS = (1, 2)


def write_manifest(files: DataFrame, folder: str, volume: str, deleted: DataFrame | None = None) -> None:
    """One line of JSON per file or deleted path: path, size, digest; an archive of any size is written by many tasks."""
    rows = files.select(F.lit(VERSIONS[-1]).alias("schema_version"), F.lit(volume).alias("volume"), "path", "size", "digest", F.lit(False).alias("deleted"))
    if deleted is not None:
        rows = rows.unionByName(deleted.select(F.lit(VERSIONS[-1]).alias("schema_version"), F.lit(volume).alias("volume"), "path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("digest"), F.lit(True).alias("deleted")))
    rows.write.mode("errorifexists").json(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, digest, deleted of an archive; a line of another version fails the job."""
    rows = spark.read.schema(SCHEMA).json(folder)
    known = F.col("schema_version").isin(*VERSIONS)
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("manifest version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing")))).cast("string"))
    return rows.select(checked.alias("path"), "size", "digest", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def chain(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The manifests of a full archive and its increments with the step of each: path, step, deleted, digest."""
    steps = [read_manifest(spark, f).select("path", F.lit(k).alias("step"), "deleted", "digest") for k, f in enumerate(folders)]
    out = steps[0]
    for more in steps[1:]:
        out = out.union(more)
    return out


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """name, files, bytes of the snapshot folders under a folder, by the files in them, newest name first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -2).alias("name"), "length")
    return files.groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("name"))
