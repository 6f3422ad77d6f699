"""Uploaded files and the raw store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ingest import validate_uploads


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, size_bytes, content_hash, data, mime_type, rejection of all files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.lit(None).cast("string").alias("declared_mime"), F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("content_hash"), F.col("content").alias("data"),
    )
    return validate_uploads(rows)


def raw_key(source: Column, document_id: Column, version: Column, filename: Column) -> Column:
    """Path of an original in the raw store, without a way up."""
    trimmed = lambda c: F.replace(F.btrim(c, F.lit("/")), F.lit(".."), F.lit(""))
    return F.concat_ws("/", F.lit("raw"), trimmed(source), trimmed(document_id.cast("string")), F.concat(F.lit("v"), version.cast("string")), trimmed(filename))


def write_raw(files: DataFrame, path: str) -> None:
    """Originals by source, beside their keys."""
    files.write.mode("append").partitionBy("source").parquet(path)


def staging_key(organization: Column, job: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("staging"), organization.cast("string"), job.cast("string"), filename)


def config_permissions(users: list, groups: list) -> tuple[Column, Column]:
    """Lists from a source's settings as columns."""
    cast = lambda xs: F.array(*[F.lit(str(x)) for x in xs]).cast("array<string>")
    return cast(users), cast(groups)
