"""Catalogue of image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.patterns import IMAGE_EXTENSIONS
from quire.plans.blocks import with_sorted_seq


def number_images(files: DataFrame, path: str = "path") -> DataFrame:
    """Images of each folder in order of their lower-case name: ``folder, name, path, seq, n_seq, label``."""
    named = (
        files.withColumn("folder", F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
        .withColumn("name", F.element_at(F.split(path, "/"), -1))
        .withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
        .filter(F.col("ext").isin(IMAGE_EXTENSIONS))
        .withColumn("_low", F.lower("name"))
    )
    numbered = with_sorted_seq(named, ["folder"], ["_low", "name"], "seq", total="n_seq")
    return numbered.withColumn(
        "label",
        F.concat(
            F.lit("Image "), F.col("seq").cast("string"), F.lit("/"), F.col("n_seq").cast("string"), F.lit(": "), "name"
        ),
    ).drop("_low")


def catalog_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images directly in a folder. Only names and sizes are read; the content column is pruned."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))
    return number_images(files)
