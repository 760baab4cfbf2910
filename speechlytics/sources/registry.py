"""The service registry: which vendor and model a service entry stands for.

A registry is a JSON-lines file of (service_name, vendor, model_label, is_current). It is append-only: a superseded row is
marked as not current and never edited, and every row has a label ('N/A' where there is no model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "service_name string, vendor string, model_label string, is_current boolean"


def service_registry(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(REGISTRY).json(path)
    label = F.when(F.coalesce(F.trim("model_label"), F.lit("")) == "", F.lit("N/A")).otherwise(F.col("model_label"))
    return rows.select(
        F.lower(F.trim("service_name")).alias("service_name"), "vendor", label.alias("model_label"),
        F.coalesce("is_current", F.lit(True)).alias("is_current"),
    )


def registry_problems(registry: DataFrame) -> DataFrame:
    """(vendor, model_label, problem) of what breaks the rules: repeated rows, vendors without a current one."""
    twice = registry.groupBy("vendor", "model_label").count().filter("count > 1")
    none = registry.groupBy("vendor").agg(F.bool_or("is_current").alias("any")).filter("NOT any")
    return twice.select("vendor", "model_label", F.lit("written twice").alias("problem")).unionByName(
        none.select("vendor", F.lit(None).cast("string").alias("model_label"), F.lit("no current row").alias("problem"))
    )


def registry_rows(registry: DataFrame, summary: DataFrame) -> DataFrame:
    """A summary by service with vendor and model of the registry; unknown services are left out."""
    names = registry.select("service_name", "vendor", F.col("model_label").alias("model"), "is_current")
    return summary.join(names, "service_name")
