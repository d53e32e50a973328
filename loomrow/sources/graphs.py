"""Heat graphs and METIS files in folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def write_lines(lines: DataFrame, path: str, order: str = "line_no") -> None:
    """Text files whose names and lines are in the order of the lines."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)
