"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.columns import col, nan_to_null


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header line. Give a schema for large files: inferring reads them twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header line; one file only if asked for, as that is one task's work."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_features(df: DataFrame, root: str, version: str | int, layout=None) -> str:
    """Store one feature-set version, partitioned by split so that either part reads alone."""
    path = f"{root.rstrip('/')}/features/version={version}"
    writer = df.write.mode("overwrite")
    split = layout.split if layout else "split"
    if split in df.columns:
        writer = writer.partitionBy(split)
    writer.parquet(path)
    return path


def submission(preds: DataFrame, value: str, id_col: str = "id", name: str = "target") -> DataFrame:
    """The two columns of a submission: the row's own id and its prediction."""
    return preds.select(col(id_col).alias("id"), col(value).alias(name))
