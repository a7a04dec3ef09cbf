"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_000


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send texts to Python in small batches; a row may be megabytes long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 without an id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts, F.lit(-1))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``key``: a stated bound, the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(1), key), key).limit(rows)


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve; ties count half, one class alone gives 0.5."""
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n = int(label.sum())
    if n in (0, len(label)):
        return 0.5
    return float((rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a two-dimensional array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
