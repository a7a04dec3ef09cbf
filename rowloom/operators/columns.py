"""Projections, casts and simple derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.layout import DEFAULT, Layout


def q(name: str) -> str:
    """A column name quoted for SQL text.

    Wide projections are written as SQL text: one call each to the JVM, where
    column objects cost several.
    """
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float | None) -> str:
    """A number as a SQL double literal."""
    return "cast(null as double)" if value is None else f"({value!r}D)"


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col(q(name))


def rename_known(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; names that do not are ignored."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def drop_matching(df: DataFrame, text: str, keep: Iterable[str] = ()) -> DataFrame:
    """Drop every column whose name contains ``text``."""
    kept = set(keep)
    return df.select(*[q(c) for c in df.columns if text not in c or c in kept])


def categorical_columns(df: DataFrame, layout: Layout = DEFAULT) -> list[str]:
    """String columns that are not reserved, in table order."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name not in layout.reserved
    ]


def numeric_columns(df: DataFrame, layout: Layout = DEFAULT) -> list[str]:
    """Numeric columns that are not reserved, in table order."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in layout.reserved
    ]


def map_label(df: DataFrame, name: str, mapping: Mapping[str, int]) -> DataFrame:
    """Replace label texts by integers; a text outside ``mapping`` fails the job."""
    source = col(name)
    value = F.raise_error(
        F.concat(F.lit(f"no code for label in {name}: "), F.coalesce(source, F.lit("null")))
    ).cast("long")
    for text, code in mapping.items():
        value = F.when(source == text, F.lit(code).cast("long")).otherwise(value)
    return df.withColumn(name, value)


def positive_flag(name: str) -> Column:
    return (col(name) > 0).cast("int")


def differs_flag(name: str, sentinel) -> Column:
    return (col(name) != F.lit(sentinel)).cast("int")


def cast_columns(df: DataFrame, names: Iterable[str], kind: str) -> DataFrame:
    """Cast the named columns in one projection."""
    wanted = set(names)
    return df.select(
        *[col(c).cast(kind).alias(c) if c in wanted else col(c) for c in df.columns]
    )


def placeholder(df: DataFrame, name: str, value, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(value).cast(kind))


def default_weight(df: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Make sure a double ``weight`` column exists, 1.0 where nothing is given."""
    if layout.weight in df.columns:
        value = F.coalesce(col(layout.weight).cast("double"), F.lit(1.0))
    else:
        value = F.lit(1.0)
    return df.withColumn(layout.weight, value)


def class1_probability(df: DataFrame, name: str) -> Column:
    """Class-1 probability from a plain number, or from a vector of one or two entries."""
    kind = df.schema[name].dataType
    if isinstance(kind, VectorUDT):
        values = vector_to_array(col(name))
    elif isinstance(kind, T.ArrayType):
        values = col(name)
    else:
        return col(name).cast("double")
    return F.when(F.size(values) == 1, F.get(values, 0)).otherwise(F.get(values, 1))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in all floating point columns, so that one test finds missing values."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def first_rows(df: DataFrame, n: int, layout: Layout = DEFAULT) -> DataFrame:
    """The ``n`` rows with the smallest ids (a top-n, not a full sort)."""
    return df.orderBy(layout.id).limit(n)
