"""Which Spark types count as what: the one place that decides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row number that loaders add; never part of a result.
RID = "_rid"


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))


def is_boolean(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def is_numeric_like(t: T.DataType) -> bool:
    """Numbers and booleans, as target detection sees them."""
    return is_number(t) or is_boolean(t)


def is_categorical(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_datetime(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def kind_of(t: T.DataType) -> str:
    """number, boolean, categorical, datetime or other (decimals, arrays, structs ...)."""
    for name, test in (("number", is_number), ("boolean", is_boolean), ("categorical", is_categorical), ("datetime", is_datetime)):
        if test(t):
            return name
    return "other"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[str]:
    """The table's own columns."""
    return [c for c in df.columns if c != RID]


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN taken as missing."""
    return F.nanvl(col(name), F.lit(None)) if is_float(df.schema[name].dataType) else col(name)


def with_rid(df: DataFrame) -> DataFrame:
    """df with a row number that rises in scan order; kept if it is there already."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def without_rid(df: DataFrame) -> DataFrame:
    return df.drop(RID)
