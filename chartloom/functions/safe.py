"""Values that JSON can hold, at every depth of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_float(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType) or not isinstance(kind.keyType, T.StringType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def safe_value(c: Column, kind: T.DataType) -> Column:
    """NaN and infinities as null, map keys as text, in structs, arrays and maps too; other values as they are."""
    if not _has_float(kind):
        return c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[safe_value(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: safe_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, v: k.cast("string")), lambda k, v: safe_value(v, kind.valueType))
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def json_safe(df: DataFrame) -> DataFrame:
    """``df`` with values that JSON can hold."""
    return df.select(*[safe_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
