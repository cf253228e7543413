"""Numeric helpers that keep one notion of *missing*: NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """The value when finite, otherwise NULL."""
    number = c.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality of two measures."""
    return ~finite(a).eqNullSafe(finite(b))


def share(part: Column, total: Column) -> Column:
    """Ratio that is NULL on a zero denominator."""
    return F.try_divide(part.cast("double"), total.cast("double"))


def direction(residual: Column) -> Column:
    """``under``, ``over`` or ``none`` from the sign of prediction minus observation."""
    return (
        F.when(residual < 0, F.lit("under")).when(residual > 0, F.lit("over")).otherwise(
            F.when(residual.isNotNull(), F.lit("none"))
        )
    )


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda item: _clean(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, item: _clean(item, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def non_finite_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by NULL in every column, nested values included."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
