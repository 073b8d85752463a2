"""Masking of secrets in string and map columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name parts that mark a secret, and the mask.
SECRET_MARKERS = ("authorization", "cookie", "credential", "key", "password", "secret", "token")
MASK = "***"
SECRET_TEXT = rf"(?i)({'|'.join(SECRET_MARKERS)})\s*[:=]\s*\S+"


def is_secret_name(name: str) -> bool:
    return any(marker in name.casefold() for marker in SECRET_MARKERS)


def secret_key(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SECRET_MARKERS))


def mask_text(text: Column) -> Column:
    return F.when(text.rlike(SECRET_TEXT), F.lit(MASK)).otherwise(text)


def mask_map(values: Column) -> Column:
    """Mask map values by their key, or by their own text."""
    return F.transform_values(
        values, lambda k, v: F.when(secret_key(k), F.lit(MASK)).otherwise(mask_text(v))
    )


def _masked(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return mask_text(value)
    if isinstance(kind, T.MapType):
        return F.transform_values(
            value,
            lambda k, v: F.when(secret_key(k), F.lit(MASK).cast(kind.valueType)).otherwise(
                _masked(v, kind.valueType)
            ),
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _masked(v, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(
            value.isNotNull(),
            F.struct(*[_field(value[f.name], f.name, f.dataType) for f in kind.fields]),
        )
    return value


def _field(value: Column, name: str, kind: T.DataType) -> Column:
    if is_secret_name(name):
        return F.lit(MASK).alias(name)
    return _masked(value, kind).alias(name)


def redact(df: DataFrame) -> DataFrame:
    """Every column of ``df`` masked by name and by text, nested ones included."""
    return df.select(*[_field(df[f.name], f.name, f.dataType) for f in df.schema.fields])
