"""Rows of older tables in the columns of today's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of columns that older rows lack.
DEFAULTS = {"workspace": "legacy", "language": "c"}


def migrate(rows: DataFrame, schema: str | StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """rows in the columns of schema, in its order: other types are cast, missing columns and nulls in them get their default or stay null,
    columns beyond the schema go."""
    defaults = DEFAULTS if defaults is None else defaults
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def column(f):
        value = F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else value).alias(f.name)

    return rows.select(*[column(f) for f in kind.fields])
