"""How far a record is filled, rubric by rubric, as column expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _told(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(r"(?U)\S"), F.lit(False))


def filled(df: DataFrame, column: str) -> Column:
    """How much a rubric holds: items of an array, fields of a struct or values of a map that are not blank, the whole part
    of a number, 1 for any other value that is not blank; nulls hold 0."""
    kind, c = df.schema[column].dataType, df[column]
    if isinstance(kind, T.ArrayType):
        n = F.size(c)
    elif isinstance(kind, T.StructType):
        n = sum((_told(c[f]).cast("int") for f in kind.names), F.lit(0))
    elif isinstance(kind, T.MapType):
        n = F.size(F.filter(F.map_values(c), _told))
    elif isinstance(kind, T.NumericType):
        n = c.cast("long")
    else:
        n = _told(c).cast("int")
    return F.when(c.isNull(), F.lit(0)).otherwise(F.coalesce(n.cast("long"), F.lit(0)))


def fill_report(df: DataFrame, rubrics: dict[str, str], essential: Collection[str]) -> tuple[Column, Column, Column]:
    """(counts: map of label and count, missing: labels that hold nothing, in order; usable: no essential one is missing)
    of each record; `rubrics` are labels and their columns."""
    if unknown := set(essential) - set(rubrics):
        raise ValueError(f"no rubric named {', '.join(sorted(unknown))}")
    counts = {label: filled(df, column) for label, column in rubrics.items()}
    missing = F.array_compact(F.array(*[F.when(n == 0, F.lit(label)) for label, n in counts.items()]))
    usable = ~F.arrays_overlap(missing, F.array(*map(F.lit, essential)))
    return F.create_map(*[x for label, n in counts.items() for x in (F.lit(label), n)]), missing, usable
