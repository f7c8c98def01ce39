"""Column types that all files agree on, found in one pass over all records.

The kinds of value that a column holds are a set of bits; sets of two parts of the data join by ``or``, in any order
and any grouping. A set is then read as the smallest type that holds all of its kinds: whole numbers widen
to long and double, every other mixture is text. Nothing depends on which file comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, LONG, DOUBLE, BOOLEAN, DATE, TEXT = (1 << k for k in range(6))

_WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
_NUMBER = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def kind_of(value: Column) -> Column:
    """The kind of one text value; 0 for a null or an empty one.

    A number with a leading zero is text, as identifiers have them.
    """
    return (
        F.when(F.coalesce(value, F.lit("")) == "", 0)
        .when(value.rlike(_WHOLE) & value.try_cast("int").isNotNull(), INT)
        .when(value.rlike(_WHOLE) & value.try_cast("long").isNotNull(), LONG)
        .when(value.rlike(_NUMBER), DOUBLE)
        .when(F.upper(value).isin("TRUE", "FALSE", "T", "F"), BOOLEAN)
        .when(value.rlike(_DAY) & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), DATE)
        .otherwise(TEXT)
    )


def type_of(kinds: int) -> T.DataType:
    """The smallest type that holds all ``kinds``; text where there is no value at all."""
    if kinds == BOOLEAN:
        return T.BooleanType()
    if kinds == DATE:
        return T.DateType()
    if 0 < kinds < BOOLEAN:
        return T.DoubleType() if kinds & DOUBLE else T.LongType() if kinds & LONG else T.IntegerType()
    return T.StringType()


def column_kinds(records: DataFrame, names: str = "names", values: str = "values") -> DataFrame:
    """(name, kinds, filled, place): per column name over all records, whatever their layout.

    ``names`` and ``values`` are arrays; a value belongs to the name at its position. ``filled`` counts the
    values that are not missing, ``place`` is the leftmost position of the name. Sums are made before the
    shuffle, which moves one row per name and task.
    """
    cells = records.select(names, F.posexplode(values).alias("at", "value"))
    named = cells.select(F.get(F.col(names), F.col("at")).alias("name"), "at", kind_of(F.col("value")).alias("kind"))
    return named.where("name IS NOT NULL").groupBy("name").agg(
        F.bit_or("kind").alias("kinds"), F.count_if(F.col("kind") > 0).alias("filled"), F.min("at").alias("place"))


def agreed_schema(kinds: DataFrame) -> T.StructType:
    """Schema over all names of :func:`column_kinds`, by position and name. One row per name reaches the driver."""
    rows = kinds.orderBy("place", "name").collect()
    return T.StructType([T.StructField(r["name"], type_of(r["kinds"])) for r in rows])
