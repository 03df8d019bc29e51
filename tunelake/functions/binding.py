"""Use one computed value several times within an expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once per row.

    Spark repeats a costly expression for every place it is used in, inside conditionals above
    all. A lambda variable over a one-element array is computed once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
