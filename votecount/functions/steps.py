"""Intermediate columns that are worked out once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a one-row lateral view.

    The optimizer folds projections into each other and pushes filters through them, which
    repeats an expensive expression at every place its column is used. It does neither
    through a generator, so whatever reads these columns reads a computed value.

    The row is built in a projection below the generator: what a generator is given itself
    runs without generated code as soon as one function in it takes a lambda.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    built = df.select(*kept, F.array(row).alias("_fila"))
    return built.select(*kept, F.inline_outer("_fila"))
