"""PIVOT BY: values of one column become columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_by(frame: DataFrame, key: int, across: int, most: int = 10_000) -> DataFrame:
    """One row for each value of the column at ``key``; for each value of the column at ``across``
    in text order, one column for each remaining one. The first column is named ``key/across``.
    Values become column names, so there may be ``most`` of them at most; more is an error."""
    names = frame.columns
    frame = frame.toDF(*(f"c{i}" for i in range(len(names))))
    values = [r[0] for r in frame.select(F.col(f"c{across}").cast("string")).distinct().orderBy(f"c{across}").limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"PIVOT BY over more than {most} values")
    rest = [i for i in range(len(names)) if i not in (key, across)]
    value = F.coalesce(F.col(f"c{across}").cast("string"), F.lit("null"))
    labels = sorted("null" if v is None else v for v in values)
    picks = [
        F.first(F.when(value == v, F.col(f"c{i}")), ignorenulls=True).alias(v if len(rest) == 1 else f"{v}/{names[i]}")
        for v in labels for i in rest
    ]
    return frame.groupBy(F.col(f"c{key}").alias(f"{names[key]}/{names[across]}")).agg(*picks)
