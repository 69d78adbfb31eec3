"""Windows over all rows, in order, as many tasks: rows are dealt by ranges of the order, each range
is numbered or summed by itself, and what the ranges before it hold is added. Counts of the rows below
another row's value are such sums over both sides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.sources.scratch import cut, discard, shared_folder, stored_bytes

FUNCTIONS = {"row_number", "rank", "dense_rank", "count", "sum", "min", "max"}
#: Estimated bytes of a range (of Parquet, where a table is read): Spark's adaptive execution would
#: merge ranges until each core has one, whose memory grows with the input.
RANGE_BYTES = 2 << 20
#: Estimates from here on say that nothing is known.
UNKNOWN = 1 << 60


@dataclass(frozen=True)
class Running:
    """A function from the first row to the current one, or to the last of its peers. ``order``: of
    each key its column, whether it descends and whether nulls come first; ``value``: SQL."""

    column: str
    function: str
    order: tuple[tuple[str, bool, bool], ...]
    value: str = "1"
    peers: bool = True


@dataclass(frozen=True)
class Counted:
    """The number of rows of ``inner`` (``k``, and how often it occurs, ``n``) whose ``k`` has the
    relation ``op`` to the column ``outer``; none where that is null."""

    column: str
    inner: DataFrame
    op: str
    outer: str


def _keys(order) -> list[Column]:
    return [getattr(F.col(c), f"{'desc' if desc else 'asc'}_nulls_{'first' if nulls_first else 'last'}")() for c, desc, nulls_first in order]


def _ranges(frame: DataFrame, keys: list[Column]) -> DataFrame:
    parts, size = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_bytes(frame)
    wanted = min(size // RANGE_BYTES, 10 * parts) if size < UNKNOWN else 0
    return frame.repartitionByRange(wanted, *keys) if wanted > 1 else frame.repartitionByRange(*keys)


def _dealt(frame: DataFrame, keys: list[Column], peers: bool) -> DataFrame:
    """A scratch table of the rows with the number ``__p`` of their range, as a second run would draw
    other ranges. Peers stay together, or else rows have their place in the range too, ``__i``."""
    if peers:
        return cut(_ranges(frame, keys).withColumn("__p", F.spark_partition_id().cast("long")))
    keys = [*keys, F.col("__t").asc()]  # ties are split in order of the input, so that a frequent key fills many ranges
    rows = _ranges(frame.withColumn("__t", F.monotonically_increasing_id()), keys).sortWithinPartitions(*keys).drop("__t")
    number = F.monotonically_increasing_id()  # the partition's number above, the row's in the lower 33 bits
    return cut(rows.withColumn("__i", number).withColumn("__p", F.shiftright("__i", 33)).withColumn("__i", F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))))


def _windows(frame: DataFrame, calls: list[Running]) -> tuple[DataFrame, DataFrame]:
    """The frame with the columns of calls of one order, and the scratch table below it."""
    order, peers = calls[0].order, calls[0].peers
    keys, columns = _keys(order), frame.columns
    table = _dealt(frame, keys, peers)
    window = Window.partitionBy("__p").orderBy(*(keys if peers else [F.col("__i")]))
    window = (window.rangeBetween if peers else window.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    locals_, totals, before, found = [], [], [], []
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    for i, c in enumerate(calls):
        own, gone, value = f"__l{i}", f"__b{i}", F.expr(c.value)
        if c.function == "row_number":
            locals_.append((F.col("__i") + 1).alias(own))
        elif c.function in ("rank", "dense_rank"):
            locals_.append(getattr(F, c.function)().over(Window.partitionBy("__p").orderBy(*keys)).cast("long").alias(own))
        else:
            locals_.append(getattr(F, c.function)(value).over(window).alias(own))
        each = {"row_number": F.count, "rank": F.count, "dense_rank": lambda _: F.count_distinct(F.struct(*(k for k, *_ in order)))}  # noqa: B023
        totals.append(each.get(c.function, getattr(F, c.function))(F.lit(1) if c.function in each else value).alias(gone))
        before.append({"min": F.min, "max": F.max}.get(c.function, F.sum)(gone).over(earlier).alias(gone))
        x, y = F.col(own), F.col(gone)
        both = {"min": F.least, "max": F.greatest}.get(c.function, lambda x, y: x + y)(x, y)
        found.append(F.coalesce(both, x, y).alias(c.column))
    sums = table.groupBy("__p").agg(*totals).select(F.col("__p").alias("__q"), *before)
    rows = table.select("*", *locals_).join(F.broadcast(sums), F.col("__p") == F.col("__q"))
    return rows.select(*columns, *found), table


def _counted(frame: DataFrame, c: Counted) -> tuple[DataFrame, DataFrame]:
    """Both sides in one order: a running sum of the inner rows, read at the outer ones. Among equal
    keys those that do not count come after."""
    columns = frame.columns
    outer = frame.select("*", F.col(c.outer).alias("__k"), F.lit(1 if c.op in ("<=", ">=") else -1).alias("__o"), F.lit(0).cast("long").alias("__n"))
    inner = c.inner.select(F.col("k").alias("__k"), F.lit(0).alias("__o"), F.col("n").alias("__n"))
    order = (("__k", c.op[0] == ">", True), ("__o", False, True))
    found, table = _windows(outer.unionByName(inner, allowMissingColumns=True), [Running(c.column, "sum", order, "__n", False)])
    return found.where("__o <> 0").select(*columns, c.column), table


def add(frame: DataFrame, steps: list[Running | Counted]) -> DataFrame:
    """The frame with a column for each step; steps of one order share their ranges."""
    groups: dict = {}
    for s in steps:
        groups.setdefault(s if isinstance(s, Counted) else (s.order, s.peers), []).append(s)
    tables: list[DataFrame] = []
    for same in groups.values():
        frame, table = _counted(frame, same[0]) if isinstance(same[0], Counted) else _windows(frame, same)
        discard(*tables)  # the next one is written, and read instead
        tables = [table]
    return frame


def fits(frame: DataFrame, step: Running | Counted) -> bool:
    """Whether a scratch table can hold the frames' columns, and has a folder; and whether the sides of
    a count compare as they sort in one column."""
    try:
        shared_folder(frame.sparkSession)
    except ValueError:
        return False
    frames = [frame]
    if isinstance(step, Counted):
        k, outer = step.inner.schema["k"].dataType, frame.schema[step.outer].dataType
        if k != outer and not (isinstance(k, NumericType) and isinstance(outer, NumericType)):
            return False
        frames.append(step.inner)
    return not any(f.isStreaming or any(re.search(r"(^|[:<,])(void|interval|variant)($|[,>])", c.dataType.simpleString()) for c in f.schema) for f in frames)
