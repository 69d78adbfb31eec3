"""What the operators of this subpackage share: table access, joins by size, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import cut, discard, shared_folder, stored_bytes  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes in memory that a broadcast table takes, for each byte of it on disk, about.
EXPANSION = 5
#: Bytes in memory up to which a table is broadcast.
BROADCAST = 16 << 20


def small(df: DataFrame, limit_bytes: int = BROADCAST) -> bool:
    """Whether a table that ``cut`` wrote is small enough to be broadcast."""
    return EXPANSION * stored_bytes(df) <= limit_bytes


def joined(left: DataFrame, right: DataFrame, on, how: str, limit_bytes: int = BROADCAST) -> DataFrame:
    """Join that broadcasts ``right`` behind a check of its size, and shuffles beyond it."""
    return left.join(F.broadcast(right) if small(right, limit_bytes) else right, on, how)


def map_batches(
    df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, limit_bytes: int = 2 << 20, at_end: Callable[[], None] | None = None
) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns by name. A batch comes in slices of
    about ``limit_bytes``, one row at least; ``at_end`` runs when a task ends."""
    from pyspark.sql.types import StructType

    arrow = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                # a slice at a time: an Arrow batch of very long texts may be large
                for part in in_chunks(batch, limit_bytes):
                    columns = rows(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
                    )
        finally:
            if at_end:
                at_end()
            give_back()

    set_batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of a batch sent to Python, where the session says nothing else than Spark's default: texts of
#: some kilobytes make megabytes of a thousand rows, on both sides of the pipe.
BATCH_ROWS = 1000


def set_batch_rows(spark: SparkSession) -> None:
    """Once a session; it is never set back, so that queries side by side do not disturb each other."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Returns a worker's freed memory to the system, as workers wait for their next task beside
    those that work."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def in_chunks(batch: pa.RecordBatch, limit_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings and binaries hold about ``limit_bytes`` at most (one row at
    least)."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.nbytes <= limit_bytes:
        yield batch
        return
    sizes = np.full(batch.num_rows, 16)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > limit_bytes and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


class Recent(dict):
    """A cache bounded in bytes: ``make(key)`` fills what is missing. When entries of about
    ``limit_bytes`` are there, they become the old generation, from which entries in use are taken
    over again; both together hold twice the limit at most, but for an entry being added. ``cost``
    gives a value's bytes; keys of over 256 bytes are not kept."""

    #: What a dict's slot and the objects' headers take, about.
    ENTRY = 180

    def __init__(self, make: Callable, limit_bytes: int, cost: Callable = lambda value: 0):
        super().__init__()
        self.make, self.limit, self.cost, self.held, self.old = make, limit_bytes, cost, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > 256:
            return value
        if self.held >= self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += self.ENTRY + len(key) + self.cost(value)
        self[key] = value
        return value

    def drop(self) -> None:
        """Empties it: a worker that waits for its next task should hold nothing."""
        self.clear()
        self.old, self.held = {}, 0
