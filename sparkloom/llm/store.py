"""Lineage cuts, code shipping and internal column names for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, free, shared_dir, ship

__all__ = ["column", "cut", "fence", "free", "release", "released", "shared_dir", "ship", "slices", "unused"]


def column(name: str) -> Column:
    """The column of this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fence(df: DataFrame) -> DataFrame:
    """``df``, behind an unnesting of one-row arrays: what lies below is computed once for each row.
    Neither filters nor projections above are merged into it, where an expression could be copied
    into another's lambda and run for each of its elements."""
    row = F.explode_outer(F.array(F.struct(*(column(c) for c in df.columns)))).alias("row")
    return df.select(row).select("row.*")


def release() -> None:
    """Give what Arrow and numpy no longer use back to the system; Python workers serve many tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run):
    """``run``, a generator over Arrow batches, which gives its memory back at the end of the task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(batch, column: str, max_rows: int = 2000, max_bytes: int = 8 << 20):
    """Cut an Arrow batch into runs of rows whose ``column`` stays near ``max_bytes``.

    One row is never split, so a run may hold a single larger text.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
