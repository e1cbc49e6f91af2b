"""Rows of a key in order, a batch at a time, through a small function in the task.

Spark partitions by key and sorts. ``stream`` sees one Arrow batch after another and
keeps a small state between them, so a long key costs time but no memory.
``whole_groups`` and ``group_tables`` hand over a complete group and are for keys whose size is bounded by
nature, such as the boxes of one frame. Only the columns a step names become numbers in
Python; all others pass as the Arrow arrays they came in, so their values, nulls included, stay what they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from boxweave.session import dealt, reach_workers


def numbers(batch: pa.RecordBatch, name: str, fill: float = 0) -> np.ndarray:
    """A column as numpy, nulls filled."""
    column = batch.column(name)
    return (pc.fill_null(column, fill) if column.null_count else column).to_numpy(zero_copy_only=False)


def with_columns(batch: pa.RecordBatch, names: list[str], **more: np.ndarray | list) -> pa.RecordBatch:
    """The named columns as they are, followed by new ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(v if isinstance(v, pa.Array) else pa.array(v) for v in more.values())], [*names, *more])


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the stretches of equal keys begin in a sorted batch; nulls are equal."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[:1] = True
    for k in keys:
        now, before = batch.column(k)[1:], batch.column(k)[:-1]
        differs = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null()))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _sorted(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    reach_workers(df.sparkSession)
    return dealt(df, *keys).sortWithinPartitions(*[F.col(k) for k in keys], *order)


def stream(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """Whole sorted batches through a function made once per task, for vectorised steps.

    The rows themselves must tell where a key starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return _sorted(df, keys, order).mapInArrow(run, schema)


def stream_pandas(df: DataFrame, keys: list[str], order: list[Column], make: Callable, schema: str | StructType) -> DataFrame:
    """``stream`` for steps that take pandas frames; for rows whose columns are all the step's own."""

    def run(frames):
        step = make()
        for pdf in frames:
            if len(pdf):
                yield step(pdf)

    return _sorted(df, keys, order).mapInPandas(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole groups with the places where groups begin, and the end."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if batch.num_rows else rest
        begins = starts(batch, keys).tolist()
        if not begins:
            continue
        if begins[-1]:
            yield batch.slice(0, begins[-1]), begins
        rest = batch.slice(begins[-1])
    if rest is not None and rest.num_rows:
        yield rest, [0, rest.num_rows]


def whole_groups(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    columns: list[str],
    work: Callable[[dict[str, np.ndarray]], tuple[list[int], dict[str, list]]],
) -> DataFrame:
    """Some rows of each complete group, in the schema of ``df``.

    ``work(columns)`` gets the named columns of a group as numpy arrays; it returns the numbers of the rows
    that stay and new values for some of these columns.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _groups(batches, keys):
            arrays = {c: numbers(batch, c) for c in columns}
            kept, changed = [], {}
            for a, b in zip(edges, edges[1:]):
                own, new = work({c: v[a:b] for c, v in arrays.items()})
                kept += [a + i for i in own]
                for c, v in new.items():
                    changed.setdefault(c, []).extend(v)
            out = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(changed[c], out.schema.field(c).type) if c in changed else out.column(c) for c in names], names)

    return _sorted(df, keys, order).mapInArrow(run, df.schema)


def group_tables(df: DataFrame, keys: list[str], order: list[Column], work: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """New rows for each complete group: ``keys`` and the columns of ``schema``, which ``work(rows)`` returns as lists."""
    own = to_arrow_schema(StructType.fromDDL(schema))
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _groups(batches, keys):
            made: dict[str, list] = {name: [] for name in own.names}
            of = []
            for a, b in zip(edges, edges[1:]):
                new = work(batch.slice(a, b - a))
                for name in made:
                    made[name].extend(new[name])
                of += [a] * len(new[own.names[0]])
            named = batch.select(keys).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*named.columns, *(pa.array(v, f.type) for v, f in zip(made.values(), own))], [*keys, *made])

    return _sorted(df, keys, order).mapInArrow(run, f"{key_types}, {schema}")


def affine_scan(a: np.ndarray, b: np.ndarray, carry: np.ndarray | float) -> np.ndarray:
    """x[i] = a[i] * x[i-1] + b[i] with x[-1] = carry, by repeated doubling.

    A row with a = 0 starts afresh, so many tracks can lie end to end in one call.
    """
    a, b = a.astype(float).copy(), b.astype(float).copy()
    if len(a) == 0:
        return b
    b[0] = a[0] * carry + b[0]
    a[0] = 0.0
    reach = 1
    while reach < len(a) and np.any(a[reach:] != 0.0):
        b[reach:] = a[reach:] * b[:-reach] + b[reach:]
        a[reach:] = a[reach:] * a[:-reach]
        reach *= 2
    return b
