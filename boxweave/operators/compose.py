"""Ordered steps whose state is small, without one task per key: blocks as maps, composed in a tree.

A key is cut into blocks along its order. A block is reduced to a table that maps the state it is entered
in to the state it is left in. Tables of neighbours are joined, ``FAN`` at a time, until each key has one;
then the state is handed down again, from a joined table to those it was made of. No task sees more than
``FAN`` tables of a key, whatever its length, and the blocks are played in parallel, each from its own entry.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxweave.operators.sequential import group_tables
from boxweave.session import checkpointed

FAN = 64

Row = dict


def _lists(columns: list[str], rows: list[Row]) -> dict[str, list]:
    return {c: [r[c] for r in rows] for c in columns}


def entry_states(tables: DataFrame, keys: list[str], table: str, state: str, join: Callable[[Row, Row], Row], enter: Callable[[Row, Row], Row], fan: int = FAN) -> DataFrame:
    """``(keys, __block, state...)``: the state in which each block is entered, all null for a key's first.

    ``tables`` has the keys, ``__block`` and the columns of the schema ``table``. ``join(a, b)`` is the table of
    a block followed by its neighbour, ``enter(table, state)`` the state that a block is left in.
    """
    columns, states = ([c.split()[0] for c in schema.split(", ")] for schema in (table, state))
    levels = [checkpointed(tables.select(*keys, "__block", *columns))]

    def joined(batch: pa.RecordBatch) -> dict[str, list]:
        first, *rest = batch.select(columns).to_pylist()
        for other in rest:
            first = join(first, other)
        return _lists(columns, [first])

    def handed(batch: pa.RecordBatch) -> dict[str, list]:
        rows, out = batch.to_pylist(), []
        now = {s: rows[0][f"__{s}"] for s in states}
        for row in rows:
            out.append({"__block": row["__block"], **now})
            now = enter({c: row[c] for c in columns}, now)
        return _lists(["__block", *states], out)

    def several(level: DataFrame) -> bool:
        spans = level.groupBy(*keys).agg(F.min("__block").alias("a"), F.max("__block").alias("b"))
        return not spans.where("a <> b").isEmpty()

    parent = F.floor(F.col("__block") / fan).cast("long").alias("__parent")
    while several(levels[-1]):
        up = group_tables(levels[-1].select("*", parent), [*keys, "__parent"], [F.col("__block")], joined, table)
        levels.append(checkpointed(up.withColumnRenamed("__parent", "__block")))
    kinds = [s.split(" ", 1)[1] for s in state.split(", ")]
    entered = levels[-1].select(*keys, "__block", *[F.lit(None).cast(k).alias(s) for s, k in zip(states, kinds)])
    for level in levels[-2::-1]:
        above = entered.select(*keys, F.col("__block").alias("__parent"), *[F.col(s).alias(f"__{s}") for s in states])
        below = level.select("*", parent).join(above, [*keys, "__parent"])
        entered = group_tables(below, [*keys, "__parent"], [F.col("__block")], handed, f"__block bigint, {state}").drop("__parent")
    return entered
