"""Ordered windows that keep working when one key holds most of the rows.

``Window.partitionBy(key).orderBy(t)`` sends a whole key to one task. Here the key
is cut into blocks along the order; the window runs per (key, block), each block is
reduced to one summary row, and what a block needs from its predecessors is found
on the summaries and joined back. Results equal the plain window. Blocks may nest:
with ``blocks=[a, b]`` the summaries themselves are scanned block-wise.

The input is read once for the rows and once, narrowly, for the summaries (twice with
two block levels). Scans that build on each other multiply this, so put what they need
into one scan, and write an input that is costly to compute first (``checkpointed``).

All ``order`` columns ascend and must not be null; each block column must be a
non-decreasing function of the order, within the blocks before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_START = Window.unboundedPreceding

# Column of a row by name.
Field = Callable[[str], Column]


@dataclass(frozen=True)
class Step:
    """One output of a scan.

    kind: ``sum``, ``count``, ``max``, ``min`` (running), ``last`` (last value that is not
    null), ``lag`` (previous row). ``before`` leaves the current row out.
    """

    out: str
    kind: str
    value: Column | None = None
    before: bool = False


def _names(count: int, prefix: str) -> list[str]:
    return [f"__{prefix}{i}" for i in range(count)]


def _fold(step: Step, local: Column, carry: Column) -> Column:
    if step.kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if step.kind in ("last", "lag"):
        return F.coalesce(local, carry)
    return F.greatest(local, carry) if step.kind == "max" else F.least(local, carry)


def _running(step: Step, value: Column, window, exclusive: bool) -> Column:
    frame = window.rowsBetween(_START, -1 if exclusive or step.before else Window.currentRow)
    if step.kind in ("sum", "count"):
        return F.sum(value).over(frame)
    if step.kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    if step.kind == "lag":
        return F.lag(value).over(window)
    return (F.max if step.kind == "max" else F.min)(value).over(frame)


def _reduced(step: Step, value: Column, order: Column, reverse: bool) -> Column:
    if step.kind in ("sum", "count"):
        return F.sum(value)
    pick = F.min_by if reverse else F.max_by
    if step.kind == "last":
        return pick(value, F.when(value.isNotNull(), order))
    if step.kind == "lag":
        return pick(value, order)
    return (F.max if step.kind == "max" else F.min)(value)


def _scan(df, keys, blocks, order, steps, reverse, exclusive):
    """``steps`` name value columns that already exist as ``step.out``."""
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    window = Window.partitionBy(*keys, *blocks).orderBy(*[direction(c) for c in order])
    kept = [c for c in df.columns if c not in {s.out for s in steps}]
    local = df.select(*kept, *[_running(s, F.col(s.out), window, exclusive).alias(s.out) for s in steps])
    if not blocks:
        return local
    order_key = F.struct(*order)
    summary = df.groupBy(*keys, *blocks).agg(
        *[_reduced(s, F.col(s.out), order_key, reverse).alias(s.out) for s in steps]
    )
    carry = _scan(summary, keys, blocks[:-1], [blocks[-1]], steps, reverse, True)
    carry = carry.select(*keys, *blocks, *[F.col(s.out).alias(f"__carry_{s.out}") for s in steps])
    joined = local.join(carry, [*keys, *blocks], "left")
    return joined.select(*kept, *[_fold(s, F.col(s.out), F.col(f"__carry_{s.out}")).alias(s.out) for s in steps])


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    blocks: list[Column],
    order: list[Column],
    steps: list[Step],
    reverse: bool = False,
) -> DataFrame:
    """Add one column per step, computed along ``order`` within ``keys``.

    ``reverse`` walks the order from its end (suffix windows). ``lag`` and ``last``
    accept struct values.
    """
    block_names, order_names = _names(len(blocks), "b"), _names(len(order), "o")
    base = df.select(
        "*",
        *[c.alias(n) for c, n in zip(blocks, block_names)],
        *[c.alias(n) for c, n in zip(order, order_names)],
        *[(F.lit(1).cast("long") if s.kind == "count" and s.value is None else s.value).alias(s.out) for s in steps],
    )
    scanned = _scan(base, keys, block_names, order_names, steps, reverse, False)
    return scanned.select(*df.columns, *[s.out for s in steps])


def time_block(column: str | Column, width: int) -> Column:
    """Order-preserving block of an integer time or id column."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(width)).cast("long")


def value_block(column: str | Column, per_octave: int = 1024) -> Column:
    """Order-preserving block of any double: finer near zero, coarser far away."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(F.signum(c) * F.log2(1 + F.abs(c)) * per_octave).cast("long")


def chains(
    df: DataFrame,
    keys: list[str],
    blocks: list[Column],
    order: list[Column],
    remember: list[str],
    breaks: Callable[[Field, Field], Column],
    since: Column,
    outs: dict[str, str],
) -> DataFrame:
    """Chains of rows, each broken where ``breaks(previous, current)`` holds.

    The first row of a key always starts a chain. outs: output name to ``since`` (value of
    the ``since`` expression at the chain's first row), ``count`` (chains begun so far) or
    ``starts`` (the row starts a chain). ``remember`` names the columns ``breaks`` reads.

    A block decides all its rows but the first, so one summary (first row, last row, what
    happened between) settles the rest: the input is read twice, not four times as with
    a lag followed by a running value.
    """
    block_names, order_names = _names(len(blocks), "b"), _names(len(order), "o")
    base = df.select(
        "*", *[c.alias(n) for c, n in zip(blocks, block_names)], *[c.alias(n) for c, n in zip(order, order_names)], since.alias("__at")
    )
    window = Window.partitionBy(*keys, *block_names).orderBy(*order_names)
    upto = window.rowsBetween(_START, Window.currentRow)
    seen = base.withColumn("__prev", F.lag(F.struct(*remember)).over(window))
    broke = F.coalesce(breaks(lambda c: F.col(f"__prev.{c}"), F.col), F.lit(False))
    local = seen.withColumn("__broke", F.when(F.col("__prev").isNotNull(), broke)).drop("__prev")
    began = F.when(F.col("__broke"), F.col("__at"))
    rank = F.struct(*order_names)
    summary = local.groupBy(*keys, *block_names).agg(
        F.min_by(F.struct(*remember), rank).alias("__first"),
        F.min_by("__at", rank).alias("__first_at"),
        F.max_by(F.struct(*remember), rank).alias("__tail"),
        F.max_by(began, F.when(F.col("__broke"), rank)).alias("__since_in"),
        F.count_if("__broke").alias("__count_in"),
    )
    lagged = _scan(summary.withColumn("__before", F.col("__tail")), keys, block_names[:-1], [block_names[-1]], [Step("__before", "lag")], False, True)
    joint = F.coalesce(breaks(lambda c: F.col(f"__before.{c}"), lambda c: F.col(f"__first.{c}")), F.lit(False))
    opened = lagged.withColumn("__opens", F.col("__before").isNull() | joint)
    totals = opened.withColumns(
        {
            "__carry_at": F.coalesce("__since_in", F.when(F.col("__opens"), F.col("__first_at"))),
            "__carry_n": F.col("__count_in") + F.col("__opens").cast("long"),
        }
    )
    carry = _scan(totals, keys, block_names[:-1], [block_names[-1]], [Step("__carry_at", "last"), Step("__carry_n", "sum")], False, True)
    carry = carry.select(*keys, *block_names, "__opens", "__first_at", "__carry_at", "__carry_n")
    ran = local.withColumns({"__since_in": F.last(began, ignorenulls=True).over(upto), "__count_in": F.sum(F.col("__broke").cast("long")).over(upto)})
    joined = ran.join(carry, [*keys, *block_names], "left")
    values = {
        "since": F.coalesce("__since_in", F.when(F.col("__opens"), F.col("__first_at")), "__carry_at"),
        "count": F.coalesce("__count_in", F.lit(0)) + F.col("__opens").cast("long") + F.coalesce("__carry_n", F.lit(0)),
        "starts": F.coalesce("__broke", "__opens"),
    }
    return joined.select(*df.columns, *[values[kind].alias(name) for name, kind in outs.items()])
