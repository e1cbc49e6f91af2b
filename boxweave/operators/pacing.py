"""Spacing of rows in time without walking a whole key in one task.

Which row is kept next depends on nothing but the time ``due`` before which none may leave, and on
whether one waits. A key is cut into blocks of time. Each block is played for every state it
could be entered in (``due`` lies within one gap of its first row), all at once, which gives
a table from entry to exit; these are composed (``compose``), and the blocks are played again, in
parallel, each from its own entry. Only keys, time and a row number take part; the rows themselves
stay in Spark and those that were kept are joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxweave.operators.compose import entry_states
from boxweave.operators.scan import Step, ordered_scan, time_block
from boxweave.operators.sequential import group_tables, numbers
from boxweave.session import checkpointed

HOUR_MS = 3_600_000
#: Entry times relative to the first row at which the outcome changes, and the exit of each.
TABLE = "first bigint, entries array<bigint>, due array<bigint>, waits array<boolean>"
STATE = "due bigint, waits boolean"


def play(times: np.ndarray, due: np.ndarray, gap: int, newest: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Exit ``due``, whether a row waits at the end, and the rows kept at each step (-1: none), for each entry ``due``.

    With ``newest`` a row that comes too early waits, a later one replaces it, and it leaves at ``due``.
    Otherwise rows that come too early are dropped. The row that waits at the end is not among those kept.
    """
    due, at, n = due.astype(np.int64).copy(), np.zeros(len(due), np.int64), len(times)
    waits, steps = np.zeros(len(due), bool), []
    live = np.ones(len(due), bool)
    while live.any():
        here = np.minimum(at, n - 1)
        early = live & (times[here] < due)
        if newest:
            # The last row up to ``due`` leaves then, unless later rows could still replace it.
            last = np.searchsorted(times, due, "right") - 1
            stays = early & (last == n - 1)
            waits |= stays
            kept = np.where(early, last, here)
            due = np.where(stays, due, np.where(early, due + gap, times[here] + gap))
            kept = np.where(stays, -1, kept)
        else:
            kept = np.where(early, np.searchsorted(times, due), here)
            stays = early & (kept == n)
            due = np.where(stays, due, times[np.minimum(kept, n - 1)] + gap)
            kept = np.where(stays, -1, kept)
        kept, due = np.where(live, kept, -1), due if live.all() else np.where(live, due, played)
        steps.append(kept)
        at = np.where(kept >= 0, kept + 1, at)
        live = live & ~stays & (at < n)
        played = due
    return due, waits, steps


def _entry(first: int, due, waits, gap: int):
    """``due`` as a block meets it that begins at ``first``: a row that waited may have left before."""
    return np.maximum(np.where(waits & (due < first), due + gap, due), first)


def _through(table: dict, due: np.ndarray, waits: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(np.asarray(table["entries"], np.int64), _entry(table["first"], due, waits, gap) - table["first"])
    at = np.minimum(at, len(table["entries"]) - 1)
    return np.asarray(table["due"], np.int64)[at], np.asarray(table["waits"], bool)[at]


def paced(df: DataFrame, keys: list[str], time: str, gap: int, newest: bool, block: int = HOUR_MS) -> DataFrame:
    """Rows at least ``gap`` apart: the first that comes when the time is over, or the newest that waits by then.

    Times are whole numbers; rows without time or with a null key are left out. A block's rows are bounded by the
    rate of a key. Rows of equal time stay in the order in which they are stored. All columns of the
    rows that are kept come back as they were.
    """
    on = [*keys, "__block"]
    rows = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
    narrow = rows.dropna(subset=[*keys, time]).select(*keys, F.col(time).cast("long").alias("__time"), "__row", time_block(time, block).alias("__block"))
    order = [F.col("__time"), F.col("__row")]

    def table(batch: pa.RecordBatch) -> dict[str, list]:
        times = numbers(batch, "__time")
        entries = np.arange(gap + 1) if newest else np.unique(np.r_[times[times <= times[0] + gap] - times[0], gap])
        due, waits, _ = play(times, times[0] + entries, gap, newest)
        return {"first": [int(times[0])], "entries": [entries.tolist()], "due": [due.tolist()], "waits": [waits.tolist()]}

    def join(a: dict, b: dict) -> dict:
        due, waits = _through(b, np.asarray(a["due"], np.int64), np.asarray(a["waits"], bool), gap)
        return {"first": a["first"], "entries": a["entries"], "due": due.tolist(), "waits": waits.tolist()}

    def enter(own: dict, state: dict) -> dict:
        before = own["first"] if state["due"] is None else state["due"]
        due, waits = _through(own, np.array([before]), np.array([bool(state["waits"])]), gap)
        return {"due": int(due[0]), "waits": bool(waits[0])}

    tables = checkpointed(group_tables(narrow, on, order, table, TABLE))
    entered = entry_states(tables, keys, TABLE, STATE, join, enter)
    firsts = ordered_scan(tables.select(*on, "first"), keys, [time_block("__block", 4096)], [F.col("__block")], [Step("__then", "lag", F.col("first"))], reverse=True)
    ready = narrow.join(entered, on).join(firsts.select(*on, "__then"), on)

    def replay(batch: pa.RecordBatch) -> dict[str, list]:
        times, places = numbers(batch, "__time"), batch.column("__row")
        before, waited, then = (batch.column(c)[0].as_py() for c in ("due", "waits", "__then"))
        entry = times[:1] if before is None else _entry(int(times[0]), np.array([before]), np.array([bool(waited)]), gap)
        due, waits, steps = play(times, entry, gap, newest)
        kept = [int(s[0]) for s in steps if s[0] >= 0]
        # The row that waits leaves unless one comes before its time; then that one waits in its place.
        if waits[0] and (then is None or due[0] < then):
            kept.append(len(times) - 1)
        return {"__row": places.take(pa.array(kept, pa.int64())).to_pylist()}

    kept = group_tables(ready, on, order, replay, "__row bigint").select(F.col("__row").alias("__kept"))
    return rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi").select(*df.columns)
