"""Expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters and digits, in lower case.
WORD = r"[\p{L}\p{N}]+"
BLOCK = 64


def row_key(id: str, text: str) -> Column:
    """128 bits of a row's id and text; equal for equal rows only."""
    return F.concat(F.hex(F.xxhash64(id, text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text, id)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a lambda computes again what it holds from outside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """Running sums of an array of longs, by blocks, so that long arrays stay far from quadratic cost."""

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

    def before(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: total(F.slice(sums, 1, b)))

    def inside(blocks: Column, starts: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda x, b: let(F.get(starts, b), lambda p: F.transform(x, lambda _, i: p + total(F.slice(x, 1, i + 1))))))

    def summed(blocks: Column) -> Column:
        return let(F.transform(blocks, total), lambda sums: let(before(sums), lambda starts: inside(blocks, starts)))

    found = let(values, lambda v: let(cut(v), summed))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<bigint>"))


def lengths(values: Column) -> Column:
    return F.transform(values, lambda x: F.length(x).cast("long"))
