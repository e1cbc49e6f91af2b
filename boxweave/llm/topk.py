"""Exact top-k by inner product: a three-phase uniform threshold over lists of partial scores.

Every vector is cut into ``lists`` slices. A slice's inner product is a partial score, and a query's partial scores in one
slice are one list; a score is the sum of one entry of each list.

1. Gather the head of every list, score these vectors whole; the k-th best is the cutoff.
2. Send each list an equal share of it: a vector below its share in every list is below the cutoff, so the entries
   at or above the share are sufficient. Their known sums, with the least partial score for what is unknown, may raise the cutoff.
3. Fetch the unknown partial scores of vectors that could still reach the cutoff. All scores are then exact.

A list lives in blocks: queries and candidates meet in groups of bounded size, so no side is sent whole to a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxweave.llm.common import stored
from boxweave.session import reach_workers

#: Candidates and queries in a group; the group is what a task holds at a time.
BUCKET, CHUNK = 4096, 1024
#: Entries taken from the head of each list in the first phase.
HEAD = 32
BLOCK = ["bucket", "chunk", "list"]
ENTRIES = "q long, x long, list int, partial long, above long"


def scaled(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, null where the vector or one of its components is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in column.chunks]]).reshape(-1, width)


def _exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices in the smallest type in which all sums of their products are whole numbers without rounding."""
    bound = float(np.abs(q.astype(np.int64)).max(initial=0)) * float(np.abs(x.astype(np.int64)).max(initial=0)) * q.shape[1]
    if bound >= 2.0**63:
        raise ValueError("scores of these vectors exceed 64 bits")
    kind = np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64
    return q.astype(kind), x.astype(kind)


def _entries(q, x, number: int, partial, above) -> pa.Table:
    return pa.table({"q": q, "x": x, "list": np.full(len(q), number, np.int32), "partial": partial.astype(np.int64), "above": above.astype(np.int64)})


def _head(width: int, head: int):
    """Of each query in a block the ``head`` greatest entries and the least one."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        q, x, rows = _matrix(left["part"], width), _matrix(right["part"], width), right["x"].to_numpy()
        if not len(q) or not len(x):
            return _entries(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, np.zeros(0), np.zeros(0))
        q, x = _exact(q, x)
        found = []
        for at in range(0, len(q), 128):
            scores = q[at : at + 128] @ x.T
            n = min(head, len(x))
            top = np.argpartition(scores, len(x) - n, axis=1)[:, len(x) - n :] if n < len(x) else np.tile(np.arange(n), (len(scores), 1))
            take = np.c_[top, scores.argmin(axis=1)]
            found.append((take, np.take_along_axis(scores, take, axis=1)))
        take, scores = (np.concatenate(c) for c in zip(*found))
        asks = np.repeat(left["q"].to_numpy(), take.shape[1])
        return _entries(asks, rows[take.ravel()], key[2].as_py(), scores.ravel(), np.zeros(take.size))

    return run


def _sufficient(width: int):
    """All entries of a block at or above their query's share of the cutoff; without a cutoff, all entries."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        q, x, rows, asks = _matrix(left["part"], width), _matrix(right["part"], width), right["x"].to_numpy(), left["q"].to_numpy()
        q, x = _exact(q, x)
        least = left["low"].to_numpy()
        share = left["share"].to_numpy(zero_copy_only=False) if left["share"].null_count == 0 else left["share"].fill_null(-(1 << 62)).to_numpy()
        found = [np.zeros((0, 3), np.int64)]
        for at in range(0, len(q) if len(x) else 0, 128):
            scores = q[at : at + 128] @ x.T
            i, j = np.nonzero(scores >= share[at : at + 128, None].astype(np.float64 if scores.dtype != np.int64 else np.int64))
            other = asks[at + i] != rows[j]
            i, j = i[other], j[other]
            found.append(np.c_[at + i, j, scores[i, j].astype(np.int64)])
        i, j, partial = np.concatenate(found).T
        return _entries(asks[i], rows[j], key[2].as_py(), partial, partial - least[i])

    return run


def _asked(width: int):
    """The entries that are asked for: rows of the left side with ``x`` name a query and a candidate of the block."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, owners = left.filter(left["x"].is_valid()), left.filter(left["x"].is_null())
        q, x = _exact(_matrix(owners["part"], width), _matrix(right["part"], width))
        asks, rows = wanted["q"].to_numpy(), wanted["x"].to_numpy()

        def place(names: np.ndarray, of: np.ndarray) -> np.ndarray:
            order = np.argsort(names)
            return order[np.searchsorted(names, of, sorter=order)]

        i, j = (place(owners["q"].to_numpy(), asks), place(right["x"].to_numpy(), rows)) if len(asks) else (np.zeros(0, np.int64),) * 2
        partial = np.concatenate([np.zeros(0), *[(q[i[a : a + 65_536]] * x[j[a : a + 65_536]]).sum(axis=1) for a in range(0, len(i), 65_536)]])
        return _entries(asks, rows, key[2].as_py(), partial, np.zeros(len(asks)))

    return run


class _Blocks:
    """Queries and candidates cut into lists and dealt to blocks."""

    def __init__(self, rows: DataFrame, candidates: DataFrame, lists: int):
        n, longest = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
        asks = rows.where("asks").count()
        self.lists, self.width = lists, max(1, -(-(longest or 0) // lists))
        self.buckets, self.chunks = max(1, math.ceil(n / BUCKET)), max(1, math.ceil(asks / CHUNK))
        reach_workers(rows.sparkSession)
        self.queries = self._parts(rows.where("asks"), "q").withColumn("chunk", self.chunk("q"))
        each = F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk")
        self.candidates = self._parts(candidates, "x").select("*", self.bucket("x").alias("bucket"), each).select(*BLOCK, "x", "part")

    def bucket(self, x: str) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(self.buckets)).cast("int")

    def chunk(self, q: str) -> Column:
        return F.pmod(F.xxhash64(q), F.lit(self.chunks)).cast("int")

    def _parts(self, rows: DataFrame, name: str) -> DataFrame:
        def part(number: int) -> Column:
            own = F.slice("v", number * self.width + 1, self.width)
            return F.struct(F.lit(number).alias("list"), F.concat(own, F.array_repeat(F.lit(0), F.lit(self.width) - F.size(own))).alias("part"))

        return rows.select(F.col("row").alias(name), F.inline(F.array(*[part(i) for i in range(self.lists)])))

    def met(self, queries: DataFrame, fn, schema: str = ENTRIES) -> DataFrame:
        """``fn`` on every block: its queries, sent to each bucket, and its candidates."""
        return queries.groupBy(*BLOCK).cogroup(self.candidates.groupBy(*BLOCK)).applyInArrow(fn, schema)

    def to_all(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))))


def _nth(scores: DataFrame, n: int, score: str, name: str) -> DataFrame:
    """``(q, name)``: the n-th highest score of each query that has so many."""
    order = Window.partitionBy("q").orderBy(F.desc(score))
    best = scores.select("q", score, F.row_number().over(order).alias("n")).where(F.col("n") <= n)
    return best.where(F.col("n") == n).select("q", F.col(score).alias(name))


def _whole(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(q, x, score)``: pairs scored by their whole vectors; the shorter one ends in zeros."""
    a, b = rows.select(F.col("row").alias("q"), F.col("v").alias("a")), rows.select(F.col("row").alias("x"), F.col("v").alias("b"))
    products = F.zip_with("a", "b", lambda m, n: F.coalesce(m, F.lit(0)).cast("long") * F.coalesce(n, F.lit(0)))
    return pairs.join(b, "x").join(a, "q").select("q", "x", F.aggregate(products, F.lit(0).cast("long"), lambda s, p: s + p).alias("score"))


def top_products(vectors: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, lists: int = 2, head: int = HEAD) -> DataFrame:
    """The ``k`` rows of highest inner product with each row for which ``asks`` holds: ``(query_id, rank, vec_id, score)``.

    ``asks`` is a condition on the columns of ``vectors``. Components become ``floor(scale * x)``, which must fit 32 bits, and scores are whole
    numbers; ties go to the smaller id. Candidates are all rows but the query's own; with fewer than ``k`` all are returned.
    Rows without id, vectors that are null or hold a null or a value that is not finite take no part. Of vectors
    of different length the shorter ends in zeros. Repeated rows are rows of their own: each is a candidate of the others and, if it
    asks, has ranks of its own. Other columns are ignored; an empty table gives an empty one.

    Of equal vectors only the ``k + 1`` with the smallest ids can be among anyone's best, so only these are candidates.
    """
    named = vectors.select(vectors[id].alias("id"), vectors[vector].alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where("id IS NOT NULL").withColumn("v", scaled("v", scale))
    rows = stored(named.where("v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")
    copies = Window.partitionBy("v").orderBy("id", "row")
    candidates = stored(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    blocks = _Blocks(rows, candidates, lists)

    heads = stored(blocks.met(blocks.to_all(blocks.queries).select(*BLOCK, "q", "part"), _head(blocks.width, max(head, k + 1))), "heads")
    lows = heads.groupBy("q", "list").agg(F.min("partial").alias("low"))
    order = Window.partitionBy("q", "list").orderBy(F.desc("partial"), "x")
    first = heads.select("q", "x", F.row_number().over(order).alias("n")).where(F.col("n") <= max(head, k + 1)).where("q <> x").select("q", "x").distinct()
    cutoffs = stored(_nth(_whole(first, rows), k, "score", "cutoff"), "cutoffs")

    even = F.expr(f"CASE WHEN cutoff > 0 THEN (cutoff + {lists - 1}) div {lists} ELSE cutoff div {lists} END")
    told = blocks.queries.join(lows, ["q", "list"]).join(cutoffs, "q", "left").withColumn("share", even)
    entries = stored(blocks.met(blocks.to_all(told).select(*BLOCK, "q", "part", "low", "share"), _sufficient(blocks.width)), "entries")

    known = entries.groupBy("q", "x").agg(F.sum("partial").alias("known"), F.sum("above").alias("above"), F.count("*").alias("n"), F.bit_or(F.expr("1L << list")).alias("have"))
    total = lows.groupBy("q").agg(F.sum("low").alias("low"))
    bounds = known.join(total, "q").join(cutoffs, "q", "left").withColumn("share", even)
    bounds = stored(bounds.withColumn("least", F.col("low") + F.col("above")).withColumn("most", F.col("known") + (lists - F.col("n")) * (F.col("share") - 1)), "bounds")
    raised = _nth(bounds, k, "least", "raised")
    cutoff = F.greatest("cutoff", "raised")
    open_ = stored(bounds.join(raised, "q", "left").where((F.col("n") == lists) | F.col("share").isNull() | (F.col("most") >= cutoff)).select("q", "x", "known", "n", "have", cutoff.alias("cutoff")), "open")

    missing = open_.where(F.col("n") < lists).select("q", "x", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), "have").where("(have & (1L << list)) = 0")
    wanted = missing.select(blocks.bucket("x").alias("bucket"), blocks.chunk("q").alias("chunk"), "list", "q", F.lit(None).cast("array<int>").alias("part"), "x")
    owners = blocks.to_all(blocks.queries).select(*BLOCK, "q", "part", F.lit(None).cast("long").alias("x"))
    fetched = blocks.met(owners.unionByName(wanted), _asked(blocks.width)).select("q", "x", "partial")
    scores = open_.select("q", "x", F.col("known").alias("partial"), "cutoff").unionByName(fetched.withColumn("cutoff", F.lit(None).cast("long")))
    scores = scores.groupBy("q", "x").agg(F.sum("partial").alias("score"), F.max("cutoff").alias("cutoff")).where("cutoff IS NULL OR score >= cutoff")

    ids = rows.select("row", "id")
    ranked = scores.join(ids.select(F.col("row").alias("x"), F.col("id").alias("vec_id")), "x")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "x")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(ids.select(F.col("row").alias("q"), F.col("id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
