"""Pairs of texts whose shingles are similar: equal parts of sets as candidates, each pair verified by all shingles.

Two sets with a Jaccard similarity of ``t`` or more differ in few shingles, so when both are dealt into a few more parts by
hash, some parts are equal. Each set therefore shows one signature for each of its parts, and sets meet at equal signatures only.
A part holds some shingles: two texts that share a common line or passage, and no more, seldom have an equal part, and
not as many as similar texts must have, so neither frequent shingles nor their counts matter.

Sets of similar size must be dealt into the same number of parts: sizes fall into classes of ratio ``t``, and a set is dealt once for
its own class and once for the next. Small sets show all parts. Then at least as many parts are equal and not empty as a
set has more such parts than shingles to differ by; the few sets without that margin also meet at the
shingles of their prefixes. Large sets show ``PARTS`` parts, each of which is equal with a probability of two fifths or more at the
threshold; that fewer than ``ENOUGH`` are happens to less than one pair in a million there, and to ever fewer above.

Of the signatures that it must share with any partner, a set lays aside all but ``LEAST``, the most frequent ones; what is left still
brings every such pair together that often. So sets that share a common passage seldom meet at all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxweave.llm.common import map_batches, picked, stored
from boxweave.llm.components import components

SEED = 42
#: Parts that a set shows at most for each of its two size classes.
PARTS = 64
#: Equal parts that two large sets have at the threshold, but for less than one pair in a million.
ENOUGH = 7
#: Signatures that a pair has to share among those that are left to it.
LEAST = 2
#: Rows of one signature above which they are compared with several of their own.
CROWD = 10_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int, distinct: bool = True) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with ``distinct`` false the second of a kind is another one.

    Words are runs without white space, A-Z lower-cased; fewer words than a shingle are one; none without words.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(parts), list(accumulate(len(p) + 1 for p in parts))
    last, digest = min(words, len(parts)) - 1, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[last:])), np.uint64)
    if distinct:
        return np.unique(hashes)
    hashes.sort()
    first = np.searchsorted(hashes, hashes)
    return np.unique(hashes + (np.arange(len(hashes)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Sizes:
    """Classes of set sizes: sets of a similarity of ``t`` or more are in one class or in neighbours."""

    def __init__(self, similarity: float):
        self.similarity, self.least = similarity, [1]

    def _grow(self) -> None:
        self.least.append(floor(self.least[-1] / self.similarity + 1e-9) + 1)

    def of(self, n: int) -> int:
        while self.least[-1] <= n:
            self._grow()
        return bisect_right(self.least, n) - 1

    def parts(self, pair: int) -> int:
        """Into how many parts sets of class ``pair`` and the one below are dealt."""
        while len(self.least) < pair + 2:
            self._grow()
        differ = (1 - self.similarity) / self.similarity * (self.least[pair + 1] - 1)
        all_shown = ceil(1.4 * differ) + 2
        return all_shown if all_shown < PARTS else max(PARTS, ceil(0.9 * differ))

    def differing(self, n: int) -> int:
        """Shingles that a set of ``n`` and one similar to it can differ in."""
        return floor(n * (1 - self.similarity) / self.similarity + 1e-9)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def signatures(own: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, int]:
    """Signatures at which a set, given as sorted distinct hashes, meets those similar to it, and how many at least they share."""
    if not len(own):
        return np.zeros(0, np.int64), 1
    out, sure, need = [], True, len(own)
    first, differ = sizes.of(len(own)), sizes.differing(len(own))
    for pair in (first, first + 1):
        n = sizes.parts(pair)
        part = own % np.uint64(n)
        shown = part < PARTS if n > PARTS else slice(None)
        part, values = part[shown], own[shown]
        order = np.argsort(part, kind="stable")
        part, values = part[order], values[order]
        at = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]])
        if len(at):
            sums = np.add.reduceat(_scrambled(values), at)
            out.append(_scrambled(sums + (part[at] + np.uint64(pair << 32)) * _MIX))
        if n < PARTS:
            sure &= len(at) > differ
            need = min(need, max(1, len(at) - differ))
        else:
            need = min(need, max(ENOUGH, len(at) - differ) if n == PARTS else ENOUGH)
    if not sure:
        out.append(_scrambled(own[: len(own) - ceil(sizes.similarity * len(own) - 1e-9) + 1]))
    return np.concatenate(out).view(np.int64), need


def signed(docs: DataFrame, id: str, text: str, words: int, distinct: bool, similarity: float) -> DataFrame:
    """``(id, body, node, size, need, signatures)`` of every row: hashes of the text and of its set, the set's size and signatures."""
    rows = picked(docs, id=id, text=text).withColumn("body", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Sizes(similarity)
        for batch in batches:
            nodes, sizes, needs, shown = [], [], [], [np.zeros(0, np.int64)]
            for t in batch.column(1):
                own = shingle_set(t.as_py(), words, distinct)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                found, need = signatures(own, classes)
                shown.append(found)
                needs.append(need)
            lists = pa.ListArray.from_arrays(np.cumsum([len(s) for s in shown]).astype(np.int32), np.concatenate(shown))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), lists], ["id", "body", "node", "size", "need", "signatures"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, body long, node long, size int, need int, signatures array<long>")


def _crowd(rows: DataFrame) -> DataFrame:
    """``(sig, node, size, need, pivot, pivot_size, again)`` of signatures that two sets or more have; a pivot is the smallest node of its signature.

    Where very many sets meet, each of several shares of them has a pivot of its own; these meet again, in rows of their own.
    """
    one = stored(rows.where("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "need", "signatures")]), "nodes")
    each = one.select(F.explode("signatures").alias("sig"), "node", "size", "need")
    met = stored(each.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "met")
    share = F.when(F.col("n") > CROWD, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CROWD))).otherwise(F.lit(0))
    common = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("sig")))
    left = each.join(met, "sig").withColumn("common", common).where(F.col("common") > F.col("need") - LEAST)
    dealt = stored(left.select("sig", "node", "size", "need", share.cast("int").alias("share"), (F.col("n") > CROWD).alias("large")), "dealt")
    pivot = F.min(F.struct("node", "size", "need")).alias("p")

    def pivoted(members: DataFrame, heads: DataFrame, of: list[str], again: bool) -> DataFrame:
        named = members.join(heads, of)
        return named.select("sig", "node", "size", "need", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"), F.lit(again).alias("again"))

    heads = stored(dealt.groupBy("sig", "share").agg(pivot, F.first("large").alias("large")), "pivots")
    large = heads.where("large").select("sig", "p.node", "p.size", "p.need")
    return pivoted(dealt, heads.select("sig", "share", "p"), ["sig", "share"], False).unionByName(pivoted(large, large.groupBy("sig").agg(pivot), ["sig"], True))


def _sets(nodes: DataFrame, rows: DataFrame, docs: DataFrame, text: str, words: int, distinct: bool) -> DataFrame:
    """``(node, own)``: all shingles of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, t in zip(batch.column(0), batch.column(1)):
                own = shingle_set(t.as_py(), words, distinct).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.ListArray.from_arrays(np.array([0, len(own)], np.int32), own)], ["node", "own"])

    bodies = stored(rows.groupBy("node").agg(F.min("body").alias("body")).join(nodes, "node", "left_semi"), "bodies")
    texts = docs.select(F.xxhash64(docs[text]).alias("body"), docs[text].alias("text"))
    return map_batches(texts.join(bodies, "body").dropDuplicates(["node"]).select("node", "text"), run, "node long, own array<long>")


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` of pairs, by all their shingles."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("sum"))
    return counted.select("a", "b", (F.col("n") / (F.col("sum") - F.col("n"))).alias("similarity"))


def similar_classes(rows: DataFrame, docs: DataFrame, text: str, words: int, distinct: bool, similarity: float) -> DataFrame:
    """``(node, root)`` of the nodes that are linked to a smaller one over pairs at ``similarity`` or more.

    ``rows`` are those of ``signed``. First each node is compared with the pivots of its signatures, which links most copies.
    Then only nodes that meet and are not linked are paired, and of these only such as can be similar by their distances
    to the pivot that both were compared with (one less the similarity is a distance). So a large class of copies is not paired wholesale.
    """

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9

    crowd = stored(_crowd(rows), "crowd")
    sets = stored(_sets(crowd.select("node").distinct(), rows, docs, text, words, distinct), "sets")
    star = crowd.where((F.col("node") != F.col("pivot")) & fits(F.col("size"), F.col("pivot_size"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    judged = stored(_judged(star, sets), "judged")
    near = F.col("similarity") >= similarity - 1e-9
    links = judged.where(near).select("a", "b")
    known = components(links).select(F.col("a").alias("node"), F.col("b").alias("root"))

    off = F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(1 - F.col("similarity"))
    labelled = crowd.where("NOT again").join(known, "node", "left").join(judged.withColumnsRenamed({"a": "pivot", "b": "node"}), ["pivot", "node"], "left")
    labelled = labelled.select("sig", "pivot", "node", "size", "need", F.coalesce("root", "node").alias("label"), off.alias("off"))
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "node").alias("home")).where("low <> high")
    members = stored(labelled.join(mixed.select("sig", "home"), "sig"), "mixed")
    # Of the rows of a signature only those outside the class of its smallest node look for partners; two of them meet from one side.
    x, y = members.where("label <> home").alias("x"), members.alias("y")
    apart = (F.col("x.pivot") != F.col("y.pivot")) | F.coalesce(F.abs(F.col("x.off") - F.col("y.off")) <= 1 - similarity + 1e-9, F.lit(True))
    once = (F.col("y.label") == F.col("y.home")) | (F.col("x.node") < F.col("y.node"))
    met = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.join(y, met & once & apart & fits(F.col("x.size"), F.col("y.size"))).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.greatest("x.need", "y.need").alias("need"))
    # A pair is seen once at each signature it shares, unless its distances rule it out.
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.least(F.first("need"), F.lit(LEAST)).alias("need")).where("n >= need").select("a", "b")
    rest = stored(pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    more = _judged(rest, sets).where(near).select("a", "b")
    return components(links.unionByName(more)).select(F.col("a").alias("node"), F.col("b").alias("root"))
