"""Importance resampling towards a target text: hashed features, array-scored weights, a cutoff found by counting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxweave.llm.common import map_batches, picked, stored

#: Bytes of words: digits, letters in lower case (A-Z are lower-cased), everything beyond ASCII. All others separate.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text taken at a time; distinct features a task remembers.
BLOCK, MEMORY = 1 << 20, 1 << 19
#: Each job of the search counts at so many cut points: four halvings at a time.
CUTS = 15
LONGS = (-(1 << 63), (1 << 63) - 1)


class _Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = self[feature] = crc32(feature) % self.buckets
        return found


def feature_buckets(text: bytes, words: int, remembered: _Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, buckets)`` block by block: how many words begin in it, the bucket of each feature that ends in it."""
    line, at, held = text.translate(_LETTERS), 0, []
    while at < len(line):
        end = len(line) if at + BLOCK >= len(line) else line.find(b" ", at + BLOCK)
        end = len(line) if end < 0 else end
        new = line[at:end].split()
        at = end
        runs = [new]
        if words > 1:
            both = held + new
            for n in range(2, words + 1):
                runs.append([b" ".join(both[max(0, i - n + 1) : i + 1]) for i in range(max(len(held), n - 1), len(both))])
            held = both[len(both) - words + 1 :] if len(both) >= words else both
        yield len(new), np.fromiter((remembered[f] for run in runs for f in run), np.int64, sum(map(len, runs)))


def _bytes(text: pa.Scalar) -> bytes:
    value = text.as_py()
    return value.encode("utf-8", "surrogatepass") if value else b""


def bucket_counts(texts: DataFrame, text: str, words: int, buckets: int) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, remembered = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for t in batch.column(0):
                for _, own in feature_buckets(_bytes(t), words, remembered):
                    counts += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return map_batches(picked(texts, text=text), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket on the driver: ``buckets`` numbers, however large the corpus."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: the logarithm of its smoothed share of the target over that of the source, in thousandths, floored."""
    buckets, total, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (total + buckets) / ((s + 1) * (wanted + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(id: object, seed: int) -> int:
    """Gumbel noise of a row, in thousandths, floored, from a hash of seed and id; a null id counts as empty text."""
    h = int(sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, id: str, text: str, words: int, seed: int) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of every row by the array of gains, which each task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Buckets(len(gain))
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, t in enumerate(batch.column(1)):
                for n, own in feature_buckets(_bytes(t), words, remembered):
                    n_words[i] += n
                    n_features[i] += len(own)
                    weight[i] += gain[own].sum()
            luck = np.fromiter((noise(d.as_py(), seed) for d in batch.column(0)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight, weight + luck))], ["id", "n_words", "n_features", "weight", "score"])

    rows = picked(docs, id=id, text=text)
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def nth_smallest(rows: DataFrame, column: str, n: int) -> tuple[int, int]:
    """``(value, below)``: the n-th smallest (from 1) of a long column without nulls, and how many rows are below it.

    Bisection by exact counts: each job counts the rows up to 15 cut points, which halves the interval
    four times. Nothing but these counts leaves the tasks, so ties of any size cost nothing.
    """
    low, high = (int(v) for v in rows.agg(F.min(column), F.max(column)).first())
    below = 0  # rows under low
    while low < high:
        step = max(1, -(-(high - low + 1) // (CUTS + 1)))
        cuts = [c for i in range(1, CUTS + 1) if (c := low + i * step - 1) < high]
        counts = rows.agg(*[F.count_if(F.col(column) <= F.lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        for cut, count in zip([*cuts, high], [*counts, None]):
            if count is None or count >= n:
                high = cut
                break
            low, below = cut + 1, count
    return low, below


def _drawn(scores: DataFrame, wanted: int) -> tuple[Column, Column]:
    """Conditions for the ``wanted`` rows of highest score, ties to smaller ids (null last), and for all other rows.

    Three searches, each among the ties of the one before: the score, the id, the number of the row.
    """
    if wanted <= 0:
        return F.lit(False), F.lit(True)
    able = F.col("able")
    own, ties, left, taken, tied = scores.where(able), F.lit(True), wanted, F.lit(False), able
    for column in ("down", "place", "row"):
        value, below = nth_smallest(own.where(ties), column, left)
        taken = taken | (tied & (F.col(column) < F.lit(value)))
        tied = tied & (F.col(column) == F.lit(value))
        ties = ties & (F.col(column) == F.lit(value))
        left -= below
    taken = taken | tied
    return taken, ~taken


def _ranked(drawn: DataFrame) -> DataFrame:
    """``drawn`` with ``rank``: rows dealt by ranges of their order, numbered within a range, ranges by their sizes."""
    order = ["down", "place", "row"]
    dealt = drawn.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of this id are the row's place in its partition, the rest is the partition.
    at = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted(at.groupBy(part).count().collect())  # one row a partition
    before, offsets = 0, []
    for number, size in sizes:
        offsets.append((number, before))
        before += size
    starts = at.sparkSession.createDataFrame(offsets, "part long, before long")
    placed = at.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    return placed.withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def resampled(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", words: int = 1,
              buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, n_features, weight, score, rank)``; the drawn ones have a rank.

    Features are runs of 1 to ``words`` consecutive words, hashed to ``buckets``. A row's weight adds the gains of its
    features (see ``gains``) in counts over all of ``docs`` against all of ``target``; its score adds Gumbel noise, so that the highest
    scores are a draw without replacement in proportion to the weights. Of the rows with ``least_words`` words or
    more, ``percent`` in a hundred (rounded down) are drawn.

    Null and empty texts have no features and the weight 0. Ids are whole numbers; a null id takes the
    noise of an empty name and comes last among ties. Rows that share score and id are told apart by their
    place in the stored scores, so repeated rows are drawn one by one. An empty table gives an empty one, an empty target
    the weights of an empty text; other columns are ignored.
    """
    kind = docs.schema[id].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"ids are whole numbers here, {id} is {kind.simpleString()}")
    gain = gains(_as_array(bucket_counts(docs, text, words, buckets), buckets), _as_array(bucket_counts(target, target_text, words, buckets), buckets))
    scored = weights(docs, gain, id, text, words, seed)
    place = F.coalesce(F.col("id").cast("long"), F.lit(LONGS[1]))
    scores = stored(scored.select("*", (-F.col("score")).alias("down"), place.alias("place"), F.monotonically_increasing_id().alias("row"), (F.col("n_words") >= least_words).alias("able")), "scores")
    wanted = percent * scores.where("able").count() // 100
    drawn, rest = _drawn(scores, wanted)
    out = scores.where(rest).withColumn("rank", F.lit(None).cast("long"))
    if wanted:
        ranked = _ranked(scores.where(drawn))
        out = out.select(*scores.columns, "rank").unionByName(ranked.select(*scores.columns, "rank"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
