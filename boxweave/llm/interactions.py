"""How text filters interact: what each removes after, or besides, the others, kept up to date over a stream of files.

Four filters look at a row alone, one (exact copies) at all rows. Each row has a mask of the filters it
fails, and all results follow from the number of rows per part and mask. Files come as micro-batches. For every text
the state holds the smallest id so far; where a smaller one arrives, the row that held it becomes a copy: its earlier
mask is retracted from the counters and the new one counted. So the counters are right after every
micro-batch, whatever the order of the files, and no text is compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxweave.llm.common import map_batches, picked, run_dir
from boxweave.session import keep_state, reach_workers

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Texts that a group of the state is meant to hold; the state moves in groups, as a call for each text would take most of the time.
GROUP = 256
NAME = 32
STATE = "names binary, ids array<long>, at array<int>, part array<string>, mask array<int>, good array<boolean>, toxic array<boolean>, n array<long>"
DELTAS = "part string, mask int, good boolean, toxic boolean, n long"


def own_mask(text: str) -> int:
    """Filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    mask = A if len(words) < 100 else 0
    mask |= B if 100 * len(set(words)) < 80 * len(words) else 0
    mask |= C if 100 * (len(raw) - len(raw.translate(None, UPPER))) > 10 * len(text) else 0
    return mask | (D if len(raw) != len(raw.translate(None, MARKS)) else 0)


def masked(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(name, id, part, mask, n)``: ``n`` equal rows, ``name`` a SHA-256 of the text.

    Rows of a batch are combined here, before any shuffle: equal rows count once, and a row that has a smaller
    id of its text beside it is a copy for certain; its name is null, as its mask is final.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[tuple, int] = {}
            masks: dict[bytes, int] = {}
            least: dict[bytes, int] = {}
            for i, t, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                value = t.as_py() or ""
                name = sha256(value.encode("utf-8", "surrogatepass")).digest()
                if name not in masks:
                    masks[name] = own_mask(value)
                if i is not None:
                    least[name] = min(i, least.get(name, i))
                row = (name, i, p or "")
                count[row] = count.get(row, 0) + 1
            names, ids, parts, found = [], [], [], []
            for name, i, p in count:
                copy = i is not None and i > least[name]
                names.append(None if copy or i is None else name)
                ids.append(i)
                parts.append(p)
                found.append(masks[name] | (E if copy else 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(found, pa.int32()), pa.array(list(count.values()), pa.int64())],
                ["name", "id", "part", "mask", "n"],
            )

    rows = picked(docs, id=id, text=text, part=part)
    return map_batches(rows.select(F.col("id").cast("long").alias("id"), "text", F.col("part").cast("string").alias("part")), run, "name binary, id long, part string, mask int, n long")


def flagged(rows: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` of their labels, false without one. Of several labels of an id any counts."""
    own = picked(labels, id=id, quality="quality", toxic="toxic").where("id IS NOT NULL")
    own = own.groupBy(F.col("id").alias("of")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without id never meet a label; they are dealt by a salt instead of gathering in one task.
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("part", "mask", F.rand(7)), F.lit(1024)) + 1).otherwise(0)
    joined = rows.withColumn("salt", salt).join(own.withColumn("none", F.lit(0).cast("long")), (F.col("id") == F.col("of")) & (F.col("salt") == F.col("none")), "left")
    return joined.select("name", "id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def least_ids(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One group of texts: takes arrived rows, keeps the smallest id of every text, yields changes to the counters."""
    changes: dict[tuple, int] = {}

    def count(row: tuple, copy: bool, n: int) -> None:
        part, mask, good, toxic = row
        at = (part, mask | E if copy else mask, good, toxic)
        changes[at] = changes.get(at, 0) + n

    arrived: dict[bytes, dict[int, dict[tuple, int]]] = {}
    for pdf in frames:
        for name, i, *row, n in zip(*(pdf[c].tolist() for c in ("name", "id", "part", "mask", "good", "toxic", "n"))):
            if name is None:  # settled before
                count(tuple(row), False, n)
                continue
            own = arrived.setdefault(bytes(name), {}).setdefault(int(i), {})
            own[tuple(row)] = own.get(tuple(row), 0) + n
    held = _unpacked(state.get) if state.exists else {}
    for name, by_id in arrived.items():
        first, (before, rows) = min(by_id), held.get(name, (None, {}))
        least = first if before is None else min(first, before)
        for i, own in by_id.items():
            for row, n in own.items():
                count(row, i > least, n)
        if before is not None and first > before:
            continue
        now = dict(by_id[first])
        for row, n in rows.items():
            if first < before:  # what was counted as the first of its text is a copy now
                count(row, False, -n)
                count(row, True, n)
            else:
                now[row] = now.get(row, 0) + n
        held[name] = (first, now)
    if arrived:
        state.update(_packed(held))
    left = [(*at, n) for at, n in changes.items() if n]
    if left:
        yield pd.DataFrame(left, columns=["part", "mask", "good", "toxic", "n"])


def _packed(held: dict[bytes, tuple[int, dict[tuple, int]]]) -> tuple:
    """A group's texts as ``STATE``: names side by side, ids, and the rows that have the id, each with the place of its text."""
    rows = [(at, *row, n) for at, (_, own) in enumerate(held.values()) for row, n in own.items()]
    return (b"".join(held), [i for i, _ in held.values()], *(list(c) for c in zip(*rows)))


def _unpacked(state: tuple) -> dict[bytes, tuple[int, dict[tuple, int]]]:
    names, ids, *columns = state
    held = [(bytes(names[NAME * at : NAME * at + NAME]), (i, {})) for at, i in enumerate(ids)]
    for at, *row, n in zip(*columns):
        held[at][1][1][tuple(row)] = n
    return dict(held)


def counters(stream: DataFrame, labels: DataFrame, groups: int, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Changes ``(part, mask, good, toxic, n)`` to the counters, as a stream; their sums are the counts so far.

    The state holds each text under its SHA-256 with its smallest id, in ``groups`` groups by that hash.
    """
    reach_workers(stream.sparkSession)
    rows = flagged(masked(stream, id, text, part), labels)
    settled = F.pmod(F.xxhash64("id", "part", "mask", F.rand(11)), F.lit(groups))
    group = F.when(F.col("name").isNull(), settled).otherwise(F.pmod(F.xxhash64("name"), F.lit(groups))).cast("int")
    # A null would turn the other ids of a pandas column into floats; rows without id are settled, so theirs is not looked at.
    rows = rows.withColumn("texts", group).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    return rows.groupBy("texts").applyInPandasWithState(least_ids, DELTAS, STATE, "update", "NoTimeout")


def counted(stream: DataFrame, labels: DataFrame, groups: int, id: str = "doc_id", text: str = "text", part: str = "lang", folder: str | None = None) -> DataFrame:
    """``(part, mask, good, toxic, n)`` after all that the stream holds now.

    Every micro-batch adds its changes up and writes them under its number, over what an earlier try
    left there, so a retried batch changes nothing. A ``folder`` that is passed again, with the same ``groups``, goes on where it stopped.
    """
    spark = stream.sparkSession
    keep_state(spark)
    # What a batch changed is written, not the whole state again.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    out = folder or run_dir(spark, "interactions")

    def put(changes: DataFrame, number: int) -> None:
        changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{out}/counters/{number}")

    writer = counters(stream, labels, groups, id, text, part).writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint")
    query = writer.outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    if not (folder or query.recentProgress):
        return spark.createDataFrame([], DELTAS)
    changes = spark.read.schema(DELTAS).parquet(f"{out}/counters/*")
    return changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def audit(counts: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of counters.

    One row for every part, order of the filters and step. ``shapley`` adds up what the step's filter
    removes over all orders: a row that fails s filters is removed by each of them in one order of s.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)")
    before = F.expr("aggregate(sequence(1, 5), 0, (a, i) -> CASE WHEN i < step THEN a | shiftleft(1, ascii(substr(filter_order, i, 1)) - 65) ELSE a END)")
    steps = steps.withColumns({"bit": bit, "before": before})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    n, zero = F.col("n"), F.lit(0).cast("long")

    def total(which, value=n):
        return F.sum(F.when(which, value).otherwise(zero)).cast("long")

    every = int(np.prod(range(1, len(FILTERS) + 1)))
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, n * F.expr(f"{every} div bit_count(mask)")).alias("shapley"),
    )


def filter_interactions(spark: SparkSession, path: str, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang", batches: int = 4) -> DataFrame:
    """Audit of five filters over the Parquet files at ``path``, read as about ``batches`` micro-batches.

    Filters: A under 100 words; B distinct words under 80 % of words; C over 10 % of the characters are A-Z; D holds one of
    ``#$%&*|``; E the text equals that of a smaller id, removed or not. See ``audit`` for the rows.

    Null texts are empty, a null part is the empty string. A row without id is no copy of another and
    none is a copy of it; rows that share an id are no copies of each other, each counts. Empty files, an empty table: no
    rows. Other columns are ignored.
    """
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    # A stream takes a single file only where the path is a pattern; this one matches the path itself, file or folder.
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(pattern)
    groups = max(64, table.count() // GROUP)  # read from the footers
    return audit(counted(stream, labels, groups, id, text, part))
