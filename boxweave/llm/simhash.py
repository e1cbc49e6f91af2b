"""SimHash near-duplicates: fingerprints of word shingles, joined by a binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxweave.llm import similar, trie
from boxweave.llm.common import map_batches, packed, picked, stored
from boxweave.llm.components import components
from boxweave.session import dealt

SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 65_536
#: Fingerprints below one trie node that a task takes at a time; more are dealt out by further bits.
GROUP = 1024


def fingerprint(text: str | None, words: int, distinct: bool = False) -> int:
    """64 bits, each set when it is set in over half of the shingles' hashes; 0 without words.

    Shingles count as often as they occur, or, with ``distinct`` (for single words), once each.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if distinct:
        parts = sorted(set(parts))
    line = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    n = max(1, len(parts) - words + 1)
    last = min(words, len(parts)) - 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + last : to + last])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, distinct: bool = False) -> DataFrame:
    """``(id, body, code)`` for every row; the code is the fingerprint as a signed long, the body a hash of the text.

    Words are runs without white space, A-Z lower-cased. Fewer words than a shingle: the
    whole sequence is one. Null and empty texts have the code 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t.as_py(), words, distinct) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes.view(np.int64))], ["id", "body", "code"])

    rows = picked(docs, id=id, text=text).withColumn("body", F.xxhash64("text"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, body long, code long")


def _below(rows: DataFrame, radius: int) -> DataFrame:
    """Rows ``(path, code)`` dealt to every bit order below their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, code = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for above in np.unique(path):
                own = code[path == above]
                for order in trie.orders(int(above), radius):
                    mask = np.uint64(trie.lead_mask(order, radius)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), order)), pa.array(own & mask), pa.array(own)], ["path", "lead", "code"])

    return map_batches(rows, run, "path long, lead long, code long")


def _joined(rows: DataFrame, radius: int) -> DataFrame:
    """Links within each group ``(path, lead)``; a group's links come as one star per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def links(block: np.ndarray) -> pa.RecordBatch:
            changed = (np.diff(block[0]) != 0) | (np.diff(block[1]) != 0)
            group, code = np.r_[0, np.cumsum(changed)], block[2].view(np.uint64)
            order = np.lexsort((code, group))
            a, b = trie.linked(group, code[order], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            changed = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(changed):
                cut = changed[-1] + 1
                yield links(np.ascontiguousarray(held[:, :cut]))
                held = held[:, cut:]
        if held.shape[1]:
            yield links(np.ascontiguousarray(held))

    groups = dealt(rows, "path", "lead").sortWithinPartitions("path", "lead")
    return map_batches(groups, run, "a long, b long").distinct()


def near_codes(codes: DataFrame, radius: int = 4, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` between distinct codes, with the same components as all pairs within ``radius`` bits.

    Tries over several bit orders start below the levels where no bit may differ (see
    ``trie.orders``). A group below such a node with over ``group`` codes is dealt out again by
    every order of its remaining bits, so no task holds a large one, and no pair is lost.
    """
    rows = _below(codes.select(F.lit(0).cast("long").alias("path"), "code"), radius)
    out = None
    while True:
        crowded = stored(rows.groupBy("path", "lead").count().where(F.col("count") > group).drop("count"), "crowded")
        paths = [r[0] for r in crowded.select("path").distinct().collect()]
        whole = [p for p in paths if not trie.splittable(p, radius)]
        crowded = crowded.where(~F.col("path").isin(whole)) if whole else crowded
        again = len(paths) > len(whole)
        part = _joined(rows.join(crowded, ["path", "lead"], "left_anti") if again else rows, radius)
        out = part if out is None else out.unionByName(part)
        if not again:
            return out
        rows = _below(stored(rows.join(crowded, ["path", "lead"], "left_semi").select("path", "code"), "dealt"), radius)


def classed(docs: DataFrame, id: str, text: str, words: int, radius: int, group: int = GROUP) -> DataFrame:
    """``(id, body, code, component_id)`` of every row."""
    rows = stored(fingerprints(docs, id, text, words), "fingerprints")
    codes = stored(rows.groupBy("code").agg(F.min("id").alias("least")), "codes")
    roots = components(near_codes(codes.select("code"), radius, group)).select(F.col("a").alias("code"), F.col("b").alias("root"))
    return _named(rows, codes, roots)


def _named(rows: DataFrame, codes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the least id of their class; ``roots`` has the linked codes and the root of each."""
    named = stored(codes.join(roots, "code", "left").select("code", "least", F.coalesce("root", "code").alias("root")), "rooted")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(least, "root").select("code", "component_id"), "classes")
    return rows.join(classes, "code")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, group: int = GROUP) -> DataFrame:
    """Class of near copies of every row: ``(doc_id, fingerprint, component_id)``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id
    reachable. Rows without words share the fingerprint 0 and link like any other. A row with a
    null id is kept and takes the class of its fingerprint. Repeated rows are all returned, an
    empty table gives an empty one, other columns are ignored. Copies share a fingerprint and are
    never paired: links join different fingerprints only.
    """
    rows = classed(docs, id, text, words, radius, group)
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, distinct: bool = True) -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest id.

    Two texts link at a Jaccard similarity of their shingles of ``similarity`` or more, by an exact check of
    candidates that miss less than one such pair in a billion (see ``similar``); shingles count once each or, without ``distinct``, as often as they
    occur. Texts without words link to each other only.

    Rows of a class that share that id are told apart by a hash of their text; of equal rows one
    stays. Of a class without ids, one row stays. What goes is named by id and text, so a
    row's other columns do not matter.
    """
    rows = stored(similar.signed(docs, id, text, words, distinct, similarity), "signed")
    roots = similar.similar_classes(rows, docs, text, words, distinct, similarity).select(F.col("node").alias("code"), "root")
    light = rows.select("id", "body", F.col("node").alias("code"))
    codes = stored(light.groupBy("code").agg(F.min("id").alias("least")), "codes")
    return _first_of_each(docs, id, text, _named(light, codes, roots))


def fingerprint_representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, group: int = GROUP) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``; which row stays is told in ``representatives``."""
    return _first_of_each(docs, id, text, classed(docs, id, text, words, radius, group))


def _first_of_each(docs: DataFrame, id: str, text: str, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not the first of their class in ``rows`` (``id``, ``body``, ``component_id``)."""
    rows = stored(rows.select("id", "body", "component_id"), "classed")
    own = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id", "id").agg(F.min("body").alias("body"), F.count("*").alias("n"))
    kept = own.select(F.col("component_id").alias("kept_of"), "body")
    gone = rows.join(kept, F.col("component_id").eqNullSafe(F.col("kept_of")) & F.col("id").eqNullSafe(F.col("kept_of")) & (rows["body"] == kept["body"]), "left_anti")
    gone = stored(gone.select("id", "body").distinct(), "gone")
    left = packed(docs, id=id, text=text).withColumn("body", F.xxhash64("text")).drop("text")
    # What goes grows with the rows, so it is never sent to all tasks: one plan at every size.
    left = left.join(gone.hint("merge"), left["id"].eqNullSafe(gone["id"]) & (left["body"] == gone["body"]), "left_anti")
    twice = stored(own.where("n > 1").select("id"), "twice")
    if not twice.isEmpty():
        same = left["id"].eqNullSafe(twice["id"])
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["id", "body"]))
    return left.select("row.*")
