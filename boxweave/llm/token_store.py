"""Token ids of a corpus, written as directly addressable codes in order of the documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxweave.llm.common import map_batches, picked, stored
from boxweave.llm.dac import Codes, encode
from boxweave.llm.pretokens import library_encoder

#: Ids in a segment, unless one document has more.
SEGMENT = 1_000_000


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids; returns the written segments.

    Documents are dealt out by ranges of their id and sorted (repeated ids by text, null ids
    first), so the segments of shard 0, 1, ... hold them in ascending order. A row is one segment:
    ``shard``, ``segment``, ``first`` (ids before it in its shard), ``n_tokens``, ``doc_ids``,
    ``ends`` (running ends of the documents) and ``codes``. Rows are written by Spark's committer
    to the shared folder, uncompressed, so that codes can be read in place. Null and empty texts
    hold the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = library_encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        names, parts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first, names, parts, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)
            values = [[shard], [number], [first], [len(ids)], [names], [ends], [encode(ids)]]
            out = pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, SEGMENTS(kind))], schema=SEGMENTS(kind))
            number, first, names, parts, size = number + 1, first + len(ids), [], [], 0
            return out

        for batch in batches:
            kind = batch.column(0).type
            for name, ids in zip(batch.column(0), ids_of.all(t.as_py() for t in batch.column(1))):
                ids += end
                if parts and size + len(ids) // 4 > segment:
                    yield flush()
                names.append(name.as_py())
                parts.append(ids)
                size += len(ids) // 4
        if parts:
            yield flush()
        ids_of.rest()

    rows = picked(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    schema = f"shard int, segment int, first long, n_tokens long, doc_ids array<{kind}>, ends array<bigint>, codes binary"
    return stored(map_batches(ordered, run, schema), "tokens", compression="none")


def SEGMENTS(kind: pa.DataType) -> pa.Schema:
    """Arrow schema of a segment whose documents have ids of ``kind``."""
    fields = {"shard": pa.int32(), "segment": pa.int32(), "first": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(kind), "ends": pa.list_(pa.int64()), "codes": pa.binary()}
    return pa.schema(list(fields.items()))


def with_starts(segments: DataFrame) -> DataFrame:
    """``start``: ids before each segment. A shard is a task of the writer, so their totals are few enough to send to all tasks."""
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return segments.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first"))


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the written segments: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, names, ends, data = (batch.column(c)[i] for c in range(4))
                codes, stops = Codes(data.as_py()), ends.values.to_numpy()
                ids = codes.slice(0, len(codes))
                begins = np.r_[0, stops[:-1]]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, stops)]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(begins + start.as_py()), pa.array(stops - begins), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    rows = with_starts(segments).select("start", "doc_ids", "ends", "codes")
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """The id at each wanted place: ``positions(doc_id, position)`` gives ``(doc_id, position, token)``.

    Only the segments that hold wanted documents reach Python, and in these only the chunks of the
    wanted ids are read. Positions outside a document give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, wanted = Codes(batch.column(0)[i].as_py()), batch.column(1)[i].values
                place, name, position = (wanted.field(k) for k in ("place", "doc_id", "position"))
                yield pa.RecordBatch.from_arrays([name, position, pa.array([codes[p.as_py()] for p in place], pa.int64())], ["doc_id", "position", "token"])

    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    docs = segments.select("shard", "segment", F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("k", "d"), "ends")
    docs = docs.select("shard", "segment", F.col("d.doc_ids").alias("doc_id"), F.when(F.col("k") == 0, 0).otherwise(F.get("ends", F.col("k") - 1)).alias("begin"), F.col("d.ends").alias("end"))
    hits = docs.join(positions.select("doc_id", "position"), "doc_id").where("position >= 0 AND begin + position < end")
    hits = hits.groupBy("shard", "segment").agg(F.collect_list(F.struct((F.col("begin") + F.col("position")).alias("place"), "doc_id", F.col("position").cast("long").alias("position"))).alias("wanted"))
    rows = segments.join(hits, ["shard", "segment"]).select("codes", "wanted")
    return map_batches(rows, run, f"doc_id {kind}, position long, token long")
