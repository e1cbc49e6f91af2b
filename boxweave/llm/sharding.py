"""Shards by extendible hashing: only buckets over their byte limit are split on another bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxweave.llm.common import picked, stored

#: Bits of a row's hash: the first from its id alone, the others from id and text.
ID_BITS, TEXT_BITS = 32, 28
BITS = ID_BITS + TEXT_BITS
#: Bits below the expected depth that the first directory looks at, and bits added when that is not enough.
AHEAD = 8


def row_hash(id: Column, text: Column) -> Column:
    """60 bits of a row. Rows with one id part only where their texts do."""

    def bits(value: Column, digits: int) -> Column:
        return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("long")

    name = F.coalesce(id.cast("string"), F.lit(""))
    return bits(name, ID_BITS // 4) * (1 << TEXT_BITS) + bits(F.concat(name, F.lit("\n"), text), TEXT_BITS // 4)


def _directory(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """``(cell, bits)``: how many bits name the bucket of each cell ``depth`` bits deep, null if it still is too large.

    A bucket is the shortest prefix of more than ``above`` bits whose rows fit the limit (from
    0 bits where ``above`` is -1).
    """
    prefixes = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("bits"))
    prefixes = prefixes.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - bits)"))
    fits = stored(prefixes.groupBy("bits", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("bits", "prefix"), "fits")
    # Prefixes shorter than any that fits need no partner, and they alone would gather very many cells.
    shortest = fits.agg(F.min("bits")).first()[0]
    near = prefixes.select("cell", "bits", "prefix").where(F.col("bits") >= (depth + 1 if shortest is None else shortest))
    found = near.join(fits, ["bits", "prefix"]).groupBy("cell").agg(F.min("bits").alias("bits"))
    return cells.select("cell").join(found, "cell", "left")


def assign_shards(docs: DataFrame, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard of every row: ``(doc_id, n_bytes, shard, bits, page)``.

    The directory is indexed by the leading bits of ``row_hash``; a bucket whose texts (UTF-8)
    take more than ``limit`` bytes is split on its next bit, the others are left. ``shard`` is the
    bucket's prefix in binary, ``bits`` its length. Rows that share all bits are copies of one row;
    where these exceed the limit together, they fill numbered overflow pages. A single text above
    the limit has a bucket, or a page, of its own. Null texts take 0 bytes; null ids hash as empty
    text; an empty table gives an empty one.

    Sums are taken per cell, some bits deeper than the expected depth, so the directory is far
    smaller than the rows; rows in cells that turn out too large go through the next bits alone.
    """
    rows = picked(docs, id=id, text=text)
    body = F.coalesce("text", F.lit(""))
    rows = stored(rows.select("id", row_hash(F.col("id"), body).alias("hash"), F.octet_length(body).cast("long").alias("bytes")), "sized")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    above, done = -1, []
    while True:
        celled = rows.withColumn("cell", F.expr(f"shiftright(hash, {BITS - depth})"))
        found = stored(_directory(celled.groupBy("cell").agg(F.sum("bytes").alias("bytes")), above, depth, limit), "directory")
        placed = celled.join(found.where("bits IS NOT NULL"), "cell")
        done.append(placed.select("id", "bytes", "bits", F.expr(f"shiftright(cell, {depth} - bits)").alias("prefix"), F.lit(0).cast("long").alias("page")))
        crowded = found.where("bits IS NULL").select("cell")
        if crowded.isEmpty():
            break
        rows = stored(celled.join(crowded, "cell").select("id", "hash", "bytes"), "crowded")
        if depth == BITS:
            done.append(_pages(rows, limit))
            break
        above, depth = depth, min(BITS, depth + AHEAD)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    shard = F.when(F.col("bits") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("bits").cast("int"), F.lit("0")))
    return out.select(F.col("id").alias("doc_id"), F.col("bytes").alias("n_bytes"), shard.alias("shard"), F.col("bits").cast("long").alias("bits"), "page")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Copies of one row on as many pages as they need; a page's copies are made again from their number."""
    counted = rows.groupBy("id", "hash", "bytes").agg(F.count("*").alias("copies"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes"))).cast("long")
    pages = counted.withColumn("each", each).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div each"))).alias("page"))
    pages = pages.withColumn("here", F.least(F.col("each"), F.col("copies") - F.col("page") * F.col("each"))).repartition("hash", "page")
    return pages.select("id", "bytes", F.lit(BITS).alias("bits"), F.col("hash").alias("prefix"), "page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("here"))).alias("n")).drop("n")


def shard_sizes(shards: DataFrame) -> DataFrame:
    """``(shard, page, rows, bytes)`` of an assignment."""
    return shards.groupBy("shard", "page").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))
