"""Benchmark items in documents: SimHash of item-sized windows, found by multi-index Hamming blocks.

A window of as many shingles as an item has is compared with it by the bits in which their
fingerprints differ. The fingerprints are cut into blocks; two within the radius differ by at most
``radius // blocks`` bits in at least one block, so an index of each item's blocks with so many
bits changed finds every window within the radius by equality. What is found is verified by
the exact similarity of the weighted shingles. Everything here is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxweave.functions.staged import staged
from boxweave.llm.common import packed, picked, stored
from boxweave.llm.native import WORD, row_key
from boxweave.session import broadcast_if_small

SHINGLE = 5
#: Four counters of 16 bits in a long; 16 longs count the 64 bits of a window.
LANES, PLACES = 0x0001000100010001, 16
COUNTED = 13


@dataclass(frozen=True)
class Search:
    """``similarity``: least weighted similarity of a match. ``radius``: differing bits that are searched;
    ``blocks``: parts of a fingerprint. ``longest``: words of an item searched as one; of a longer item
    parts of equal size are searched, each of which proposes a window for the whole item. ``broadcast_rows``: shingles or index rows up to which the benchmark's
    side is sent to all tasks; beyond, both sides are dealt out."""

    similarity: float = 0.8
    radius: int = 14
    blocks: int = 5
    longest: int = 512
    broadcast_rows: int = 200_000

    def __post_init__(self) -> None:
        if not 2 * SHINGLE <= self.longest <= 8191:
            raise ValueError("items are searched by 10 to 8191 words")


def shingles(words: Column) -> Column:
    """Hashes of all runs of five words; of the whole sequence where it is shorter; none without words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def fingerprint(hashes: Column) -> Column:
    """SimHash of up to 8191 hashes: a bit is set when it is in over half of them."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(PLACES)])
    lane = F.lit(LANES).cast("long")
    added = F.aggregate(hashes, zero, lambda a, h: F.struct(*[(a[f"c{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(lane)).alias(f"c{j}") for j in range(PLACES)]))
    return added


def _bits(counts: Column, n: Column) -> Column:
    """Bits of the fingerprint from the counters: a counter above half carries into its bit ``COUNTED``."""
    lane = F.lit(LANES).cast("long")
    lift = (F.lit((1 << COUNTED) - 1) - F.floor(n / 2)) * lane
    out = F.lit(0).cast("long")
    for j in range(PLACES):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(counts[f"c{j}"] + lift, COUNTED).bitwiseAND(lane), j))
    return out


def with_fingerprint(rows: DataFrame, hashes: str, name: str) -> DataFrame:
    rows = staged(rows, {"_counts": fingerprint(F.col(hashes))})
    return staged(rows, {name: _bits(F.col("_counts"), F.size(hashes))}).drop("_counts")


def block_masks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of a fingerprint."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def item_parts(items: DataFrame, rule: Search, id: str = "item_id", text: str = "text") -> DataFrame:
    """``(part, item_id, offset, of, m, code, hashes)``: items, or ``of`` parts of a long one that begin at word ``offset``, with at least one word."""
    rows = picked(items, id=id, text=text).select("id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    rows = rows.withColumn("of", F.ceil(F.size("words") / rule.longest).cast("int"))
    edge = lambda k: F.floor(k * F.size("words") / F.col("of")).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(edge(k).alias("offset"), F.slice("words", edge(k) + 1, edge(k + 1) - edge(k)).alias("words")))
    rows = staged(rows, {"cut": cut}).select("id", "of", F.inline("cut"))
    rows = staged(rows, {"hashes": shingles(F.col("words"))})
    rows = rows.select(F.xxhash64("id", "offset", "hashes").alias("part"), F.col("id").alias("item_id"), "offset", "of", F.size("hashes").alias("m"), "hashes")
    return with_fingerprint(rows, "hashes", "code").dropDuplicates(["part"])


def item_index(parts: DataFrame, rule: Search) -> DataFrame:
    """``(m, block, bits, part, code)``: every value of each block within its share of the radius."""
    allowed, rows = rule.radius // rule.blocks, None
    for b, (shift, width) in enumerate(block_masks(rule.blocks)):
        flips = [sum(1 << i for i in c) for k in range(allowed + 1) for c in combinations(range(width), k)]
        own = _block(F.col("code"), shift, width)
        near = F.array(*[own.bitwiseXOR(F.lit(f).cast("long")) for f in flips])
        one = parts.select("m", F.lit(b).alias("block"), F.explode(near).alias("bits"), "part", "code")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def windows(docs: DataFrame, parts: DataFrame, rule: Search, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, id, start, m, hashes)``: windows of an item's size that could be similar enough to any item.

    A window shares too few shingles with every item if too few of its shingles occur in the benchmark
    at all; such windows are left out, and no other. The rest belong each to the first of
    their shingles that does occur, and are cut from the few hashes around it. A document with fewer
    shingles than an item is one window for it, where it has enough to be that similar.
    """
    sizes = [r[0] for r in parts.select("m").distinct().orderBy("m").collect()]
    longest = max(sizes, default=1)
    slack = int(longest * (1 - 2 * rule.similarity / (1 + rule.similarity))) + 1
    known = broadcast_if_small(parts.select(F.explode("hashes").alias("hash")).distinct(), rule.broadcast_rows)
    rows = picked(docs, id=id, text=text).select("id", row_key("id", "text").alias("key"), words_of(F.col("text")).alias("words"))
    rows = staged(rows, {"all": shingles(F.col("words"))}).select("id", "key", "all")
    spread = rows.select("id", "key", "all", F.posexplode("all").alias("at", "hash"))
    base = F.greatest(F.col("at") - slack, F.lit(0))
    hits = spread.join(known, "hash").select("id", "key", "at", F.size("all").alias("n"), base.alias("base"), F.slice("all", base + 1, slack + longest).alias("around"))
    hits = hits.dropDuplicates(["key", "at"])
    order = Window.partitionBy("key").orderBy("at")
    hits = hits.withColumn("before", F.coalesce(F.lag("at").over(order), F.lit(-1)))
    hits = hits.withColumn("ahead", F.collect_list("at").over(order.rowsBetween(0, longest - 1)))
    needed = [F.struct(F.lit(m).alias("m"), F.lit(_needed(m, rule.similarity)).alias("need")) for m in sizes] or [F.struct(F.lit(1).alias("m"), F.lit(1).alias("need"))]
    sized = hits.select("*", F.explode(F.array(*needed)).alias("size")).select("*", "size.m", "size.need").withColumn("short", F.expr("n < m"))
    fewer = F.ceil(F.lit(rule.similarity / (1 + rule.similarity)) * (F.col("n") + F.col("m")) - 1e-9)
    sized = sized.withColumn("need", F.when(F.col("short"), fewer).otherwise(F.col("need"))).where("size(ahead) >= need AND (NOT short OR before = -1 AND base = 0)")
    lead = F.least(F.col("at") - F.col("before") - 1, F.col("m") - F.col("need"), F.col("at"))
    starts = F.when(F.col("short"), F.array(F.lit(0))).otherwise(F.sequence(F.col("at") - lead, F.col("at")).cast("array<int>"))
    begun = sized.select("*", F.explode(starts).alias("start")).where("short OR start + m <= n")
    full = begun.where(F.size(F.filter("ahead", lambda a: a < F.col("start") + F.col("m"))) >= F.col("need"))
    return full.select("key", "id", "start", "m", F.slice("around", F.col("start") - F.col("base") + 1, F.least("m", "n")).alias("hashes"))


def _needed(m: int, similarity: float) -> int:
    """Shingles that two bags of ``m`` share at least when they are that similar."""
    return max(1, -int(-(m * 2 * similarity / (1 + similarity) - 1e-9) // 1))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater weights; a shingle weighs as often as it occurs."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(shared)
    return common / (F.size(a) + F.size(b) - common)


def _whole_items(found: DataFrame, docs: DataFrame, items: DataFrame, rule: Search, id: str, text: str) -> DataFrame:
    """Long items by the windows that their found parts propose: ``(key, id, item_id, similarity, start, distance, m)``.

    A part that begins at ``start`` of a document puts the item ``offset`` before that; there the item as a
    whole is compared. An item that is similar enough has a part that is, so none is left out for its other parts.
    """
    asked = found.groupBy("key", "id", "item_id", F.greatest(F.col("start") - F.col("offset"), F.lit(0)).alias("start")).agg(F.min("distance").alias("distance"))
    own = picked(items, id="item_id", text="text").select(F.col("id").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > rule.longest)
    own = own.select("item_id", shingles(F.col("words")).alias("theirs")).join(found.select("item_id").distinct(), "item_id", "left_semi")
    keyed = picked(docs, id=id, text=text).select(row_key("id", "text").alias("key"), "text")
    texts = keyed.join(found.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", shingles(words_of(F.col("text"))).alias("all"))
    here = F.slice("all", F.col("start") + 1, F.size("theirs"))
    judged = staged(asked.join(texts, "key").join(own, "item_id"), {"similarity": weighted_similarity(here, F.col("theirs"))}).where(F.col("similarity") >= rule.similarity)
    return judged.select("key", "id", "item_id", "similarity", "start", "distance", F.size("theirs").alias("m"))


def contaminated(docs: DataFrame, items: DataFrame, rule: Search = Search(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where documents hold benchmark items: ``(key, doc_id, item_id, similarity, distance, start, shingles)``.

    The best window of each document and item: greatest similarity, then least start (in shingles, counted
    in words). A document shorter than the item is compared as a whole. Words are letters and digits in lower case. Texts of fewer than five words are one
    shingle and match only the same words. Null and empty texts and items hold nothing; equal rows share a key
    and give one result; an empty table on either side gives none.
    """
    parts = stored(item_parts(items, rule), "items")
    found = with_fingerprint(windows(docs, parts, rule, id, text), "hashes", "code")
    masks = block_masks(rule.blocks)
    probes = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("code"), s, w).alias("bits")) for b, (s, w) in enumerate(masks)])
    probed = found.select("key", "id", "start", "m", "hashes", F.col("code").alias("own"), F.inline(probes))
    index = broadcast_if_small(item_index(parts, rule), rule.broadcast_rows)
    apart = F.col("own").bitwiseXOR(F.col("code"))
    near = probed.join(index, ["m", "block", "bits"]).where(F.bit_count(apart) <= rule.radius)
    first = F.coalesce(*[F.when(F.bit_count(_block(apart, s, w)) <= rule.radius // rule.blocks, F.lit(b)) for b, (s, w) in enumerate(masks)])
    near = near.where(first == F.col("block")).select("key", "id", "start", "m", "hashes", "part", F.bit_count(apart).alias("distance"))
    whole = broadcast_if_small(parts.select("part", "item_id", "offset", "of", F.col("hashes").alias("theirs")), rule.broadcast_rows // 100)
    judged = staged(near.join(whole, "part"), {"similarity": weighted_similarity(F.col("hashes"), F.col("theirs"))}).where(F.col("similarity") >= rule.similarity)
    if not parts.where("of > 1").isEmpty():
        judged = stored(judged.select("key", "id", "item_id", "offset", "of", "similarity", "start", "distance", "m"), "found")
        judged = judged.where("of = 1").drop("offset", "of").unionByName(_whole_items(judged.where("of > 1"), docs, items, rule, id, text))
    best = judged.groupBy("key", "id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "distance", "m")).alias("b"))
    return best.select("key", F.col("id").alias("doc_id"), "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.distance").cast("long").alias("distance"), F.col("b.start").cast("long").alias("start"), F.col("b.m").cast("long").alias("shingles"))


def clean_documents(docs: DataFrame, items: DataFrame, rule: Search = Search(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item."""
    leaks = stored(contaminated(docs, items, rule, id, text).select("key").distinct(), "leaks")
    rows = packed(docs, id=id, text=text)
    return rows.select("row", row_key("id", "text").alias("key")).join(leaks, "key", "left_anti").select("row.*")
