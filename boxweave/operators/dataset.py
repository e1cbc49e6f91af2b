"""Annotation data sets: manifests, labels, splits, leakage, balance, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxweave.operators.filters import select_reviewed, session_or_folder
from boxweave.operators.windows import first_n
from boxweave.session import broadcast_if_small

SPLITS = ["train", "val", "test"]


def stem(name: str = "image_name") -> Column:
    return F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", "")


def label_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``labelled``, ``negative`` (hinted, to get an empty label) or ``pending``."""
    has = files.select("image_stem").distinct().withColumn("__has", F.lit(True))
    joined = manifest.withColumn("image_stem", stem()).join(has, "image_stem", "left")
    status = F.when(F.col("__has"), "labelled").when(F.col("negative_hint") == "1", "negative").otherwise("pending")
    return joined.withColumn("status", status).drop("__has", "image_stem")


def assign_split(manifest: DataFrame, session_map: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the split of their session, and the sessions that have none.

    Images still pending review take no part in either.
    """
    ready = manifest.join(pending.select("image_name"), "image_name", "left_anti")
    mapped = ready.join(broadcast_if_small(session_map.select("session", "split")), "session", "left")
    unassigned = mapped.where(F.col("split").isNull()).groupBy("session").agg(F.count("*").alias("images"))
    return mapped.where(F.col("split").isNotNull()), unassigned


def frozen_eval(candidates: DataFrame, images: DataFrame, n: int | dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """First ``n`` of each session's frozen list that still exist, and ``(session, wanted, found)`` of sessions with too few.

    ``n`` may differ by session; then sessions that are not named give nothing. Images deleted in
    review drop out without being replaced. A named session without candidates counts as 0 found.
    """
    spark = candidates.sparkSession
    if isinstance(n, dict):
        wanted = spark.createDataFrame(list(n.items()), "session string, wanted long")
        frozen = first_n(candidates.join(wanted.select("session"), "session", "left_semi"), ["session"], max(n.values(), default=0), "image_name")
        ranked = frozen.withColumn("__no", F.row_number().over(Window.partitionBy("session").orderBy("image_name")))
        frozen = ranked.join(wanted, "session").where(F.col("__no") <= F.col("wanted")).drop("__no", "wanted")
    else:
        wanted = candidates.select("session").distinct().withColumn("wanted", F.lit(n).cast("long"))
        frozen = first_n(candidates, ["session"], n, "image_name")
    counts = frozen.groupBy("session").agg(F.count("*").alias("found"))
    short = wanted.join(counts, "session", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long"))).where("found < wanted")
    return frozen.join(images.select("image_name"), "image_name", "left_semi"), short


def class_distribution(boxes: DataFrame, splits: list[str] | None = None, classes: list[int] | None = None) -> DataFrame:
    """Boxes per class and split, their total and share; class -1 is the total row. Classes without a box have zeros."""
    splits, classes = splits or SPLITS, list(range(6)) if classes is None else classes
    counts = boxes.groupBy("class_id", "split").agg(F.count("*").alias("n"))
    none = boxes.sparkSession.createDataFrame([(c,) for c in classes], "class_id int").select("class_id", F.lit(None).cast("string").alias("split"), F.lit(0).cast("long").alias("n"))
    wide = counts.select("class_id", "split", "n").unionByName(none).rollup("class_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in splits],
        F.sum("n").alias("total"),
        F.grouping("class_id").alias("__all"),
    )
    whole = boxes.groupBy().agg(F.count("*").alias("__whole"))
    # One row: the grand total of the count above.
    share = F.col("total") * 100.0 / F.greatest(F.col("__whole"), F.lit(1))
    joined = wide.join(F.broadcast(whole), F.lit(True))
    return joined.select(F.when(F.col("__all") == 1, -1).otherwise(F.col("class_id")).alias("class_id"), *splits, "total", share.alias("ratio_pct"))


def split_stats(images: DataFrame, files: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """Images, label files, empty label files and boxes per split, and ``total``. Splits without an image have zeros."""
    labelled = files.select("image_stem", "n_lines").withColumn("__has", F.lit(1))
    joined = images.withColumn("image_stem", stem()).join(labelled, "image_stem", "left").select("split", F.lit(1).alias("__image"), "__has", "n_lines")
    none = images.sparkSession.createDataFrame([(s,) for s in splits or SPLITS], "split string")
    out = joined.unionByName(none, allowMissingColumns=True).rollup("split").agg(
        F.count("__image").alias("images"),
        F.count("__has").alias("labels"),
        F.count_if((F.col("__has") == 1) & (F.col("n_lines") == 0)).alias("empty_labels"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("boxes"),
        F.grouping("split").alias("__all"),
    )
    return out.withColumn("split", F.when(F.col("__all") == 1, "total").otherwise(F.col("split"))).drop("__all")


def class_imbalance(boxes: DataFrame, classes: list[tuple[int, str]]) -> DataFrame:
    """Most and least frequent class, their ratio, and whether it exceeds ten.

    Classes without any box count as zero; the lowest class id wins a tie.
    """
    counted = boxes.groupBy("class_id").agg(F.count("*").alias("n"))
    named = boxes.sparkSession.createDataFrame(classes, "class_id int, label string")
    full = named.join(counted, "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = full.agg(
        F.min_by("label", F.struct(-F.col("n"), "class_id")).alias("most_class"),
        F.max("n").alias("most"),
        F.min_by("label", F.struct("n", "class_id")).alias("least_class"),
        F.min("n").alias("least"),
    )
    ratio = F.when(F.col("least") > 0, F.col("most") / F.col("least")).otherwise(F.lit(float("inf")))
    return out.withColumn("ratio", ratio).withColumn("high", F.col("ratio") > 10.0)


def split_sessions(images: DataFrame) -> DataFrame:
    """Sessions of each split with their image counts."""
    return images.groupBy("split", "session").agg(F.count("*").alias("images"))


def pending_by_session(pending: DataFrame, images: DataFrame) -> DataFrame:
    """Images waiting for review per session, and the split the session is in already."""
    waiting = pending.groupBy("session").agg(F.count("*").alias("pending"))
    placed = images.groupBy("session").agg(F.max("split").alias("split"))
    joined = waiting.join(placed, "session", "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("NOT YET ASSIGNED")))


def dup_counts(images: DataFrame, by: list[str] | None = None, hash_col: str = "sha256") -> DataFrame:
    """Images, distinct contents and duplicates. Contents are counted before they are summed."""
    by = by or []
    contents = images.groupBy(*by, hash_col).agg(F.count("*").alias("n"))
    out = contents.groupBy(*by).agg(F.sum("n").alias("images"), F.count("*").alias("unique_contents"))
    return out.withColumn("duplicates", F.col("images") - F.col("unique_contents"))


def source_mix(images: DataFrame, by: str, boxes: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Images per source class (or boxes per class, given ``boxes``) by source, session or aspect group."""
    counted = images if boxes is None else images.join(boxes, key)
    value = "source_class_id" if boxes is None else "class_id"
    pairs = counted.groupBy(by, value).agg(F.count("*").alias("n"))
    cols = [F.coalesce(F.sum(F.when(F.col(value) == c, F.col("n"))), F.lit(0)).alias(f"class_{c}") for c in range(6)]
    return pairs.groupBy(by).agg(*cols, F.sum("n").alias("total"))


def selection_audit(manifest: DataFrame, exclude_sessions: list[str], existing: DataFrame, sources: DataFrame) -> DataFrame:
    """What a review selection does: selected, excluded, missing source, already there, kept."""
    kept = select_reviewed(manifest)
    here = existing.select("image_name").distinct().withColumn("__there", F.lit(True))
    source = sources.select("image_name").distinct().withColumn("__source", F.lit(True))
    joined = kept.join(here, "image_name", "left").join(source, "image_name", "left")
    excluded = session_or_folder(kept).isin(exclude_sessions)
    missing, there = F.col("__source").isNull(), F.col("__there").isNotNull()
    return joined.agg(
        F.count("*").alias("selected"),
        F.count_if(excluded).alias("skipped_excluded"),
        F.count_if(~excluded & missing).alias("missing_source"),
        F.count_if(~excluded & ~missing & there).alias("skipped_existing"),
        F.count_if(~excluded & ~missing & ~there).alias("copied"),
    )


def mix_sources(parts: list[tuple[DataFrame, str, str, int]]) -> DataFrame:
    """Union of (rows, domain, prefix, times): tagged, renamed and repeated."""
    mixed = None
    for rows, domain, prefix, times in parts:
        repeated = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))
        name = F.concat(F.lit(f"{prefix}_r"), F.col("repeat").cast("string"), F.lit("_"), stem())
        tagged = repeated.withColumns({"domain": F.lit(domain), "output_stem": name})
        mixed = tagged if mixed is None else mixed.unionByName(tagged)
    return mixed


def session_leakage(images: DataFrame) -> DataFrame:
    """Sessions present in two splits. Splits per session are few, so their pairs are too."""
    splits = images.groupBy("session").agg(F.sort_array(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    first = splits.select("session", "s", F.posexplode("s").alias("i", "split_a"))
    later = first.select("session", "split_a", F.explode(F.filter("s", lambda x, j: j > F.col("i"))).alias("split_b"))
    return later


def content_leakage(images: DataFrame, split_a: str, split_b: str, hash_col: str = "sha256") -> DataFrame:
    """Contents present in both splits."""
    seen = images.where(F.col("split").isin(split_a, split_b)).groupBy(hash_col).agg(
        F.count_if(F.col("split") == split_a).alias("in_a"), F.count_if(F.col("split") == split_b).alias("in_b")
    )
    return seen.where((F.col("in_a") > 0) & (F.col("in_b") > 0))


def missing_classes(boxes: DataFrame, classes: list[int], splits: list[str] | None = None) -> DataFrame:
    """Class and split pairs without a box."""
    wanted = [(s, c) for s in (splits or SPLITS) for c in classes]
    full = boxes.sparkSession.createDataFrame(wanted, "split string, class_id int")
    return full.join(boxes.select("split", "class_id").distinct(), ["split", "class_id"], "left_anti")


def unlabelled(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images without a label file; an empty file counts as one."""
    return images.withColumn("image_stem", stem()).join(files.select("image_stem"), "image_stem", "left_anti")


def union_candidates(tile: DataFrame, joint: DataFrame) -> DataFrame:
    return tile.unionByName(joint)


def composite_split(images: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Rows of the named splits once more, as one new split."""
    return images.unionByName(images.where(F.col("split").isin(parts)).withColumn("split", F.lit(name)))


def duplicate_names(df: DataFrame, cols: list[str]) -> DataFrame:
    """Names or ids that occur more than once."""
    return df.groupBy(*cols).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
