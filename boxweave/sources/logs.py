"""Log lines to tables. Lines that do not parse go to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxweave.functions.staged import staged

# Field names of the log format.
PAIRS = ["raw_center", "smooth_center", "raw_delta", "smooth_delta"]
OPTIONAL_PAIRS = ["raw_size", "smooth_size"]
INTS = ["pts_ms", "dt_ms", "stable_tracks", "raw_reversals", "created", "lost"]
FLOATS = ["raw_step_ratio", "smooth_step_ratio", "raw_size_step", "smooth_size_step"]
IDS = ["active_ids", "stable_ids"]
RUNTIME_MARKERS = ["PullStats", "EncodeStats", "StreamStats"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and an increasing number."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def _mapped(df: DataFrame, text: Column) -> DataFrame:
    """``__m`` maps the keys of the ``key=value`` words of a text to their values; of a repeated key the last value counts."""
    words = staged(df, {"__w": F.reverse(F.filter(F.split(text, r"\s+"), lambda w: F.contains(w, F.lit("="))))})
    # A lambda computes what it refers to anew for every element, so the arrays it searches are columns.
    pairs = staged(words, {"__k": F.transform("__w", lambda w: F.substring_index(w, "=", 1)), "__v": F.transform("__w", lambda w: F.substr(w, F.instr(w, "=") + 1))})
    keys = staged(pairs.drop("__w"), {"__u": F.array_distinct("__k")})
    latest = F.transform("__u", lambda k: F.get("__v", F.array_position("__k", k).cast("int") - 1))
    return staged(keys, {"__m": F.map_from_arrays("__u", latest)}).drop("__k", "__v", "__u")


def _value(key: str) -> Column:
    """Value of a key; null if absent."""
    return F.try_element_at("__m", F.lit(key))


def _marked(lines: DataFrame, marker: str) -> DataFrame:
    """Lines with the marker; ``__m`` maps the keys after it to their values."""
    after = F.substr("value", F.instr("value", marker) + len(marker))
    return _mapped(lines.where(F.instr("value", marker) > 0), after)


def _ids(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.try_cast("long"))


def _split(df: DataFrame, lines: DataFrame, required: list[str], bad: Column, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects. ``bad`` is judged on the parsed columns."""
    missing = F.array_join(F.array_except(F.array(*map(F.lit, required)), F.map_keys("__m")), ", ")
    parsed = staged(df, {**columns, "__missing": missing})
    reason = F.when(F.col("__missing") != "", F.concat(F.lit("missing "), "__missing")).when(F.coalesce(bad, F.lit(True)), "format")
    judged = staged(parsed, {"__reason": reason})
    kept = [c for c in ("file", "line_no") if c in lines.columns]
    good = judged.where(F.col("__reason").isNull()).select(*kept, *columns)
    rejects = judged.where(F.col("__reason").isNotNull()).select(*lines.columns, F.col("__reason").alias("reason"))
    return good, rejects


def _any_null(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def parse_motion_stats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``[MotionStats]`` lines to samples, and rejects with a reason."""
    df = _marked(lines, "[MotionStats]")

    def pair(key: str, i: int) -> Column:
        return F.get(F.split(_value(key), ",", 2), F.lit(i)).try_cast("double")

    names = {"raw_center": "raw_center_{}", "smooth_center": "smooth_center_{}", "raw_delta": "raw_d{}", "smooth_delta": "smooth_d{}",
             "raw_size": "raw_size_{}", "smooth_size": "smooth_size_{}"}
    ints = {k: _value(k).try_cast("long") for k in ["frame", *INTS]}
    floats = {k: _value(k).try_cast("double") for k in FLOATS}
    pairs = {names[k].format(axis): pair(k, i) for k in PAIRS + OPTIONAL_PAIRS for i, axis in enumerate("xy")}
    ids = {k: _ids(_value(k)) for k in IDS}
    named = {"frame_id" if k == "frame" else k: c for k, c in {**ints, **floats, **pairs, **ids}.items()}
    optional = [names[k].format(a) for k in OPTIONAL_PAIRS for a in "xy"]
    bad = _any_null([F.col(c) for c in named if c not in optional])
    for c in ids:
        bad = bad | F.exists(c, lambda x: x.isNull())
    return _split(df, lines, ["frame", *INTS, *FLOATS, *PAIRS, *IDS], bad, named)


def parse_motion_tracks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``[MotionTrack]`` lines to track samples, and rejects with a reason."""
    df = _marked(lines, "[MotionTrack]")
    ints = {"frame": "frame_id", "pts_ms": "pts_ms", "id": "track_id", "class_id": "class_id", "dt_ms": "dt_ms"}
    flags = ["deadzone", "reset", "was_active", "active"]
    whole = {n: _value(k).try_cast("int" if k == "class_id" else "long") for k, n in ints.items()}
    switch = {k: F.when(_value(k) == "1", True).when(_value(k) == "0", False) for k in flags}
    boxes = {}
    for side in ("raw", "smooth"):
        parts = F.split(_value(side), ",")
        boxes[f"__{side}_n"] = F.size(parts)
        boxes.update({f"{side}_{c}": F.get(parts, F.lit(i)).try_cast("double") for i, c in enumerate(("x1", "y1", "x2", "y2"))})
    named = {**whole, **boxes, **switch, "size_alpha": _value("size_alpha").try_cast("double")}
    bad = (F.col("__raw_n") != 4) | (F.col("__smooth_n") != 4) | _any_null([F.col(c) for c in named])
    good, rejects = _split(df, lines, [*ints, "raw", "smooth", *flags, "size_alpha"], bad, named)
    return good.drop("__raw_n", "__smooth_n"), rejects


def parse_runtime_stats(lines: DataFrame) -> DataFrame:
    """Runtime markers to (channel_id, source, metric, value) rows.

    A line may hold several markers; a section ends at the next ``[``. Of a repeated
    marker only the first section counts, of a repeated key only the last value.
    """
    parts = F.transform(F.split("value", r"\["), lambda p: F.struct(F.substring_index(p, "]", 1).alias("m"), F.substr(p, F.instr(p, "]") + 1).alias("t")))
    named = F.filter(parts, lambda p: p.m.isin(RUNTIME_MARKERS) & F.contains(p.t, F.lit("=")))
    marked = staged(staged(lines, {"__s": named}), {"__n": F.transform("__s", lambda p: p.m)})
    first = F.filter("__s", lambda p, i: F.array_position("__n", p.m) == i + 1)
    kept = [c for c in lines.columns if c != "value"]
    sections = marked.select(*kept, F.explode(first).alias("__s"))
    mapped = _mapped(sections, F.col("__s.t"))
    pairs = mapped.select(*kept, F.col("__s.m").alias("source"), _value("channel").alias("channel_id"), F.explode(F.map_entries("__m")).alias("__p"))
    numbered = staged(pairs, {"__x": F.regexp_extract("__p.value", r"^-?\d+(?:\.\d+)?", 0)})
    return numbered.where(F.col("__x") != "").select(*kept, "source", "channel_id", F.col("__p.key").alias("metric"), F.col("__x").cast("double").alias("value"))
