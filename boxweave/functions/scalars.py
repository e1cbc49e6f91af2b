"""Scalar helpers as Column expressions: numbers, text, times, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(c, low), high)


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def smoothstep(c: Column) -> Column:
    """Cubic ease between 0 and 1."""
    t = clamp01(c)
    return t * t * (F.lit(3.0) - t * 2.0)


def safe_change(before: Column, after: Column) -> Column:
    """Percent change; null when there is nothing to compare with."""
    usable = before.isNotNull() & ~F.isnan(before) & (F.abs(before) >= 1e-12)
    return F.when(usable, (after - before) / before * 100.0)


def rms(c: Column) -> Column:
    """Root mean square, an aggregate."""
    return F.sqrt(F.avg(c * c))


def pctl(c: Column, q: float) -> Column:
    """Linear percentile, an aggregate. Holds a group's distinct values in memory:
    for groups without a bound use ``aggregates.exact_quantiles``."""
    return F.percentile(c, F.lit(q))


def log_step(new: Column, old: Column) -> Column:
    return F.log(new / old)


def even_floor(c: Column) -> Column:
    """Largest even integer not above a whole number."""
    whole = c.cast("long")
    return whole - F.pmod(whole, F.lit(2))


def align_down(c: Column, step: int) -> Column:
    whole = c.cast("long")
    return whole - F.pmod(whole, F.lit(step))


def align_up(c: Column, step: int) -> Column:
    return align_down(c.cast("long") + (step - 1), step)


def round_half_away(c: Column) -> Column:
    """Round to a whole number, halves away from zero."""
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def dequant(q: Column, zp: Column, scale: Column) -> Column:
    return (q - zp) * scale


def quant(value: Column, zp: Column, scale: Column) -> Column:
    """Affine int8 code of a value, limited to -128..127, cut towards zero."""
    return clamp(value / scale + zp, -128.0, 127.0).cast("int")


def session_of(name: Column) -> Column:
    """Part of an image name before the first ``__``; null when there is none."""
    return F.when(F.instr(name, "__") > 0, F.substring_index(name, "__", 1))


def stem_of(path: Column) -> Column:
    """File name without its folder and last suffix."""
    base = F.substring_index(path, "/", -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def class_slug(label: Column) -> Column:
    return F.replace(label, F.lit(" "), F.lit("_"))


# Answers that mean "keep" in a review sheet.
KEEP_VALUES = ["1", "y", "yes", "true", "keep", "保留"]


def is_keep(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(KEEP_VALUES), F.lit(False))


def display_text(name: Column, score: Column) -> Column:
    """Label with its confidence in whole percent, limited to 0..100."""
    percent = clamp((score * 100.0).cast("int"), 0, 100)
    return F.concat(name, F.lit(" "), percent.cast("string"), F.lit("%"))


def capture_time(name: Column) -> Column:
    """Timestamp written into camera file names as ``IMG_yyyymmdd_hhmmss``; null otherwise."""
    pattern = r"IMG_(\d{8})_(\d{6})"
    digits = F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    return F.when(F.length(digits) == 14, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def epoch_seconds(ms: Column) -> Column:
    """Whole seconds since 1970 from milliseconds."""
    return F.floor(ms / 1000).cast("long")


def payload_matches(width: Column, height: Column, data: Column) -> Column:
    """A base64 picture holds exactly width x height x 1.5 bytes."""
    return F.length(F.unbase64(data)) == (width * height * 1.5).cast("int")
