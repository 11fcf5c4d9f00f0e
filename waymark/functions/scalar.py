"""Scalar expressions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def person_label(person_id: Column, width: int = 4) -> Column:
    """``Person_0001`` for id 0."""
    return F.format_string(f"Person_%0{width}d", person_id.cast("long") + 1)


def trailing_number(label: Column) -> Column:
    """The integer at the end of a label; null stays null, a label without one is an error."""
    digits = F.regexp_extract(label, r"([0-9]+)\s*$", 1)
    return F.when(label.isNull(), F.lit(None).cast("long")).when(digits == "", F.raise_error(F.concat(F.lit("no number at the end of "), label))).otherwise(digits.cast("long"))


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 from a number or an ISO time; a time without a zone is UTC."""
    text = F.trim(text.cast("string"))
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & text.contains(":")
    stamp = F.when(zoned, text).otherwise(F.concat(text, F.lit("+00:00")))
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00+00:00")))
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.coalesce(date, stamp).try_cast("timestamp")) / F.lit(1e6))


def ntz_seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"(unix_date(cast({column} as date)) * 86400000000L + hour({column}) * 3600000000L + minute({column}) * 60000000L + cast(extract(second from {column}) * 1000000 as bigint)) / 1e6D")


def camera_of_file(name: Column) -> Column:
    """Camera of a recording's file name such as ``.../C3_20261014T103000.mp4``."""
    return F.nullif(F.regexp_extract(name, r"([^/_]+)_[^/]*$", 1), F.lit(""))


def start_of_file(name: Column) -> Column:
    """Start in epoch seconds (UTC) of a recording's file name."""
    return F.unix_micros(F.try_to_timestamp(F.concat(F.regexp_extract(name, r"_([0-9]{8}T?[0-9]{6})[^/]*$", 1), F.lit("+0000")), F.lit("yyyyMMdd'T'HHmmssZ"))) / F.lit(1e6)


def options(text: Column) -> Column:
    """Map of ``k=v,k=v``."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def foot_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def frame_time(start: Column, frame: Column, fps: float, clock_offset: float = 0.0) -> Column:
    return start + frame / F.lit(fps) + F.lit(clock_offset)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """Unit vector; a norm below 1e-9 counts as 1e-9."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the dot product; for unit vectors."""
    return F.lit(1.0) - dot(a, b)


def time_grid(start: Column, end: Column, step: float) -> Column:
    """start, start + step, ... below end, then end itself."""
    n = F.ceil((end - start) / F.lit(step)).cast("int")
    grid = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * F.lit(step))).otherwise(F.array().cast("array<double>"))
    return F.array_distinct(F.concat(grid, F.array(end)))


def rounded(value: Column, places: int) -> Column:
    """Half away from zero on the decimal value, as SQL's numeric does."""
    return F.round(value.cast("decimal(18,6)"), places)


def risk_level(probability: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    """HIGH, MEDIUM or LOW; PENDING where there is no probability yet."""
    return F.when(probability.isNull(), "PENDING").when(probability >= high, "HIGH").when(probability >= medium, "MEDIUM").otherwise("LOW")
