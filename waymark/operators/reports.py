"""The report queries over visits, route times and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalar import rounded


def near_hidden(visits: DataFrame, edges: DataFrame, hidden: str, t: float, window: float) -> DataFrame:
    """Visits on paths that lead into or out of the hidden one, overlapping [t - window, t + window]."""
    beside = edges.where(F.col("to_path") == hidden).select(F.col("from_path").alias("path_id")).union(edges.where(F.col("from_path") == hidden).select("to_path")).distinct()
    found = visits.where((F.col("exit_ts") >= t - window) & (F.col("enter_ts") <= t + window)).join(F.broadcast(beside), "path_id", "left_semi")
    return found.select("person_id", "path_id", rounded(F.col("enter_ts"), 1).alias("first_seen"), rounded(F.col("exit_ts"), 1).alias("last_seen"), "n_obs").orderBy("person_id", "first_seen")


def person_timeline(visits: DataFrame, person_id: int) -> DataFrame:
    one = visits.where(F.col("person_id") == person_id)
    return one.select("visit_idx", "path_id", rounded(F.col("enter_ts"), 1).alias("enter_s"), rounded(F.col("exit_ts"), 1).alias("exit_s"), rounded(F.col("exit_ts") - F.col("enter_ts"), 1).alias("stay_s"), "n_obs").orderBy("visit_idx")


def anchor_sightings(anchored: DataFrame) -> DataFrame:
    return anchored.select("person_id", F.col("a").alias("last_path"), rounded(F.col("ta"), 1).alias("last_ts"), F.col("b").alias("next_path"), rounded(F.col("tb"), 1).alias("next_ts"), rounded(F.col("tb") - F.col("ta"), 1).alias("gap_s")).orderBy("person_id")


def path_statistics(paths: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits, mean and exact median stay of each path; paths without visits stay, with nulls.

    Stays are exact decimals. The median is read off counts by distinct stay, so no path's stays are gathered in one group.
    """
    from pyspark.sql import Window

    stays = visits.select(F.col("path_id").alias("id"), (F.col("exit_ts") - F.col("enter_ts")).cast("decimal(18,6)").alias("stay"))
    counts = stays.groupBy("id").agg(F.count("*").alias("visits"), F.sum("stay").alias("total"))
    by_stay = stays.groupBy("id", "stay").agg(F.count("*").alias("n"))
    slices = by_stay.withColumn("_slice", F.floor(F.col("stay") / 3600))
    per = slices.groupBy("id", "_slice").agg(F.sum("n").alias("in_slice"))
    per = per.withColumn("below", F.sum("in_slice").over(Window.partitionBy("id").orderBy("_slice")) - F.col("in_slice"))
    counted = per.join(counts, "id")
    low, high = F.floor((F.col("visits") - 1) / 2), F.floor(F.col("visits") / 2)
    middle = counted.where((F.col("below") <= high) & (F.col("below") + F.col("in_slice") > low)).select("id", "_slice", "below", "visits")
    w = Window.partitionBy("id", "_slice").orderBy("stay")
    placed = slices.join(middle, ["id", "_slice"]).withColumn("end", F.col("below") + F.sum("n").over(w)).withColumn("begin", F.col("end") - F.col("n"))
    median = placed.groupBy("id").agg(((F.min(F.when((F.col("begin") <= low) & (F.col("end") > low), F.col("stay"))) + F.min(F.when((F.col("begin") <= high) & (F.col("end") > high), F.col("stay")))).cast("double") / 2).alias("median_stay_s"))
    out = paths.select("id", "has_camera").join(counts, "id", "left").join(median, "id", "left")
    return out.select(F.col("id").alias("path_id"), "has_camera", F.coalesce("visits", F.lit(0)).alias("visits"), (F.col("total").cast("double") / F.col("visits")).alias("avg_stay_s"), "median_stay_s").orderBy("path_id")


def path_report(paths: DataFrame, visits: DataFrame) -> DataFrame:
    """The same to read, times to one digit."""
    found = path_statistics(paths, visits)
    return found.select("path_id", "has_camera", "visits", rounded(F.col("avg_stay_s"), 1).alias("avg_stay_s"), rounded(F.col("median_stay_s"), 1).alias("median_stay_s")).orderBy("path_id")


def route_times_near_hidden(route_times: DataFrame, edges: DataFrame, hidden: str) -> DataFrame:
    into = edges.where(F.col("to_path") == hidden).select("from_path").distinct()
    near = route_times.join(F.broadcast(into), "from_path", "left_semi")
    return near.select("from_path", "to_path", "via_hidden", "n_routes", rounded(F.col("min_seconds"), 0).alias("min_s"), rounded(F.col("max_seconds"), 0).alias("max_s")).orderBy(F.desc("via_hidden"), "from_path", "to_path")


def candidate_table(candidates: DataFrame) -> DataFrame:
    """Possible ones first, then by gap, unknown gaps last."""
    return candidates.orderBy((F.col("status") == "possible").desc(), F.col("gap_s").asc_nulls_last(), "person_id")


def candidate_report(candidates: DataFrame) -> DataFrame:
    """The candidates of one incident to read: names of the paths, times to one digit."""
    shown = candidate_table(candidates)
    return shown.select("person_id", F.col("a").alias("last_path"), rounded(F.col("ta"), 1).alias("last_ts"), F.col("b").alias("next_path"), rounded(F.col("tb"), 1).alias("next_ts"), rounded(F.col("gap_s"), 1).alias("gap_s"), rounded(F.col("min_crossing_s"), 0).alias("min_crossing_s"), "status")


def status_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("incident_id", "status").agg(F.count("*").alias("people")).orderBy("incident_id", F.desc("people"), "status")
