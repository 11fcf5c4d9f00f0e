"""Evaluation against truth that inference never reads. Only this package takes truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalar import rounded
from waymark.operators.candidates import in_window


def inside(incidents: DataFrame, presence: DataFrame, hidden: str) -> DataFrame:
    """(incident_id, person_id) distinct: persons on the hidden path at t, ends included. Stays are spread over hours that
    they touch, so that the containment join is an equi-join."""
    hour = lambda c: F.floor(c / 3600)
    stays = presence.where(F.col("path_id") == hidden).select("person_id", "start_time", "end_time", F.explode(F.sequence(hour(F.col("start_time")), hour(F.greatest("start_time", "end_time")))).alias("hour"))
    at = incidents.select("incident_id", "t", hour(F.col("t")).alias("hour"))
    return stays.join(at, "hour").where(F.col("t").between(F.col("start_time"), F.col("end_time"))).select("incident_id", "person_id").distinct()


def labels(incidents: DataFrame, observations: DataFrame, presence: DataFrame, hidden: str, window: float) -> DataFrame:
    """incident_id, person_id, in_hidden for persons sighted in [t - window, t + window)."""
    near = in_window(incidents, observations, window, closed=False)
    flagged = inside(incidents, presence, hidden).withColumn("_in", F.lit(1))
    return near.join(flagged, ["incident_id", "person_id"], "left").select("incident_id", "person_id", F.coalesce("_in", F.lit(0)).alias("in_hidden"))


def feasibility(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """By status: occupants, others, total, of candidates that have a label."""
    both = candidates.join(truth, ["incident_id", "person_id"])
    return both.groupBy("status").agg(F.sum("in_hidden").alias("truly_inside"), (F.count("*") - F.sum("in_hidden")).alias("not_inside"), F.count("*").alias("total")).orderBy(F.desc("total"), "status")


def visit_recall(presence: DataFrame, visits: DataFrame, paths: DataFrame, tolerance: float = 5.0, slice_s: float = 86400.0) -> DataFrame:
    """By filmed path: true stays, those that a visit overlaps within the tolerance, and their share in percent, to one digit.

    Stays and visits meet by person, path and the slices of time that they touch, so a busy person is many small groups."""
    stays = presence.join(F.broadcast(paths.where("has_camera").select(F.col("id").alias("path_id"))), "path_id", "left_semi")
    key = ["person_id", "path_id", "start_time", "end_time"]
    counted = stays.groupBy(*key).agg(F.count("*").alias("n"))
    touched = lambda a, b: F.explode(F.sequence(F.floor(a / slice_s), F.floor(F.greatest(a, b) / slice_s))).alias("_slice")
    sought = counted.select(*key, touched(F.col("start_time") - tolerance, F.col("end_time") + tolerance))
    there = visits.select("person_id", "path_id", "enter_ts", "exit_ts", touched(F.col("enter_ts"), F.col("exit_ts")))
    overlap = (F.col("enter_ts") <= F.col("end_time") + tolerance) & (F.col("exit_ts") >= F.col("start_time") - tolerance)
    found = sought.join(there, ["person_id", "path_id", "_slice"]).where(overlap).select(*key, F.lit(1).alias("hit")).distinct()
    flagged = counted.join(found, key, "left")
    by_path = flagged.groupBy("path_id").agg(F.sum("n").alias("true_stays"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("found"))
    return by_path.withColumn("pct_found", rounded(F.lit(100.0) * F.col("found") / F.col("true_stays"), 1).cast("double")).orderBy("path_id")


def identity_counts(timeline: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct identities and distinct true persons among labelled tracks."""
    both = timeline.join(known, ["camera_id", "track_id"])
    return both.agg(F.count_distinct("global_person_id").alias("n_identities"), F.count_distinct("person_id").alias("n_persons"))


def pairwise(assigned: DataFrame) -> DataFrame:
    """Pairwise precision, recall and F1 and counts of split and merged persons, of (global_id, true_id) rows. Pairs are
    counted from group sizes, never listed."""
    cells = assigned.groupBy("global_id", "true_id").agg(F.count("*").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"))
    by_id = cells.groupBy("global_id").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).agg(F.sum(pairs(F.col("n"))).alias("linked"), F.count_if(F.col("kinds") > 1).alias("merged"))
    by_true = cells.groupBy("true_id").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).agg(F.sum(pairs(F.col("n"))).alias("wanted"), F.count_if(F.col("kinds") > 1).alias("fragmented"))
    one = both.crossJoin(by_id).crossJoin(by_true)  # three single rows
    p, r = F.try_divide("tp", "linked"), F.try_divide("tp", "wanted")  # null where nothing is linked, or nothing was to be
    return one.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("tp"), F.col("linked") + F.col("wanted")).alias("f1"), "fragmented", "merged")


def label_rate(truth: DataFrame) -> DataFrame:
    """Incidents, labelled rows, occupants an incident on average."""
    per = truth.groupBy("incident_id").agg(F.sum("in_hidden").alias("n"), F.count("*").alias("rows"))
    return per.agg(F.count("*").alias("incidents"), F.sum("rows").alias("rows"), F.avg("n").alias("mean_inside"))
