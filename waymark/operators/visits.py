"""Visits: runs of one person's sightings on one path, with short label flips repaired.

Sightings are first folded inside slices of time, so one person with very many sightings is many small groups; only the
folded runs are brought together by person. All repair rounds work on runs and share that one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.config import VisitParams

ORDER = ("enter_ts", "enter_id")


def _new_run(window, path: str, begin: str, end: str, gap: float) -> Column:
    """Whether a row does not continue the one before it: another path (null-safe), or a silence above the gap."""
    before = F.lag(path).over(window)
    first = F.row_number().over(window) == 1
    return first | ~F.col(path).eqNullSafe(before) | F.coalesce(F.col(begin) - F.lag(end).over(window) > gap, F.lit(False))


def _merged(runs: DataFrame, gap: float, keys: list[str]) -> DataFrame:
    """Runs that continue each other as one."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    marked = runs.withColumn("_new", _new_run(w, "path_id", "enter_ts", "exit_ts", gap).cast("int"))
    marked = marked.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_no").agg(F.min("path_id").alias("path_id"), F.min("enter_ts").alias("enter_ts"), F.min_by("enter_id", F.struct("enter_ts", "enter_id")).alias("enter_id"), F.max("exit_ts").alias("exit_ts"), F.sum("n_obs").alias("n_obs")).drop("_no")


def runs(observations: DataFrame, gap: float, slice_s: float = 86400.0) -> DataFrame:
    """Unrepaired runs by person: person_id, path_id, enter_ts, enter_id, exit_ts, n_obs."""
    start = observations.select("person_id", "path_id", F.col("ts").alias("enter_ts"), F.col("id").alias("enter_id"), F.col("ts").alias("exit_ts"), F.lit(1).cast("long").alias("n_obs"))
    sliced = start.withColumn("_slice", F.floor(F.col("enter_ts") / slice_s))
    return _merged(_merged(sliced, gap, ["person_id", "_slice"]).drop("_slice"), gap, ["person_id"])


def repaired(found: DataFrame, params: VisitParams) -> DataFrame:
    """Flips relabelled, all at once in each round, from the neighbours before the round; then runs merge again.

    A flip lies between two visits of one same other path, lasts at most flip_s, has at most flip_obs sightings, and the
    neighbours are at most 2 flip_s apart. A round without flips changes nothing, so the rounds need no count between.
    """
    w = Window.partitionBy("person_id").orderBy(*ORDER)
    for _ in range(params.rounds):
        before, after = F.lag("path_id").over(w), F.lead("path_id").over(w)
        apart = F.lead("enter_ts").over(w) - F.lag("exit_ts").over(w)
        flip = (before == after) & (before != F.col("path_id")) & (F.col("exit_ts") - F.col("enter_ts") <= params.flip_s) & (F.col("n_obs") <= params.flip_obs) & (apart <= 2 * params.flip_s)
        found = _merged(found.withColumn("path_id", F.when(flip, before).otherwise(F.col("path_id"))), params.split_gap, ["person_id"])
    return found


def build_visits(observations: DataFrame, params: VisitParams = VisitParams(), slice_s: float = 86400.0) -> DataFrame:
    """person_id, visit_idx (from 1), path_id, enter_ts, exit_ts, n_obs of sightings (id, person_id, path_id, ts).

    Sightings are ordered by (ts, id). A null path is a path of its own; sightings without a time come first and never
    split. ``rounds=0`` gives the unrepaired visits.
    """
    found = repaired(runs(observations, params.split_gap, slice_s), params)
    w = Window.partitionBy("person_id").orderBy(*ORDER)
    return found.withColumn("visit_idx", F.row_number().over(w)).select("person_id", "visit_idx", "path_id", "enter_ts", "exit_ts", "n_obs")


def trajectories(visits: DataFrame) -> DataFrame:
    """Visits as observed trajectory rows of full confidence."""
    return visits.select("person_id", "path_id", F.col("enter_ts").alias("start_time"), F.col("exit_ts").alias("end_time"), F.lit("observed").alias("source"), F.lit(1.0).alias("confidence"))


def repeats(visits: DataFrame, gap: float) -> DataFrame:
    """Neighbouring visits of one path without a silence between, which repair should have merged."""
    w = Window.partitionBy("person_id").orderBy("visit_idx")
    return visits.withColumn("next_path", F.lead("path_id").over(w)).withColumn("silence", F.lead("enter_ts").over(w) - F.col("exit_ts")).where((F.col("next_path") == F.col("path_id")) & (F.col("silence") <= gap))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of only one of two tables, with ``side`` left or right; keys are compared null-safe."""
    a, b = left.select(*keys, F.lit(1).alias("_l")).distinct(), right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(1).alias("_r")).distinct()
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = same if match is None else match & same
    both = a.join(b, match, "full_outer").where("_l is null or _r is null")
    return both.select(*(F.when(F.col("_l").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys), F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))
