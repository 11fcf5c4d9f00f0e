"""Who may have been on the hidden path: candidates, their anchor sightings, and whether the time between suffices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.config import SiteParams


def in_window(incidents: DataFrame, observations: DataFrame, window: float, closed: bool = True) -> DataFrame:
    """(incident_id, t, person_id), distinct: persons sighted in the window around each incident, without its last moment
    unless ``closed``.

    A band join as an equi-join: time is cut in buckets of the window's width and an incident looks in the at most three
    that its window touches.
    """
    bucket = lambda c: F.floor(c / window)
    spread = incidents.select("incident_id", "t", F.explode(F.sequence(bucket(F.col("t") - window), bucket(F.col("t") + window))).alias("bucket"))
    seen = observations.select("person_id", "ts", bucket(F.col("ts")).alias("bucket"))
    late = F.col("ts") <= F.col("t") + window if closed else F.col("ts") < F.col("t") + window
    near = seen.join(spread, "bucket").where((F.col("ts") >= F.col("t") - window) & late)
    return near.select("incident_id", "t", "person_id").distinct()


def anchors(candidates: DataFrame, observations: DataFrame, slice_s: float = 86400.0) -> DataFrame:
    """For each candidate the last sighting strictly before t (a, ta) and the first at or after it (b, tb), over the whole
    history. Ties in time go to the larger id before t, the smaller after.

    Each person's history is folded to the first and last sighting of every slice of time. A candidate meets the single
    sightings of its own slice only; beyond that the nearest slices that hold any have the answer.
    """
    cut = lambda c: F.floor(c / slice_s)
    seen = observations.where("ts is not null").select("person_id", "id", "path_id", "ts", cut(F.col("ts")).alias("_slice"))
    wanted = candidates.select("incident_id", "t", "person_id", cut(F.col("t")).alias("_slice"))
    sighting, key = F.struct("path_id", "ts"), F.struct("ts", "id")
    ends = seen.groupBy("person_id", "_slice").agg(F.min_by(sighting, key).alias("_first"), F.max_by(sighting, key).alias("_last"))
    asked = wanted.select("person_id", "_slice").distinct()
    w = Window.partitionBy("person_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("person_id").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    beside = ends.join(asked.withColumn("_asked", F.lit(True)), ["person_id", "_slice"], "full")
    beside = beside.withColumn("_before", F.last("_last", True).over(w)).withColumn("_after", F.last("_first", True).over(back)).where("_asked").select("person_id", "_slice", "_before", "_after")
    before = F.col("ts") < F.col("t")
    here = wanted.join(seen, ["person_id", "_slice"]).groupBy("incident_id", "t", "person_id").agg(F.max_by(sighting, F.when(before, key)).alias("_a"), F.min_by(sighting, F.when(~before, key)).alias("_b"))
    found = wanted.join(beside, ["person_id", "_slice"], "left").join(here, ["incident_id", "t", "person_id"], "left")
    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_after")
    return found.select("incident_id", "t", "person_id", a["path_id"].alias("a"), a["ts"].alias("ta"), b["path_id"].alias("b"), b["ts"].alias("tb"))


def classified(anchored: DataFrame, route_times: DataFrame, edges: DataFrame, site: SiteParams, upper_bound: bool = False) -> DataFrame:
    """Adds gap_s, min_crossing_s and status; the first class that applies wins.

    ``upper_bound`` (an extension, off by default) also rejects gaps above the slowest crossing plus slack.
    """
    via = route_times.where("via_hidden").select(F.col("from_path").alias("a"), F.col("to_path").alias("b"), F.col("min_seconds").alias("min_crossing_s"), F.col("max_seconds").alias("_slowest"))
    into = edges.where(F.col("to_path") == site.hidden).select(F.col("from_path").alias("a"), F.lit(True).alias("_into")).distinct()
    joined = anchored.join(F.broadcast(via), ["a", "b"], "left").join(F.broadcast(into), "a", "left").withColumn("gap_s", F.col("tb") - F.col("ta"))
    status = (
        F.when(F.col("ta").isNull(), "no sighting before")
        .when(F.col("tb").isNull() & F.col("_into").isNotNull(), "pending: may be inside, not seen again yet")
        .when(F.col("tb").isNull(), "no sighting after")
        .when(F.col("a") == F.col("b"), "same path before and after")
        .when(F.col("min_crossing_s").isNull(), "no route through hidden path")
        .when(F.col("gap_s") < F.col("min_crossing_s") - site.slack, "impossible: reached too fast")
    )
    if upper_bound:
        status = status.when(F.col("gap_s") > F.col("_slowest") + site.slack, "impossible: took too long")
    return joined.select("incident_id", "person_id", "a", "ta", "b", "tb", "gap_s", "min_crossing_s", status.otherwise("possible").alias("status"))


def incident_candidates(incidents: DataFrame, observations: DataFrame, route_times: DataFrame, edges: DataFrame, site: SiteParams, window: float = 900.0, upper_bound: bool = False) -> DataFrame:
    """All incidents (incident_id, t) at once; filter the incidents for a single one."""
    return classified(anchors(in_window(incidents, observations, window), observations), route_times, edges, site, upper_bound)


#: incident_candidates as a table function of SQL, with the window as an argument that has a default. The window's persons are
#: found through buckets of time, and Catalyst turns a lateral call into joins by incident: nothing is scanned anew for a row.
TABLE_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION incident_candidates(p_incident INT, p_win DOUBLE DEFAULT 900D)
RETURNS TABLE (person_id BIGINT, a STRING, ta DOUBLE, b STRING, tb DOUBLE, gap_s DOUBLE, min_crossing_s DOUBLE, status STRING)
RETURN
WITH spread AS (
  SELECT t, explode(sequence(CAST(floor((t - p_win) / p_win) AS BIGINT), CAST(floor((t + p_win) / p_win) AS BIGINT))) AS bucket
  FROM incidents WHERE incident_id = p_incident
), near AS (
  SELECT DISTINCT s.t, o.person_id FROM spread s
  JOIN observations o ON CAST(floor(o.ts / p_win) AS BIGINT) = s.bucket AND o.ts BETWEEN s.t - p_win AND s.t + p_win
), anchored AS (
  SELECT n.person_id, max(struct(o.ts, o.id, o.path_id)) FILTER (WHERE o.ts < n.t) AS before,
         min(struct(o.ts, o.id, o.path_id)) FILTER (WHERE o.ts >= n.t) AS after
  FROM near n JOIN observations o ON o.person_id = n.person_id GROUP BY n.person_id
), beside AS (
  SELECT DISTINCT from_path FROM path_edges WHERE to_path = (SELECT value FROM run_meta WHERE key = 'hidden_path')
)
SELECT x.person_id, before.path_id, before.ts, after.path_id, after.ts, after.ts - before.ts, r.min_seconds,
  CASE WHEN before IS NULL THEN 'no sighting before'
       WHEN after IS NULL AND e.from_path IS NOT NULL THEN 'pending: may be inside, not seen again yet'
       WHEN after IS NULL THEN 'no sighting after'
       WHEN before.path_id = after.path_id THEN 'same path before and after'
       WHEN r.min_seconds IS NULL THEN 'no route through hidden path'
       WHEN after.ts - before.ts < r.min_seconds - (SELECT CAST(value AS DOUBLE) FROM run_meta WHERE key = 'time_slack_s') THEN 'impossible: reached too fast'
       ELSE 'possible' END
FROM anchored x
LEFT JOIN route_times r ON r.from_path = before.path_id AND r.to_path = after.path_id AND r.via_hidden
LEFT JOIN beside e ON e.from_path = before.path_id
"""


def register_function(incidents: DataFrame, observations: DataFrame, route_times: DataFrame, edges: DataFrame, meta: DataFrame) -> None:
    """Makes ``incident_candidates(incident_id, window)`` known to the session's SQL, over views of these tables. The anchors
    read the whole histories of the window's persons; :func:`anchors` folds them first and is the way for long histories."""
    views = {"incidents": incidents.select("incident_id", "t"), "observations": observations.select("id", F.col("person_id").cast("long").alias("person_id"), "path_id", "ts"), "route_times": route_times, "path_edges": edges, "run_meta": meta}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    incidents.sparkSession.sql(TABLE_FUNCTION)
