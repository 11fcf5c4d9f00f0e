"""The path network from sightings: which paths follow each other, and how long each one is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.config import SiteParams
from waymark.sources.graph import PathGraph

#: Slice of rows that have no time: before all others.
TIMELESS = -(1 << 62)


def sliced(sightings: DataFrame, slice_s: float) -> DataFrame:
    """Adds _slice: rows of one person and slice of time are one group, however many rows the person has."""
    return sightings.withColumn("_slice", F.coalesce(F.floor(F.col("ts") / slice_s), F.lit(TIMELESS)))


def with_neighbours(sightings: DataFrame, slice_s: float = 86400.0) -> DataFrame:
    """Adds _slice, before and after: (path_id, ts) of the person's sighting next to each in order of (ts, id), else null.

    Neighbours are found inside slices; only the slices' first and last sightings are put in order by person.
    """
    rows = sliced(sightings, slice_s)
    w = Window.partitionBy("person_id", "_slice").orderBy("ts", "id")
    here, key = F.struct("path_id", "ts"), F.struct("ts", "id")
    inside = rows.withColumn("_b", F.lag(here).over(w)).withColumn("_a", F.lead(here).over(w))
    ends = rows.groupBy("person_id", "_slice").agg(F.min_by(here, key).alias("_first"), F.max_by(here, key).alias("_last"))
    by = Window.partitionBy("person_id").orderBy("_slice")
    seams = ends.select(F.col("person_id").alias("_p"), F.col("_slice").alias("_s"), F.lag("_last").over(by).alias("_before"), F.lead("_first").over(by).alias("_after"))
    joined = inside.join(seams, F.col("person_id").eqNullSafe(F.col("_p")) & (F.col("_slice") == F.col("_s")))
    return joined.select(*sightings.columns, "_slice", F.coalesce("_b", "_before").alias("before"), F.coalesce("_a", "_after").alias("after"))


def run_visits(sightings: DataFrame, slice_s: float = 86400.0) -> DataFrame:
    """Runs of one path without regard to silences: person_id, visit_no (from 1), path_id, start_time, end_time.

    A run begins where the path differs from the one before. Slices count their beginnings, the counts before a slice are
    added, and the parts that a run has in several slices meet in one aggregate.
    """
    rows = with_neighbours(sightings, slice_s)
    rows = rows.withColumn("_new", (F.col("before").isNull() | ~F.col("path_id").eqNullSafe(F.col("before")["path_id"])).cast("long"))
    begun = rows.groupBy("person_id", "_slice").agg(F.sum("_new").alias("_n"))
    by = Window.partitionBy("person_id").orderBy("_slice")
    offsets = begun.select(F.col("person_id").alias("_p"), F.col("_slice").alias("_s"), (F.sum("_n").over(by) - F.col("_n")).alias("_offset"))
    w = Window.partitionBy("person_id", "_slice").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_in", F.sum("_new").over(w)).join(offsets, F.col("person_id").eqNullSafe(F.col("_p")) & (F.col("_slice") == F.col("_s")))
    numbered = counted.withColumn("visit_no", F.col("_offset") + F.col("_in"))
    return numbered.groupBy("person_id", "visit_no").agg(F.min("path_id").alias("path_id"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))


def exact_quantile(values: DataFrame, key: str, value: str, q: float, width: float) -> DataFrame:
    """key, quantile: the smallest value that at least q of its key's values do not exceed.

    Values are counted, then counted by slices of ``width``; only the slice where the quantile lies is put in order.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n")).withColumn("_slice", F.floor(F.col(value) / width))
    slices = counts.groupBy(key, "_slice").agg(F.sum("_n").alias("_in"))
    up, whole = Window.partitionBy(key).orderBy("_slice"), Window.partitionBy(key)
    slices = slices.withColumn("_below", F.sum("_in").over(up) - F.col("_in")).withColumn("_rank", F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("_in").over(whole) * F.lit(q))))
    chosen = slices.where((F.col("_below") < F.col("_rank")) & (F.col("_below") + F.col("_in") >= F.col("_rank"))).select(key, "_slice", "_below", "_rank")
    w = Window.partitionBy(key, "_slice").orderBy(value)
    placed = counts.join(chosen, [key, "_slice"]).withColumn("_end", F.col("_below") + F.sum("_n").over(w))
    return placed.where(F.col("_end") >= F.col("_rank")).groupBy(key).agg(F.min(value).alias("quantile"))


def departures(sightings: DataFrame, slice_s: float = 86400.0) -> DataFrame:
    """from_path, to_path, seconds of every sighting after which the same person is next seen on another path."""
    rows = with_neighbours(sightings.where("path_id is not null and ts is not null"), slice_s)
    left = rows.where(F.col("after")["path_id"] != F.col("path_id"))
    return left.select(F.col("path_id").alias("from_path"), F.col("after")["path_id"].alias("to_path"), (F.col("after")["ts"] - F.col("ts")).alias("seconds"))


def mined_graph(sightings: DataFrame, site: SiteParams, support: float = 0.25, speed: float = 1.0, quantile: float = 0.5, camera: Column | None = None, slice_s: float = 86400.0) -> PathGraph:
    """The network that sightings (id, person_id, path_id, ts; the hidden path surveyed too) show.

    An edge leads from a path to those that follow it in at least ``support`` of its departures. A path is as long as ``speed``
    (m/s) covers in the exact ``quantile`` of the seconds until the next path, in whole metres; paths that nobody leaves have
    length 0. Every path but the hidden one has a camera, named by ``camera`` (an expression over path_id; cam_ and the path).
    """
    left = departures(sightings, slice_s)
    pairs = left.groupBy("from_path", "to_path").agg(F.count("*").alias("n"))
    all_ = pairs.groupBy("from_path").agg(F.sum("n").alias("total"))
    edges = pairs.join(all_, "from_path").where(F.col("n") >= F.col("total") * support).select("from_path", "to_path")
    metres = exact_quantile(left, "from_path", "seconds", quantile, 3600.0).select(F.col("from_path").alias("id"), F.floor(F.col("quantile") * speed).cast("double").alias("length_m"))
    ids = sightings.select(F.col("path_id").alias("id")).where("id is not null").distinct()
    named = camera if camera is not None else F.concat(F.lit("cam_"), "path_id")
    paths = ids.join(metres, "id", "left").withColumn("path_id", F.col("id"))
    return PathGraph(paths.select("id", F.coalesce("length_m", F.lit(0.0)).alias("length_m"), F.when(F.col("id") != site.hidden, named).alias("camera")), edges, site)
