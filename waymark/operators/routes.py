"""Walking-time bounds between paths, and the time gaps that cameras' positions allow."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.config import SiteParams
from waymark.session import saved
from waymark.sources.graph import PathGraph


def routes(graph: PathGraph, together: int = 6) -> DataFrame:
    """from_path, to_path, via_hidden, length_m, n_routes: simple routes by the set of paths between, whatever their order.

    Length and hidden path depend on that set alone, so all orders of it are one row with their number. Sets grow by one path
    a level; a level is an aggregate of the one before. Every ``together`` levels are stored, until no route goes on.
    """
    steps = graph.edges.where("from_path <> to_path").groupBy("from_path", "to_path").agg(F.count("*").alias("_n"))
    onward = steps.join(graph.paths.select(F.col("id").alias("from_path"), F.col("length_m").alias("_m")), "from_path").select(F.col("from_path").alias("to_path"), F.col("to_path").alias("_next"), "_n", "_m")
    level = steps.select("from_path", "to_path", F.array().cast("array<string>").alias("between"), F.lit(0.0).alias("length_m"), F.col("_n").alias("n_routes"))
    found, size, most = None, 0, graph.paths.count()  # size: paths between
    while True:
        levels = [level]
        while size < most and len(levels) <= together:
            free = ~F.array_contains("between", F.col("_next")) & (F.col("_next") != F.col("from_path"))
            longer = levels[-1].join(F.broadcast(onward), "to_path").where(free)  # the edges of the network
            longer = longer.select("from_path", F.col("_next").alias("to_path"), F.array_sort(F.array_append("between", F.col("to_path"))).alias("between"), (F.col("length_m") + F.col("_m")).alias("length_m"), (F.col("n_routes") * F.col("_n")).alias("n_routes"))
            levels.append(longer.groupBy("from_path", "to_path", "between").agg(F.min("length_m").alias("length_m"), F.sum("n_routes").alias("n_routes")))
            size += 1
        done = saved(functools.reduce(DataFrame.unionByName, levels), "routes")
        level = done.where(F.size("between") == size)
        ended = size >= most or not level.take(1)
        part = done if ended else done.where(F.size("between") < size)  # the last level comes again as the first of the next ones
        found = part if found is None else found.unionByName(part)
        if ended:
            break
    return found.select("from_path", "to_path", F.array_contains("between", graph.site.hidden).alias("via_hidden"), "length_m", "n_routes")


def build_route_times(graph: PathGraph) -> DataFrame:
    """from_path, to_path, via_hidden, n_routes, min_seconds, max_seconds."""
    site = graph.site
    return routes(graph).groupBy("from_path", "to_path", "via_hidden").agg(F.sum("n_routes").alias("n_routes"), (F.min("length_m") / site.v_max).alias("min_seconds"), (F.max("length_m") / site.v_min).alias("max_seconds"))


def topology_intervals(graph: PathGraph, same_camera: bool = True) -> DataFrame:
    """cam_a, cam_b, lo, hi: one interval of allowed gaps for each distinct route length; pairs without a route have none."""
    site: SiteParams = graph.site
    cams = graph.camera_table()
    a, b = cams.select(F.col("id").alias("cam_a"), F.col("path_id").alias("from_path")), cams.select(F.col("id").alias("cam_b"), F.col("path_id").alias("to_path"))
    lengths = routes(graph).select("from_path", "to_path", "length_m").distinct()
    apart = lengths.join(F.broadcast(a), "from_path").join(F.broadcast(b), "to_path").select("cam_a", "cam_b", (F.col("length_m") / site.v_max - site.jitter).alias("lo"), (F.col("length_m") / site.v_min + site.slack).alias("hi"))
    if not same_camera:
        return apart
    return apart.unionByName(cams.select(F.col("id").alias("cam_a"), F.col("id").alias("cam_b"), F.lit(-site.jitter).alias("lo"), F.lit(2.0 * site.slack).alias("hi")))


def horizon(intervals: DataFrame) -> DataFrame:
    """max_gap: the longest gap that any pair allows."""
    return intervals.agg(F.max("hi").alias("max_gap"))
