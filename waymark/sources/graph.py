"""The path network: a JSON document as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.config import SiteParams

SCHEMA = "description string, hidden_path string, paths map<string, struct<length_m: double, camera: string>>, edges array<array<string>>, entries array<string>, walking_speed_bounds_mps array<double>, time_slack_s double"


@dataclass(frozen=True)
class PathGraph:
    """paths (id, length_m, camera), edges (from_path, to_path) and the site's settings."""

    paths: DataFrame
    edges: DataFrame
    site: SiteParams

    def path_table(self) -> DataFrame:
        return self.paths.select("id", "length_m", F.col("camera").isNotNull().alias("has_camera"))

    def camera_table(self) -> DataFrame:
        return self.paths.where("camera is not null").select(F.col("camera").alias("id"), F.col("id").alias("path_id"))

    def meta_table(self, source: str | None = None, p_detect: float | None = None, obs_period_s: float | None = None, preset: str | None = None) -> DataFrame:
        """key, value of the site's settings and, where they are known, of the run that gave the sightings."""
        settings = {"hidden_path": self.site.hidden, "v_min_mps": self.site.v_min, "v_max_mps": self.site.v_max, "time_slack_s": self.site.slack, "source": source, "p_detect": p_detect, "obs_period_s": obs_period_s, "preset": preset}
        return self.paths.sparkSession.createDataFrame([(k, str(v)) for k, v in settings.items() if v is not None], "key string, value string")


def write_graph(graph: PathGraph, path: str) -> None:
    """The network as a JSON document of one line, which :func:`read_graph` reads. A network is small, whatever it was mined from."""
    site = graph.site
    paths = graph.paths.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("length_m", "camera"))))).alias("paths"))
    edges = graph.edges.agg(F.array_sort(F.collect_list(F.array("from_path", "to_path"))).alias("edges"))
    head = [F.lit(site.hidden).alias("hidden_path"), F.array(F.lit(site.v_min), F.lit(site.v_max)).alias("walking_speed_bounds_mps"), F.lit(site.slack).alias("time_slack_s")]
    both = paths.join(edges)  # one row each
    both.select(F.to_json(F.struct(*head, "paths", "edges")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> PathGraph:
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    head = doc.select("hidden_path", "walking_speed_bounds_mps", "time_slack_s").first()
    paths = doc.select(F.explode("paths").alias("id", "p")).select("id", "p.length_m", "p.camera")
    edges = doc.select(F.explode("edges").alias("e")).select(F.get("e", F.lit(0)).alias("from_path"), F.get("e", F.lit(1)).alias("to_path"))
    low, high = head["walking_speed_bounds_mps"]
    return PathGraph(paths, edges, SiteParams(head["hidden_path"], low, high, head["time_slack_s"]))


def graph_of(spark: SparkSession, paths: list[tuple[str, float, str | None]], edges: list[tuple[str, str]], site: SiteParams) -> PathGraph:
    return PathGraph(spark.createDataFrame(paths, "id string, length_m double, camera string"), spark.createDataFrame(edges, "from_path string, to_path string"), site)
