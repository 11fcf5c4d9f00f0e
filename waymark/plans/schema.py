"""Schemas of the tables, spelled out so that no reader infers types, and checks that Spark does not enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "run_meta": "key string, value string",
    "persons": "id int, label string",
    "paths": "id string, length_m double, has_camera boolean",
    "path_edges": "from_path string, to_path string",
    "cameras": "id string, path_id string",
    "raw_sightings": "person_id long, path_id string, timestamp double",
    "observations": "id long, person_id long, camera_id string, path_id string, ts double, source string",
    "visits": "person_id long, visit_idx int, path_id string, enter_ts double, exit_ts double, n_obs long",
    "trajectories": "person_id long, path_id string, start_time double, end_time double, source string, confidence double",
    "route_times": "from_path string, to_path string, via_hidden boolean, n_routes long, min_seconds double, max_seconds double",
    "incidents": "id int, affected_path_id string, start_time double, severity double, status string",
    "predictions": "incident_id int, person_id long, model_name string, probability double, route string, entry double, exit double",
    "risk_scores": "incident_id int, person_id long, probability double, severity double, risk_score double, level string, status string",
    "ground_truth_presence": "person_id long, path_id string, start_time double, end_time double",
    "ground_truth_labels": "incident_id int, person_id long, in_hidden int",
    "detections": "camera_id string, track_id int, frame int, timestamp double, x1 double, y1 double, x2 double, y2 double, foot_x double, foot_y double, confidence double",
    "track_summary": "camera_id string, track_id int, start_time double, end_time double, n_frames long, mean_conf double, entry_x double, entry_y double, exit_x double, exit_y double",
    "track_embeddings": "camera_id string, track_id int, emb array<float>",
    "timeline": "global_person_id int, label string, camera_id string, path_id string, track_id int, start_time double, end_time double, match_dist double",
    "identity_labels": "camera_id string, track_id int, person_id string",
    "route_sheet": "person string, path_id string, enter string, exit string",
}

KEYS = {"run_meta": ["key"], "persons": ["id"], "paths": ["id"], "path_edges": ["from_path", "to_path"], "cameras": ["id"], "observations": ["id"], "visits": ["person_id", "visit_idx"], "route_times": ["from_path", "to_path", "via_hidden"], "incidents": ["id"], "ground_truth_labels": ["incident_id", "person_id"]}
REFERENCES = [("path_edges", "from_path", "paths", "id"), ("path_edges", "to_path", "paths", "id"), ("cameras", "path_id", "paths", "id"), ("observations", "person_id", "persons", "id"), ("observations", "path_id", "paths", "id"), ("visits", "path_id", "paths", "id")]
CHECKS = {"trajectories": "source in ('observed', 'inferred')", "predictions": "probability between 0 and 1", "risk_scores": "level in ('HIGH', 'MEDIUM', 'LOW', 'PENDING')"}


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """``df`` itself if it has the columns; otherwise a ValueError that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the column(s) {', '.join(missing)}")
    return df


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, n) for each broken key, reference and check among the tables given; empty if all hold."""
    spark = next(iter(tables.values())).sparkSession
    found = spark.createDataFrame([], "table string, rule string, n long")
    add = lambda t, rule, df: found.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.lit(rule).alias("rule"), "n"))
    for t, key in KEYS.items():
        if t in tables:
            found = add(t, f"key {', '.join(key)}", tables[t].groupBy(*key).count().where("count > 1"))
    for t, c, other, oc in REFERENCES:
        if t in tables and other in tables:
            target = tables[other].select(F.col(oc).alias("_key"))
            found = add(t, f"{c} in {other}", tables[t].where(F.col(c).isNotNull()).join(target, F.col(c) == F.col("_key"), "left_anti"))
    for t, rule in CHECKS.items():
        if t in tables:
            found = add(t, rule, tables[t].where(f"not ({rule})"))
    return found.where("n > 0")
