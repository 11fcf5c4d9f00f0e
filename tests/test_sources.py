"""Files, the graph document, scalar functions, the stream of visits."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from waymark.functions import scalar
from waymark.operators import identity, tracks
from waymark.plans import schema
from waymark.plans.config import SiteParams
from waymark.sources import files, graph
from waymark.streaming.visits import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalar.person_label(lit(0))) == "Person_0001"
    assert one(spark, scalar.trailing_number(lit("Person_0042 "))) == 42
    assert one(spark, scalar.trailing_number(lit(None).cast("string"))) is None
    with pytest.raises(PySparkException):
        one(spark, scalar.trailing_number(lit("nobody")))
    for text, seconds in (("12.5", 12.5), ("1970-01-02T00:00:00", 86400.0), ("1970-01-01 00:00:10Z", 10.0), ("1970-01-01T02:00:00+02:00", 0.0), ("1970-01-02", 86400.0), ("soon", None)):
        assert one(spark, scalar.epoch_seconds(lit(text))) == seconds, text
    assert one(spark, scalar.camera_of_file(lit("a/b/C3_20261014T103000.mp4"))) == "C3"
    assert one(spark, scalar.start_of_file(lit("a/b/C3_19700102T000001.mp4"))) == 86401.0
    assert one(spark, scalar.options(lit("a=1,b=2"))) == {"a": "1", "b": "2"}
    assert one(spark, scalar.frame_time(lit(10.0), lit(50), 25.0, 1.0)) == 13.0
    assert [one(spark, c) for c in scalar.foot_point(lit(2.0), lit(4.0), lit(9.0))] == [3.0, 9.0]
    assert one(spark, scalar.time_grid(lit(0.0), lit(4.0), 2.0)) == [0.0, 2.0, 4.0]
    assert one(spark, scalar.time_grid(lit(1.0), lit(1.0), 2.0)) == [1.0]
    assert [one(spark, scalar.risk_level(lit(p).cast("double"))) for p in (0.8, 0.5, 0.49, None)] == ["HIGH", "MEDIUM", "LOW", "PENDING"]
    assert float(one(spark, scalar.rounded(lit(0.25), 1))) == 0.3


def test_graph_document(spark, tmp_path):
    doc = {"hidden_path": "H", "paths": {"A": {"length_m": 5.0, "camera": "c"}, "H": {"length_m": 7.0, "camera": None}}, "edges": [["A", "H"]], "entries": ["A"], "walking_speed_bounds_mps": [0.5, 2.0], "time_slack_s": 9.0}
    (tmp_path / "graph.json").write_text(json.dumps(doc))
    g = graph.read_graph(spark, str(tmp_path / "graph.json"))
    assert (g.site.hidden, g.site.v_min, g.site.v_max, g.site.slack) == ("H", 0.5, 2.0, 9.0)
    assert {tuple(r) for r in g.path_table().collect()} == {("A", 5.0, True), ("H", 7.0, False)}
    assert [tuple(r) for r in g.edges.collect()] == [("A", "H")]
    assert [tuple(r) for r in g.camera_table().collect()] == [("c", "A")]


def test_tables_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("C1", 1, "Person_1"), ("C2", 2, None)], schema.TABLES["identity_labels"])
    files.write_csv(rows, f"{tmp_path}/labels")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/labels", "identity_labels").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    obs = spark.createDataFrame([(1, "sim"), (2, "track")], "id long, source string")
    files.replace_source(obs, f"{tmp_path}/obs")
    files.replace_source(spark.createDataFrame([(3, "track")], "id long, source string"), f"{tmp_path}/obs")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/obs").collect()} == {(1, "sim"), (3, "track")}
    files.replace_source(obs.where("false"), f"{tmp_path}/obs", ["track", "never seen", "a/b=c"])
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/obs").collect()} == {(1, "sim")}
    files.replace_source(spark.createDataFrame([(4, "a/b=c"), (5, "other")], "id long, source string"), f"{tmp_path}/obs", ["a/b=c"])
    files.replace_source(obs.where("false"), f"{tmp_path}/obs", ["sim"])
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/obs").collect()} == {(4, "a/b=c")}
    files.replace_source(obs.where("false"), f"{tmp_path}/obs", ["a/b=c"])
    assert spark.read.schema("id long, source string").parquet(f"{tmp_path}/obs").count() == 0
    files.append(obs, f"{tmp_path}/flat")
    files.append(obs, f"{tmp_path}/flat")
    assert spark.read.parquet(f"{tmp_path}/flat").count() == 4
    files.overwrite(obs, f"{tmp_path}/flat")
    assert spark.read.parquet(f"{tmp_path}/flat").count() == 2


def test_query_files(spark, tmp_path):
    (tmp_path / "q.sql").write_text("-- a :comment\nSELECT cast('1' AS int) + :T AS x, 'a%' AS y WHERE :W > 1.5;\n")
    found = files.run_sql_file(spark, str(tmp_path / "q.sql"), {"T": files.typed_param("4"), "W": files.typed_param("2.5")}).first()
    assert (found["x"], found["y"]) == (5, "a%")
    assert [files.typed_param(x) for x in ("4", "4.5", "P4")] == [4, 4.5, "P4"]


def test_crops_are_listed_by_track(spark, tmp_path):
    for name in ("C1/7/1.jpg", "C1/7/2.jpg", "C2/8/1.jpg", "C2/8/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = {(r["camera_id"], r["track_id"]): len(r["files"]) for r in files.crops(spark, str(tmp_path)).collect()}
    assert found == {("C1", 7): 2, ("C2", 8): 1}


def test_violations_are_found(spark):
    paths = spark.createDataFrame([("A",), ("A",)], "id string")
    edges = spark.createDataFrame([("A", "B")], "from_path string, to_path string")
    risk = spark.createDataFrame([("HIGH",), ("odd",)], "level string")
    found = {(r["table"], r["rule"]): r["n"] for r in schema.violations({"paths": paths, "path_edges": edges, "risk_scores": risk}).collect()}
    assert found == {("paths", "key id"): 1, ("path_edges", "to_path in paths"): 1, ("risk_scores", "level in ('HIGH', 'MEDIUM', 'LOW', 'PENDING')"): 1}
    with pytest.raises(ValueError, match="nothing"):
        schema.require(paths, ["id", "nothing"], "paths")


def test_stream_of_visits(spark, tmp_path):
    rows = spark.createDataFrame([(1, "P1", "2026-01-01 00:00:00"), (1, "P1", "2026-01-01 00:04:00"), (1, "P1", "2026-01-01 00:20:00"), (2, "P2", "2026-01-01 03:00:00")], "person_id long, path_id string, time string")
    rows.withColumn("time", F.col("time").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("person_id long, path_id string, time timestamp").parquet(f"{tmp_path}/in")
    query = sessions(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = sorted((r["person_id"], r["n_obs"]) for r in spark.table("found").collect())
    assert found == [(1, 1), (1, 2)]  # the last one is still open


def test_loading_helpers(spark, tmp_path):
    seen = spark.createDataFrame([(5, 9.0), (2, 1.0), (5, 3.0), (1, 7.0)], "person_id long, ts double")
    files.write_sightings(seen, f"{tmp_path}/seen", 2)
    back = spark.read.parquet(f"{tmp_path}/seen")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seen.collect()))
    parts = [[tuple(r) for r in part] for part in back.rdd.glom().collect()]
    assert all(part == sorted(part) for part in parts)
    files.overwrite(seen.limit(1), f"{tmp_path}/seen")
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 1
    assert files.limited(spark.range(100)).count() == 40
    assert [tuple(r) for r in files.persons_of(seen).orderBy("id").collect()] == [(1, "Person_0002"), (2, "Person_0003"), (5, "Person_0006")]
    rows = spark.createDataFrame([(0, 4.5)], "incident_id int, time double")
    assert [tuple(r) for r in files.rebased_incidents(rows, "H").collect()] == [(1, "H", 4.5, 1.0, "simulated")]
    g = graph.graph_of(spark, [("A", 5.0, "c"), ("H", 7.0, None)], [("A", "H")], SiteParams())
    raw = spark.createDataFrame([(3, "A", 1.5), (3, "H", 2.5)], schema.TABLES["raw_sightings"])
    assert sorted((r["person_id"], r["camera_id"], r["path_id"], r["ts"], r["source"]) for r in files.raw_sightings(raw, g).fillna("none").collect()) == [(3, "c", "A", 1.5, "sim"), (3, "none", "H", 2.5, "sim")]
    assert files.raw_sightings(raw, g).select("id").distinct().count() == 2
    assert {r["key"] for r in g.meta_table().collect()} == {"hidden_path", "v_min_mps", "v_max_mps", "time_slack_s"}
    known = {r["key"]: r["value"] for r in g.meta_table("sim", 0.95, 2.0, "easy").collect()}
    assert len(known) == 8 and (known["source"], known["p_detect"], known["obs_period_s"], known["preset"]) == ("sim", "0.95", "2.0", "easy")
    graph.write_graph(g, f"{tmp_path}/doc")
    again = graph.read_graph(spark, f"{tmp_path}/doc")
    assert again.site.hidden == g.site.hidden and sorted(map(tuple, again.paths.collect())) == sorted(map(tuple, g.paths.collect())) and [tuple(r) for r in again.edges.collect()] == [("A", "H")]


def test_several_files_and_a_glob(spark, tmp_path):
    """Files of several cameras as one table, by a glob and by a list."""
    rows = spark.createDataFrame([("C1", 1, "Person_1"), ("C2", 2, "Person_2"), ("C3", 3, None)], schema.TABLES["identity_labels"])
    for k, camera in enumerate(("C1", "C2", "C3")):
        files.write_csv(rows.where(F.col("camera_id") == camera), f"{tmp_path}/tracks_{camera}")
    whole = sorted(map(tuple, rows.collect()), key=repr)
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/tracks_*", "identity_labels").collect()), key=repr) == whole
    assert len(files.read_csv(spark, [f"{tmp_path}/tracks_C1", f"{tmp_path}/tracks_C3"], "identity_labels").collect()) == 2


def test_tracks_without_an_embedding(spark):
    line = spark.createDataFrame([("C1", 1), ("C1", 2), ("C2", 1)], "camera_id string, track_id int")
    have = spark.createDataFrame([("C1", 1), ("C1", 1), ("C3", 9)], "camera_id string, track_id int")
    assert tuple(tracks.embedding_coverage(line, have, ["camera_id", "track_id"]).first()) == (3, 1, 2)
    kept, missing = tracks.with_embeddings(line, have.distinct(), ["camera_id", "track_id"])
    assert (kept.count(), missing.count()) == (1, 2)


def test_presence_and_report_of_identities(spark):
    found = spark.createDataFrame([(1, 7, 1.0, 2, 2), (2, 7, 0.5, 2, 3), (3, None, None, None, 1)], "global_person_id int, true_id int, purity double, n_labelled int, n_tracks int")
    sheet = spark.createDataFrame([(7, "P1", 0.0, 5.0), (8, "P2", 1.0, 2.0)], "person_no int, path_id string, start_time double, end_time double")
    assert sorted(map(tuple, identity.presence(found, sheet).collect())) == [(1, "P1", 0.0, 5.0), (2, "P1", 0.0, 5.0)]
    assert tuple(identity.identity_report(found).first()) == (3, 2, 1, 0.75, 1)
