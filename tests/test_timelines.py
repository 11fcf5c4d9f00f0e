"""Visits, routes, candidates and tracks on hand-made rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.evaluation import truth
from waymark.operators import candidates as cand
from waymark.operators import network, reports, routes, tracks, visits
from waymark.plans.config import SiteParams, VisitParams
from waymark.sources.graph import graph_of

SITE = SiteParams()
#: A network of seven paths, the fourth unfilmed.
LENGTHS = [("P1", 120.0, "C1"), ("P2", 150.0, "C2"), ("P3", 200.0, "C3"), ("P4", 300.0, None), ("P5", 180.0, "C5"), ("P6", 160.0, "C6"), ("P7", 140.0, "C7")]
EDGES = [("P1", "P2"), ("P2", "P3"), ("P3", "P4"), ("P3", "P5"), ("P4", "P5"), ("P4", "P6"), ("P4", "P7"), ("P5", "P6"), ("P6", "P7")]


def seen(spark, rows):
    """Sightings from (person, path, second) rows."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, person_id long, path_id string, ts double")


def visited(spark, rows, **params):
    found = visits.build_visits(seen(spark, rows), VisitParams(**params)).orderBy("person_id", "visit_idx").collect()
    return [(r["person_id"], r["visit_idx"], r["path_id"], r["enter_ts"], r["exit_ts"], r["n_obs"]) for r in found]


@pytest.fixture(scope="module")
def graph(spark):
    return graph_of(spark, LENGTHS, EDGES, SITE)


def test_flip_is_repaired(spark):
    rows = [(1, "P2", 0.0), (1, "P2", 10.0), (1, "P3", 12.0), (1, "P2", 13.0), (1, "P3", 15.0), (1, "P3", 30.0)]
    found = visited(spark, rows)
    assert [v[2] for v in found] == ["P2", "P3"]
    assert sum(v[5] for v in found) == 6


def test_a_long_silence_splits_and_one_of_the_limit_does_not(spark):
    assert len(visited(spark, [(1, "P3", 0.0), (1, "P3", 10.0), (1, "P3", 1000.0)])) == 2
    assert visited(spark, [(1, "P3", 0.0), (1, "P3", 300.0)]) == [(1, 1, "P3", 0.0, 300.0, 2)]
    assert len(visited(spark, [(1, "P3", 0.0), (1, "P3", 300.5)])) == 2


def test_limits_of_a_flip(spark):
    """At the limits a visit is a flip; beyond any of them it is not; at the ends there is no flip."""
    flip = lambda *s: [(1, "P2", 0.0), *((1, "P3", x) for x in s), (1, "P2", 24.0)]
    assert len(visited(spark, flip(6.0, 18.0))) == 1
    assert len(visited(spark, flip(6.0, 18.5))) == 3
    assert len(visited(spark, flip(6.0, 7.0, 8.0, 9.0))) == 3
    assert len(visited(spark, flip(6.0)[:-1] + [(1, "P2", 24.5)])) == 3
    assert len(visited(spark, [(1, "P3", 0.0), (1, "P2", 1.0)])) == 2
    assert len(visited(spark, flip(6.0), rounds=0)) == 3


def test_nested_flips_need_rounds(spark):
    """Alternating labels change all at once in a round, each from its neighbours before the round."""
    rows = [(1, "P2", 0.0), (1, "P3", 1.0), (1, "P2", 2.0), (1, "P3", 3.0), (1, "P2", 4.0)]
    assert [v[2] for v in visited(spark, rows, rounds=1)] == ["P2", "P3", "P2"]
    assert [v[2] for v in visited(spark, rows, rounds=5)] == ["P2"]


def test_ties_nulls_and_slices(spark):
    rows = [(1, "P2", 5.0), (1, "P3", 5.0), (2, None, 0.0), (2, None, 1.0), (2, "P1", 2.0), (3, "P1", 86399.0), (3, "P1", 86401.0)]
    assert [v[:3] for v in visited(spark, rows)] == [(1, 1, "P2"), (1, 2, "P3"), (2, 1, None), (2, 2, "P1"), (3, 1, "P1")]
    one = visits.build_visits(seen(spark, rows), slice_s=1.0).collect()
    assert sorted(one, key=repr) == sorted(visits.build_visits(seen(spark, rows)).collect(), key=repr)
    assert visited(spark, []) == []


def test_routes(graph):
    """Simple routes by their intermediate length; through the hidden path 300 m at 3 m/s."""
    times = {(r["from_path"], r["to_path"], r["via_hidden"]): r for r in routes.build_route_times(graph).collect()}
    assert abs(times["P3", "P5", True]["min_seconds"] - 100.0) < 1e-6
    assert times["P3", "P5", False]["min_seconds"] == 0.0
    assert times["P3", "P7", True]["n_routes"] == 3
    assert times["P3", "P7", True]["max_seconds"] == (300 + 180 + 160) / 0.4
    assert ("P7", "P1", False) not in times and ("P1", "P1", False) not in times


def test_cycles_end(spark):
    g = graph_of(spark, [("A", 1.0, "a"), ("B", 2.0, "b"), ("C", 4.0, None)], [("A", "B"), ("B", "C"), ("C", "A"), ("B", "A")], SiteParams("C"))
    found = {(r["from_path"], r["to_path"], r["via_hidden"]): r["n_routes"] for r in routes.build_route_times(g).collect()}
    assert found == {("A", "B", False): 1, ("B", "C", False): 1, ("C", "A", False): 1, ("B", "A", False): 1, ("A", "C", False): 1, ("B", "A", True): 1, ("C", "B", False): 1}


def listed(lengths, edges, hidden):
    """Every simple route one by one: {(from, to, via hidden): [lengths]}."""
    onward = {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
    out, open_ = {}, [((a, b), 0.0, False) for a, b in edges if a != b]
    while open_:
        way, length, via = open_.pop()
        out.setdefault((way[0], way[-1], via), []).append(length)
        open_ += [((*way, x), length + lengths[way[-1]], via or way[-1] == hidden) for x in onward.get(way[-1], []) if x not in way]
    return out


@pytest.mark.parametrize("together", [1, 2, 12])
def test_routes_are_those_of_a_listing(spark, together):
    """Random networks, with repeated edges, loops and dead ends, in one go and level by level."""
    rng = random.Random(together)
    ids = [f"P{k}" for k in range(6)]
    for _ in range(2):
        lengths = {i: float(rng.randint(1, 40)) for i in ids}
        edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(16)]
        edges += edges[:2]
        g = graph_of(spark, [(i, m, None) for i, m in lengths.items()], edges, SiteParams("P3"))
        wanted = listed(lengths, [e for e in edges if e[0] != e[1]], "P3")
        found: dict = {}
        for r in routes.routes(g, together).collect():
            found.setdefault((r["from_path"], r["to_path"], r["via_hidden"]), []).extend([r["length_m"]] * r["n_routes"])
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_a_dense_network_of_twelve(spark):
    """1,302,061,332 simple routes, told without listing them: all of 1 to 11 steps between any two of twelve paths."""
    ids = [f"P{k:02d}" for k in range(12)]
    g = graph_of(spark, [(i, 1.0, None) for i in ids], [(a, b) for a in ids for b in ids if a != b], SiteParams("P05"))
    found = routes.build_route_times(g).groupBy("from_path", "to_path").agg(F.sum("n_routes").alias("n")).collect()
    each = sum(math.perm(10, k) for k in range(11))
    assert len(found) == 132 and {r["n"] for r in found} == {each}


def test_network_from_sightings(spark):
    """Edges by their part of the departures, lengths by the exact median; slices of one second change nothing."""
    rows = [(p, x, float(t)) for p in range(8) for x, t in (("A", 10 * p), ("A", 10 * p + 1), ("H" if p % 2 else "B", 10 * p + 3 + p), ("C" if p == 0 else "B", 500))]
    for slice_s in (1.0, 86400.0):
        g = network.mined_graph(seen(spark, rows), SiteParams("H"), 0.25, 2.0, slice_s=slice_s)
        assert {tuple(r) for r in g.edges.collect()} == {("A", "H"), ("A", "B"), ("H", "B"), ("B", "C")}
        found = {r["id"]: (r["length_m"], r["camera"]) for r in g.paths.collect()}
        assert found["A"] == (2 * 5.0, "cam_A") and found["C"] == (0.0, "cam_C") and found["H"][1] is None
        assert found["H"][0] == 2 * sorted(500 - (11 * p + 3) for p in (1, 3, 5, 7))[1]
    v = spark.createDataFrame([("k", float(x)) for x in [5, 1, 1, 9, 7, 7]] + [("one", 4.0), ("none", None)], "k string, v double")
    for q, want in ((0.5, 5.0), (0.0, 1.0), (1.0, 9.0), (0.51, 7.0)):
        assert {r["k"]: r["quantile"] for r in network.exact_quantile(v, "k", "v", q, 3.0).collect()} == {"k": want, "one": 4.0}


def test_runs_of_one_person_in_many_slices(spark):
    """Each slice is a group of its own; runs go on over their seams. Against one pass in order."""
    rng = random.Random(11)
    rows = [(p, rng.choice(["P1", "P2", None]), None if rng.random() < 0.05 else float(rng.randint(0, 400))) for p in (1, 1, 1, 1, 2, None) for _ in range(80)]
    wanted: dict = {}
    for p in (1, 2, None):
        mine = sorted((t if t is not None else -1.0, i, path) for i, (q, path, t) in enumerate(rows) if q == p)
        runs = []
        for t, _, path in mine:
            if not runs or runs[-1][0] != path:
                runs.append([path, []])
            runs[-1][1].append(t)
        for k, (path, times) in enumerate(runs, 1):
            known = [t for t in times if t >= 0]
            wanted[p, k] = path, min(known, default=None), max(known, default=None)
    for slice_s in (3.0, 50.0, 86400.0):
        found = {(r["person_id"], r["visit_no"]): (r["path_id"], r["start_time"], r["end_time"]) for r in network.run_visits(seen(spark, rows), slice_s).collect()}
        assert found == wanted


def test_candidates(spark, graph):
    t = 1000.0
    rows = [
        (1, "P3", 900.0), (1, "P5", 1100.0),  # enough time
        (2, "P3", 990.0), (2, "P5", 1074.9),  # a little too fast
        (3, "P3", 990.0), (3, "P5", 1075.0),  # at the bound
        (4, "P3", 999.0),  # not seen again, beside the hidden path
        (5, "P1", 999.0),  # not seen again elsewhere
        (6, "P5", 1000.0),  # a sighting at t is after it
        (7, "P3", 999.0), (7, "P3", 1001.0),
        (8, "P5", 999.0), (8, "P6", 1001.0),
        (9, "P3", 1900.1), (10, "P3", 50.0),
    ]
    incidents = spark.createDataFrame([(1, t)], "incident_id int, t double")
    found = cand.incident_candidates(incidents, seen(spark, rows), routes.build_route_times(graph), graph.edges, SITE)
    status = {r["person_id"]: r["status"] for r in found.collect()}
    assert status == {1: "possible", 2: "impossible: reached too fast", 3: "possible", 4: "pending: may be inside, not seen again yet", 5: "no sighting after", 6: "no sighting before", 7: "same path before and after", 8: "no route through hidden path"}


def test_candidates_by_a_table_function(spark, graph):
    """Called laterally for each incident, with the default window and another; no incident scans the sightings anew."""
    rng = random.Random(23)
    rows = [(rng.randint(1, 30), rng.choice(["P2", "P3", "P5", "P6"]), float(rng.randint(0, 9000))) for _ in range(200)]
    incidents = spark.createDataFrame([(k, float(t)) for k, t in enumerate((0, 1500, 4000, 4000, 8000, 50_000))], "incident_id int, t double")
    times = routes.build_route_times(graph)
    cand.register_function(incidents, seen(spark, rows), times, graph.edges, graph.meta_table())
    for call, window in (("incident_candidates(i.incident_id)", 900.0), ("incident_candidates(i.incident_id, 300D)", 300.0)):
        found = spark.sql(f"SELECT i.incident_id, c.* FROM incidents i, LATERAL {call} c")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LateralJoin" not in plan and "outer(" not in plan
        physical = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in physical and "Cartesian" not in physical
        wanted = cand.incident_candidates(incidents, seen(spark, rows), times, graph.edges, SITE, window)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, wanted.select(*found.columns).collect()), key=repr)


def test_upper_bound_is_an_option(spark, graph):
    rows = [(1, "P3", 900.0), (1, "P5", 900.0 + 300 / 0.4 + 16.0)]
    incidents = spark.createDataFrame([(1, 1000.0)], "incident_id int, t double")
    made = lambda upper: cand.incident_candidates(incidents, seen(spark, rows), routes.build_route_times(graph), graph.edges, SITE, upper_bound=upper).first()["status"]
    assert made(False) == "possible" and made(True) == "impossible: took too long"


def test_median_of_stays(spark, graph):
    stays = [("P1", 10.0), ("P1", 4000.0), ("P1", 8000.0), ("P2", 1.0), ("P2", 2.0)]
    v = spark.createDataFrame([(1, p, 0.0, s) for p, s in stays], "person_id long, path_id string, enter_ts double, exit_ts double")
    found = {r["path_id"]: (r["visits"], r["avg_stay_s"], r["median_stay_s"]) for r in reports.path_statistics(graph.path_table(), v).collect()}
    assert found["P1"] == (3, pytest.approx(12010 / 3), 4000.0) and found["P2"] == (2, 1.5, 1.5) and found["P3"] == (0, None, None)


def test_track_summary_leaves_out_short_and_uncertain(spark):
    rows = [("C1", 1, f, float(f), 1.0 * f, 2.0 * f, 0.9) for f in range(20)] + [("C1", 2, f, float(f), 0.0, 0.0, 0.9) for f in range(14)] + [("C1", 3, f, float(f), 0.0, 0.0, 0.39) for f in range(20)]
    found = tracks.summarize(spark.createDataFrame(rows, "camera_id string, track_id int, frame int, timestamp double, foot_x double, foot_y double, confidence double")).collect()
    assert [(r["track_id"], r["start_time"], r["end_time"], r["n_frames"], r["exit_x"], r["exit_y"]) for r in found] == [(1, 0.0, 19.0, 20, 19.0, 38.0)]


def test_densify_and_embeddings(spark):
    line = spark.createDataFrame([(1, "C1", "P1", 0.0, 5.0), (2, "C1", "P1", 3.0, 3.0)], "person_id long, camera_id string, path_id string, start_time double, end_time double")
    assert sorted((r["person_id"], r["ts"]) for r in tracks.densify(line, 2.0).collect()) == [(1, 0.0), (1, 2.0), (1, 4.0), (1, 5.0), (2, 3.0)]
    crops = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "track_id int, emb array<double>")
    mean = {r["track_id"]: r["emb"] for r in tracks.mean_vector(crops, ["track_id"]).collect()}
    assert mean[1] == pytest.approx([0.3162, 0.9487], abs=1e-4) and mean[2] == [0.0, 0.0]
    known, unknown = tracks.with_embeddings(line.withColumnRenamed("person_id", "track_id"), crops.select("track_id").distinct().where(F.col("track_id") == 1), ["track_id"])
    assert (known.count(), unknown.count()) == (1, 1)


def test_topology_intervals(graph):
    found = {(r["cam_a"], r["cam_b"], round(r["lo"], 3), round(r["hi"], 3)) for r in routes.topology_intervals(graph).collect()}
    assert ("C3", "C5", -2.0, 15.0) in found and ("C3", "C5", 98.0, 765.0) in found and ("C1", "C1", -2.0, 30.0) in found
    assert not any(a == "C7" and b != "C7" for a, b, *_ in found)


def test_anchors_and_recall_by_hand(spark):
    """Random histories, some with days of silence, against a search of every row."""
    rng = random.Random(7)
    rows = [(p, rng.choice(["P1", "P2", "P3"]), float(rng.choice([rng.randint(0, 5), rng.randint(0, 900) * 1000]))) for p in (1, 1, 1, 2) for _ in range(60)]
    times = [0.0, 3.0, 86400.0, 450_000.0, 899_999.0, 2_000_000.0]
    wanted = [(k, t, p) for k, t in enumerate(times) for p in (1, 2, 3)]
    found = cand.anchors(spark.createDataFrame(wanted, "incident_id int, t double, person_id long"), seen(spark, rows)).collect()
    assert len(found) == len(wanted)
    for r in found:
        mine = [(ts, i, path) for i, (p, path, ts) in enumerate(rows) if p == r["person_id"]]
        before, after = max((x for x in mine if x[0] < r["t"]), default=None), min((x for x in mine if x[0] >= r["t"]), default=None)
        assert (r["a"], r["ta"]) == ((before[2], before[0]) if before else (None, None))
        assert (r["b"], r["tb"]) == ((after[2], after[0]) if after else (None, None))
    stays = [(p, path, ts, ts + rng.choice([0.0, 60.0, 200_000.0])) for p, path, ts in rows[::3]] * 2
    went = [(p, path, ts - rng.choice([4.0, 6.0, 100_000.0]), ts - rng.choice([3.0, 5.0, 6.0])) for p, path, ts in rows[1::4]]
    went = [(p, path, min(a, b), max(a, b)) for p, path, a, b in went]
    paths = spark.createDataFrame([("P1", True), ("P2", True), ("P3", False)], "id string, has_camera boolean")
    table = truth.visit_recall(spark.createDataFrame(stays, "person_id long, path_id string, start_time double, end_time double"), spark.createDataFrame(went, "person_id long, path_id string, enter_ts double, exit_ts double"), paths).collect()
    for r in table:
        hits = [any(v[:2] == s[:2] and v[2] <= s[3] + 5 and v[3] >= s[2] - 5 for v in went) for s in stays if s[1] == r["path_id"]]
        assert (r["true_stays"], r["found"]) == (len(hits), sum(hits))
    assert {r["path_id"] for r in table} == {"P1", "P2"}


def test_routes_of_many_levels(spark):
    n = 26
    line = graph_of(spark, [(f"L{k}", 1.0, None) for k in range(n)], [(f"L{k}", f"L{k + 1}") for k in range(n - 1)], SITE)
    far = routes.routes(line).where(f"from_path = 'L0' AND to_path = 'L{n - 1}'").collect()
    assert [r["length_m"] for r in far] == [n - 2.0]
