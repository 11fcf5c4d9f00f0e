"""Stateful streams against the batch operators, fed file by file, started again, and looked into."""

from __future__ import annotations

import random

import pytest

from tests.test_identity import GAPS, SCHEMA, one_sequence, random_rows, same
from tests.test_timelines import EDGES, LENGTHS, SITE
from waymark.operators import matching, routes, visits
from waymark.operators.candidates import incident_candidates
from waymark.plans.config import VisitParams
from waymark.session import saved
from waymark.sources.graph import graph_of
from waymark.streaming import state
from waymark.streaming.candidates import CandidateUpkeep, UpkeepParams
from waymark.streaming.gallery import matched_stream
from waymark.streaming.visits import extended, repaired, visit_stream


class Feed:
    """A folder that a stream reads file after file, and what the stream has sent."""

    def __init__(self, spark, folder, schema, made):
        self.spark, self.folder, self.schema, self.made, self.n = spark, folder, schema, made, 0
        (folder / "in").mkdir()

    def give(self, *files, partitions=2):
        """Each list of rows is one file and one micro-batch of a query that starts from the checkpoint and stops after them."""
        self.spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for rows in files:
            self.n += 1
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/next/{self.n:04d}")
            (part,) = (self.folder / "next" / f"{self.n:04d}").glob("part-*.parquet")
            part.rename(self.folder / "in" / f"{self.n:04d}.parquet")
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        query = self.made(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start(str(self.folder / "out"))
        assert query.awaitTermination(300)
        self.spark.conf.set("spark.sql.shuffle.partitions", 4)
        return query.lastProgress

    def sent(self):
        return self.spark.read.parquet(str(self.folder / "out")).collect()

    def state(self, variable):
        return self.spark.read.format("statestore").option("path", str(self.folder / "state")).option("stateVarName", variable).load()


def shuffled(rows, by, delay, size):
    """Files of rows that come at most ``delay`` seconds late."""
    rng = random.Random(size)
    late = sorted(rows, key=lambda r: (r[by] + rng.random() * delay) if r[by] is not None else 0.0)
    return [late[k : k + size] for k in range(0, len(late), size)]


@pytest.mark.parametrize(("seed", "batch_s", "topology"), [(21, 50.0, True), (22, 0.0, False)])
def test_stream_of_tracks_gives_the_identities_of_the_batch(spark, tmp_path, seed, batch_s, topology):
    """Late tracks included, over a restart; identities leave the state at their horizon; the last batches wait."""
    rows, gaps, params = random_rows(seed, n=45, sites=("s", "t")), GAPS if topology else None, matching.MatchParams(batch_s=batch_s)
    gate = matching.Gate(gaps, params)
    feed = Feed(spark, tmp_path, SCHEMA, lambda stream: matched_stream(stream, gate, params, "100 seconds"))
    files = shuffled(rows, 3, 99.0, 24)
    feed.give(*files[:3])
    early = len(feed.sent())
    feed.give(*files[3:])
    assert 0 < early < len(feed.sent()) <= len(rows)
    wanted = one_sequence(rows, gaps, params)
    told = lambda: {(r["site"], r["camera_id"], r["track_id"]): (r["global_id"], r["match_dist"]) for r in feed.sent()}
    assert all(v[0] == wanted[k][0] for k, v in told().items())
    # a much later track lets the watermark pass all others; a track behind it is dropped
    newest = max(r[3] for r in rows)
    feed.give([("u", 1, "C1", newest + 5000.0, newest + 5001.0, [1.0, 0.0, 0.0, 0.0])], [("s", 999, "C1", 80_000.0, 80_001.0, [1.0, 0.0, 0.0, 0.0])])
    assert len(feed.sent()) == len(rows)
    same(told(), wanted)
    known = feed.state("known").collect()
    assert all(r["list_element"]["until"] + gate.reach >= newest + 4900.0 for r in known), known
    assert feed.state("waiting").count() == 1


def test_waiting_tracks_are_stored_in_blocks(spark, tmp_path):
    """Not each by itself (before: 90 values); what waits over a restart, with no number in its vector, is what it was."""
    rows, params = random_rows(23, n=45, sites=("s", "t")), matching.MatchParams(batch_s=0.0)
    rows[3] = (*rows[3][:5], [None, *rows[3][5][1:]])
    feed = Feed(spark, tmp_path, SCHEMA, lambda stream: matched_stream(stream, matching.Gate(None, params), params, "1 day"))
    feed.give(rows)
    assert feed.sent() == [] and feed.state("waiting").count() == 2
    feed.give([("u", 1, "C1", max(r[3] for r in rows) + 1e6, 0.0, [1.0, 0.0, 0.0, 0.0])])
    wanted = one_sequence([(*r[:5], [float("nan") if x is None else x for x in r[5]]) for r in rows], None, params)
    same({(r["site"], r["camera_id"], r["track_id"]): (r["global_id"], r["match_dist"]) for r in feed.sent()}, wanted)


def test_rows_come_back_from_blocks(monkeypatch):
    monkeypatch.setattr(state, "BLOCK", 3)
    rows = [(i, None if i % 2 else "P") for i in range(8)]
    blocks = list(state.packed(rows))
    assert [len(b[0]) for b in blocks] == [3, 3, 2] and list(state.unpacked(blocks)) == rows and list(state.packed([])) == []


SEEN = "id long, person_id long, path_id string, ts double"


def batch_visits(spark, rows, params):
    found = visits.build_visits(spark.createDataFrame(rows, SEEN), params).collect()
    return {(r["person_id"], r["visit_idx"]): (r["path_id"], r["enter_ts"], r["exit_ts"], r["n_obs"]) for r in found}


def flickering(seed, n):
    """Sightings that change paths quickly, in bursts with flips of all kinds, and silences around every limit."""
    rng, rows = random.Random(seed), []
    for person in (1, 2, 3):
        at, path = 1000.0, "P1"
        for _ in range(n):
            at += rng.choice([0.0, 1.0, 2.0, 6.0, 12.0, 12.5, 24.0, 24.5, 100.0, 300.0, 300.5])
            path = rng.choice(["P1", "P2", "P2", "P3", None]) if rng.random() < 0.6 else path
            rows.append((len(rows), person, path, at))
    return rows


def test_short_lists_are_repaired_like_tables(spark):
    for params in (VisitParams(), VisitParams(rounds=1), VisitParams(50.0, 30.0, 2, 3)):
        rows = flickering(params.rounds, 60)
        wanted = batch_visits(spark, rows, params)
        for person in (1, 2, 3):
            runs = repaired(extended([], [[p, t, t, 1] for _, q, p, t in sorted(rows, key=lambda r: (r[3], r[0])) if q == person], params.split_gap), params)
            assert {(person, k): tuple(r) for k, r in enumerate(runs, 1)} == {k: v for k, v in wanted.items() if k[0] == person}


@pytest.mark.parametrize("params", [VisitParams(), VisitParams(50.0, 30.0, 2, 3)])
def test_stream_of_visits_gives_those_of_the_batch(spark, tmp_path, params):
    """Late sightings included; what is sent early stays right; a restart goes on; sightings behind the watermark are dropped."""
    rows = flickering(7, 90)
    feed = Feed(spark, tmp_path, SEEN, lambda stream: visit_stream(stream, params, "100 seconds"))
    wanted, files = batch_visits(spark, rows, params), shuffled(rows, 3, 99.0, 70)
    told = lambda: {(r["person_id"], r["visit_idx"]): (r["path_id"], r["enter_ts"], r["exit_ts"], r["n_obs"]) for r in feed.sent()}
    feed.give(*files[:2])
    early = told()
    assert 10 < len(early) < len(wanted) and early.items() <= wanted.items()
    feed.give(*files[2:])
    assert len(early) < len(told()) and told().items() <= wanted.items()
    feed.give([(9000, 9, "P1", 1e6)], [(9001, 1, "P2", 2000.0)])
    assert told() == wanted and len(feed.sent()) == len(wanted)
    assert feed.state("runs").count() == 0


def test_waiting_sightings_are_stored_in_blocks(spark, tmp_path):
    """One value of a person's sightings in a micro-batch (before: 180 values); those not yet passed are written back."""
    feed = Feed(spark, tmp_path, SEEN, lambda stream: visit_stream(stream, VisitParams(), "1 day"))
    rows = [r for r in flickering(9, 60) if r[1] < 3] + [(None, 3, None, 1000.0), (500, 3, "P1", 2e4)]
    feed.give(rows)
    assert feed.sent() == [] and feed.state("waiting").count() == 3
    feed.give([(501, 9, "P1", 15_000.0 + 86_400.0)])
    assert {r["person_id"] for r in feed.sent()} == {1, 2, 3} and feed.state("waiting").count() == 2
    feed.give([(9000, 9, "P1", 1e6)])
    told = {(r["person_id"], r["visit_idx"]): (r["path_id"], r["enter_ts"], r["exit_ts"], r["n_obs"]) for r in feed.sent() if r["person_id"] != 9}
    assert told == batch_visits(spark, rows, VisitParams())


def test_a_flip_at_the_edge_of_the_watermark(spark, tmp_path):
    """The watermark passes a short visit of another path, but not yet the return: nothing is sent until it is known."""
    feed = Feed(spark, tmp_path, SEEN, lambda stream: visit_stream(stream, VisitParams(), "10 seconds"))
    told = lambda: [tuple(r) for r in sorted(feed.sent(), key=lambda r: (r["person_id"], r["visit_idx"]))]
    clock = lambda ts: [(int(ts), 99, "X", 1000.0 + ts)]
    feed.give([(1, 1, "P2", 1000.0), (2, 1, "P2", 1020.0), (3, 1, "P3", 1022.0), (4, 2, "P2", 1000.0), (5, 2, "P2", 1020.0), (6, 2, "P3", 1022.0)], clock(34.0))
    assert told() == []
    feed.give([(7, 1, "P2", 1034.5)], clock(60.0))  # back within 2 flip_s, when the watermark is at 24
    feed.give(clock(63.0), clock(70.0))
    assert told() == [(2, 1, "P2", 1000.0, 1020.0, 2)]  # the other one never came back in time: P3 is a visit of its own
    feed.give(clock(2000.0))
    assert told()[:3] == [(1, 1, "P2", 1000.0, 1034.5, 4), (2, 1, "P2", 1000.0, 1020.0, 2), (2, 2, "P3", 1022.0, 1022.0, 1)]


def incidents_of(spark):
    return spark.createDataFrame([(1, 2000.0), (2, 5000.0), (3, 90_000.0)], "incident_id int, t double")


def test_candidates_are_kept_up_to_date(spark, tmp_path):
    """After each batch the table is that of the whole prefix; only changed candidates are sent; a batch given twice counts once."""
    g = graph_of(spark, LENGTHS, EDGES, SITE)
    times = saved(routes.build_route_times(g), "times")
    rng = random.Random(17)
    rows = [(i, rng.randint(1, 40), rng.choice(["P2", "P3", "P5", "P6"]), float(rng.randint(500, 7000))) for i in range(260)] + [(900, None, "P3", 2000.0), (901, 5, "P3", None), (902, 41, "P3", 2000.0), (903, 41, "P3", 2000.0)]
    rng.shuffle(rows)
    upkeep = CandidateUpkeep(str(tmp_path / "upkeep"), incidents_of(spark), times, g.edges, SITE, UpkeepParams(600.0, 4, fold=3))
    before: dict = {}
    given, sizes = [], [60, 60, 60, 40, 0, 24, 20]
    for n, size in enumerate(sizes):
        part = rows[len(given) : len(given) + size]
        given += part
        upkeep.apply(spark.createDataFrame(part, SEEN), n)
        if n in (2, 3):
            upkeep.apply(spark.createDataFrame(part, SEEN), n)
        whole = spark.createDataFrame([r for r in given if r[1] is not None], SEEN)
        wanted = {(r["incident_id"], r["person_id"]): tuple(r) for r in incident_candidates(incidents_of(spark), whole, times, g.edges, SITE, 600.0).collect()}
        assert {(r["incident_id"], r["person_id"]): tuple(r) for r in upkeep.table(n).collect()} == wanted
        sent = {(r["incident_id"], r["person_id"]): tuple(r) for r in upkeep.updates(n).collect()}
        anchors = lambda table: {k: v[2:6] for k, v in table.items()}
        assert {k for k in wanted if k not in before or anchors(wanted)[k] != anchors(before)[k]} <= set(sent) <= {k for k in wanted if k[1] in {r[1] for r in part}}
        assert all(wanted[k] == v for k, v in sent.items())
        if n > 3:
            assert len(sent) < len(wanted) / 2
        before = wanted
    assert len(before) > 40


def test_pending_candidates_of_a_stream_are_settled(spark, tmp_path):
    """Sightings come as a stream: one who was last seen beside the hidden path is pending until seen again."""
    g = graph_of(spark, LENGTHS, EDGES, SITE)
    upkeep = CandidateUpkeep(str(tmp_path / "upkeep"), incidents_of(spark), saved(routes.build_route_times(g), "times"), g.edges, SITE)
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[(1, 1, "P3", 1900.0), (2, 2, "P3", 1990.0)], [(3, 1, "P5", 2100.0)], [(4, 2, "P5", 2020.0)]]):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.parquet(f"{tmp_path}/next/{n}")
        (part,) = (tmp_path / "next" / str(n)).glob("part-*.parquet")
        part.rename(tmp_path / "in" / f"{n}.parquet")
        stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(upkeep.apply).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        status = {r["person_id"]: r["status"].split(":")[0] for r in upkeep.table(n).where("incident_id = 1").collect()}
        assert status == [{1: "pending", 2: "pending"}, {1: "possible", 2: "pending"}, {1: "possible", 2: "impossible"}][n]
        assert {r["person_id"] for r in upkeep.updates(n).collect()} == [{1, 2}, {1}, {2}][n]
