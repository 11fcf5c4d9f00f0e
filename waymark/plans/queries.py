"""Every operator on the driver's tables, and SQL that says the same.

``events`` are sightings of a person (user_id) on a path (event_type); ``error`` is the path nobody films, and its rows are
the truth that only evaluation reads. ``lineitem`` plays detections, ``embeddings`` tracks.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.evaluation import truth
from waymark.functions import scalar
from waymark.operators import candidates as cand
from waymark.operators import identity, matching, network, reports, routes, tracks
from waymark.operators import visits as vis
from waymark.operators.nearest import nearest
from waymark.plans.config import SiteParams, VisitParams
from waymark.session import attach, saved, shared_path
from waymark.sources import files
from waymark.sources.graph import PathGraph, graph_of, read_graph, write_graph
from waymark.streaming.candidates import CandidateUpkeep, UpkeepParams
from waymark.streaming.gallery import matched_stream
from waymark.streaming.visits import visit_stream

#: The network on the driver's tables, incidents (seconds since 1970, UTC) and windows.
PATHS = [("view", 21600.0, "cam_view"), ("click", 43200.0, "cam_click"), ("signup", 43200.0, "cam_signup"), ("error", 129600.0, None), ("purchase", 64800.0, "cam_purchase")]
EDGES = [("view", "click"), ("click", "signup"), ("signup", "error"), ("signup", "purchase"), ("error", "purchase"), ("error", "view"), ("purchase", "view")]
SITE = SiteParams("error", 0.4, 3.0, 900.0, 2.0)
INCIDENTS = [(1, 1704110400.0), (2, 1705276800.0), (3, 1706616000.0)]
WINDOW = 43200.0
VISITS = VisitParams(86400.0, 43200.0, 3, 5)
PERSON, ONE = 7, 2
#: An edge of the mined network has this part of a path's departures.
SUPPORT = 0.25


class Site:
    """The driver's tables as this library's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = attach(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def graph(self) -> PathGraph:
        return graph_of(self.spark, PATHS, EDGES, SITE)

    def survey(self) -> PathGraph:
        """The network that all events show, those on the hidden path too."""
        rows = self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("person_id"), F.col("event_type").alias("path_id"), scalar.ntz_seconds("ts").alias("ts"))
        found = network.mined_graph(rows, SITE, SUPPORT, slice_s=7 * 86400.0)
        return PathGraph(saved(found.paths, "paths"), saved(found.edges, "edges"), found.site)

    def events(self, hidden: bool) -> DataFrame:
        side = F.col("event_type") == SITE.hidden if hidden else F.col("event_type") != SITE.hidden
        return self.table("events").where(side).select(F.col("event_id").alias("id"), F.col("user_id").alias("person_id"), F.col("event_type").alias("path_id"), scalar.ntz_seconds("ts").alias("ts"))

    def observations(self) -> DataFrame:
        return self.events(False)

    def incidents(self) -> DataFrame:
        return self.spark.createDataFrame(INCIDENTS, "incident_id int, t double")

    def visits(self, rounds: int = VISITS.rounds) -> DataFrame:
        return vis.build_visits(self.observations(), VisitParams(VISITS.split_gap, VISITS.flip_s, VISITS.flip_obs, rounds), slice_s=7 * 86400.0)

    def candidates(self) -> DataFrame:
        g = self.graph()
        return cand.incident_candidates(self.incidents(), self.observations(), routes.build_route_times(g), g.edges, SITE, WINDOW)

    def presence(self) -> DataFrame:
        """Truth: each hidden event is a stay of six hours around it."""
        return self.events(True).select("person_id", "path_id", (F.col("ts") - 10800.0).alias("start_time"), (F.col("ts") + 10800.0).alias("end_time"))

    def stays(self) -> DataFrame:
        """Truth on filmed paths, for recall: each event's own moment and a minute after it."""
        return self.observations().select("person_id", "path_id", F.col("ts").alias("start_time"), (F.col("ts") + 60.0).alias("end_time"))

    def labels(self) -> DataFrame:
        return truth.labels(self.incidents(), self.observations(), self.presence(), SITE.hidden, WINDOW)

    def tracks(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", "embedding", "label")
        joined = e.join(self.observations(), F.col("vec_id") == F.col("id"))
        return joined.select(F.col("vec_id").alias("track_id"), F.concat(F.lit("cam_"), "path_id").alias("camera_id"), "path_id", F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), F.col("embedding").alias("emb"), F.col("label").cast("long").alias("true_id"))

    def detections(self) -> DataFrame:
        when = scalar.ntz_seconds("l_shipdate")
        return self.table("lineitem").select(F.col("l_returnflag").alias("camera_id"), F.col("l_suppkey").alias("track_id"), when.alias("timestamp"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("foot_x"), F.col("l_extendedprice").alias("foot_y"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))

    def spans(self) -> DataFrame:
        """Each customer's orders by status as tracks from the first to the last day."""
        when = scalar.ntz_seconds("o_orderdate")
        rows = self.table("orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("path_id"), when.alias("ts"))
        return rows.groupBy("person_id", "path_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).withColumn("camera_id", F.concat(F.lit("cam_"), "path_id"))

    def votes(self) -> DataFrame:
        """Identity = label of the embedding, person = user of the event: for majority votes."""
        joined = self.table("embeddings").select("vec_id", "label").join(self.table("events").select("event_id", "user_id", "event_type"), F.col("vec_id") == F.col("event_id"))
        return joined.select(F.col("label").cast("long").alias("global_person_id"), F.col("event_type").alias("camera_id"), F.col("vec_id").alias("track_id"), F.concat(F.lit("P"), F.col("user_id") % 10).alias("person_id"))


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with SQL."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def visits_basic(spark, sf):
    return Site(spark, sf).visits(0)


def visits_repaired(spark, sf):
    return Site(spark, sf).visits()


def trajectories(spark, sf):
    return vis.trajectories(Site(spark, sf).visits())


def person_timeline(spark, sf):
    s = Site(spark, sf)
    one = vis.build_visits(s.observations().where(F.col("person_id") == PERSON), VISITS, slice_s=7 * 86400.0)
    return _plain(reports.person_timeline(one, PERSON))


def near_hidden(spark, sf):
    s = Site(spark, sf)
    return _plain(reports.near_hidden(s.visits(), s.graph().edges, SITE.hidden, INCIDENTS[1][1], WINDOW))


def anchors(spark, sf):
    s = Site(spark, sf)
    one = s.incidents().where(F.col("incident_id") == ONE)
    return _plain(reports.anchor_sightings(cand.anchors(cand.in_window(one, s.observations(), WINDOW), s.observations())))


def path_stats(spark, sf):
    s = Site(spark, sf)
    return _plain(reports.path_report(s.graph().path_table(), saved(s.visits(), "visits")))


def route_times(spark, sf):
    return routes.build_route_times(Site(spark, sf).survey())


def route_times_near_hidden(spark, sf):
    g = Site(spark, sf).survey()
    return _plain(reports.route_times_near_hidden(routes.build_route_times(g), g.edges, SITE.hidden))


def candidates(spark, sf):
    return reports.candidate_table(Site(spark, sf).candidates())


def lateral_candidates(spark, sf):
    """The same by a table function that SQL calls for each incident."""
    s = Site(spark, sf)
    g = s.graph()
    cand.register_function(s.incidents(), s.observations(), saved(routes.build_route_times(g), "times"), g.edges, g.meta_table())
    return spark.sql("SELECT i.incident_id, c.* FROM incidents i, LATERAL incident_candidates(i.incident_id, CAST(:window AS DOUBLE)) c", args={"window": WINDOW})


def candidate_report(spark, sf):
    found = Site(spark, sf).candidates().where(F.col("incident_id") == ONE)
    return _plain(reports.candidate_report(found))


def candidate_summary(spark, sf):
    return reports.status_summary(Site(spark, sf).candidates())


def feasibility_eval(spark, sf):
    s = Site(spark, sf)
    return truth.feasibility(s.candidates(), s.labels())


def visit_recall(spark, sf):
    s = Site(spark, sf)
    return _plain(truth.visit_recall(s.stays(), s.visits(), s.graph().path_table()))


def presence_labels(spark, sf):
    return Site(spark, sf).labels()


def topology_intervals(spark, sf):
    return routes.topology_intervals(Site(spark, sf).survey())


def topology_horizon(spark, sf):
    return routes.horizon(routes.topology_intervals(Site(spark, sf).survey()))


def track_pair_gate(spark, sf):
    s = Site(spark, sf)
    intervals = routes.topology_intervals(s.graph())
    found = tracks.allowed_pairs(s.tracks(), intervals, routes.horizon(intervals).first()["max_gap"])
    return found.select("track_a", "track_b", "gap", F.col("distance").cast("decimal(18,6)").cast("double").alias("distance"))


def track_pair_counts(spark, sf):
    """How many pairs of tracks each two cameras allow."""
    s = Site(spark, sf)
    return tracks.allowed_counts(s.tracks(), routes.topology_intervals(s.graph()))


def track_summary(spark, sf):
    return tracks.summarize(Site(spark, sf).detections(), order=("timestamp", "l_orderkey", "l_linenumber"))


def track_densify(spark, sf):
    return tracks.densify(Site(spark, sf).spans(), 2592000.0)


def identity_majority(spark, sf):
    rows = Site(spark, sf).votes()
    return identity.identity_map(rows.select("global_person_id", "camera_id", "track_id"), rows.select("camera_id", "track_id", "person_id"))


def fragmented_persons(spark, sf):
    return identity.fragmented(identity_majority(spark, sf))


def missing_participants(spark, sf):
    s = Site(spark, sf)
    sheet = s.table("customer").select(F.col("c_custkey").cast("long").alias("person_no"))
    return identity.never_seen(sheet, s.observations().select(F.col("person_id").alias("true_id")))


def reid_counts(spark, sf):
    rows = Site(spark, sf).votes()
    return truth.identity_counts(rows.select("global_person_id", "camera_id", "track_id"), rows.select("camera_id", "track_id", "person_id"))


def pairwise_reid(spark, sf):
    rows = Site(spark, sf).votes()
    return truth.pairwise(rows.select(F.col("global_person_id").alias("global_id"), F.col("person_id").alias("true_id")))


def timeline_repeat_check(spark, sf):
    return vis.repeats(Site(spark, sf).visits(), VISITS.split_gap).select("person_id", "visit_idx", "path_id")


def full_outer_diff(spark, sf):
    s = Site(spark, sf)
    keys = ["person_id", "path_id", "enter_ts", "exit_ts", "n_obs"]
    return vis.difference(s.visits(0), s.visits(), keys)


def run_visits(spark, sf):
    return network.run_visits(Site(spark, sf).observations())


def person_labels(spark, sf):
    ids = Site(spark, sf).observations().select("person_id").distinct()
    return ids.select("person_id", scalar.person_label(F.col("person_id")).alias("label"), scalar.trailing_number(scalar.person_label(F.col("person_id"))).alias("number"))


#: Matching on the driver's tracks, whose looks are hardly alike: an hour's tracks together, or each start by itself.
MATCH, MATCH_ONE = matching.MatchParams(max_dist=0.6, batch_s=3600.0, horizon_s=86400.0), matching.MatchParams(max_dist=0.6, batch_s=0.0)


def _line(s: Site) -> DataFrame:
    return s.tracks().withColumn("site", F.lit("all"))


def match_tracks(spark, sf):
    s = Site(spark, sf)
    return matching.match_tracks(_line(s), routes.topology_intervals(s.graph()), MATCH)


def match_each_start(spark, sf):
    """Batches of the tracks of one start."""
    s = Site(spark, sf)
    found = matching.match_tracks(_line(s), routes.topology_intervals(s.graph()), MATCH_ONE)
    return found.withColumn("match_dist", F.col("match_dist").cast("decimal(18,6)").cast("double"))


def match_parts(spark, sf):
    """How the tracks of an hour that cameras an hour apart may see fall into parts that can be matched side by side."""
    s = Site(spark, sf)
    near = routes.topology_intervals(s.graph()).where("lo <= 3600").withColumn("hi", F.least("hi", F.lit(3600.0)))
    return matching.part_sizes(_line(s), near, MATCH)


def nearest_tracks(spark, sf):
    """The nearest of all other vectors to each vector whose id is divisible by 100."""
    rows = Site(spark, sf).table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    return nearest(rows.where(F.col("id") % 100 == 0), rows.withColumnRenamed("id", "ref_id")).select("id", "ref_id", F.col("similarity").cast("decimal(18,6)").cast("double").alias("similarity"))


def half_match(spark, sf):
    """Each label's vectors, in order of their ids, as the crops of one track."""
    crops = Site(spark, sf).table("embeddings").select(F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("emb"))
    return identity.half_match(crops.dropna(subset=["track_id"])).withColumn("similarity", F.col("similarity").cast("decimal(18,6)").cast("double"))


def half_report(spark, sf):
    crops = Site(spark, sf).table("embeddings").select(F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("emb"))
    found = identity.half_report(crops.dropna(subset=["track_id"]))
    return found.select("tracks", *(F.col(c).cast("decimal(18,6)").cast("double").alias(c) for c in ("rank_1", "chance", "mean_own", "mean_other")))


def risk_levels(spark, sf):
    """Events' values, scaled, as probabilities."""
    p = F.col("value") / 100
    return Site(spark, sf).table("events").select("event_id", scalar.risk_level(F.when(p < 1, p)).alias("level"))


def label_rate(spark, sf):
    return truth.label_rate(Site(spark, sf).labels())


def synthetic_identities(spark, sf):
    """Pairwise quality of matching, with cameras' positions and without, on tracks whose labels are the truth."""
    s, out = Site(spark, sf), None
    line = saved(_line(s), "line")
    for name, intervals in (("topology", routes.topology_intervals(s.graph())), ("time order only", None)):
        found = saved(matching.match_tracks(line.drop("true_id"), intervals, MATCH), "matched")  # one configuration's task at a time
        known = found.join(line.select("track_id", "true_id"), "track_id")
        row = truth.pairwise(known.select(F.concat_ws("/", "site", "global_id").alias("global_id"), "true_id")).withColumn("configuration", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def identity_report(spark, sf):
    """Users as identities, of which every fourth track is labelled."""
    rows = Site(spark, sf).votes().withColumn("camera_id", F.lit("c"))
    users = Site(spark, sf).table("events").select(F.col("event_id").alias("track_id"), F.col("user_id").alias("user"))
    line = rows.join(users, "track_id").select(F.col("user").alias("global_person_id"), "camera_id", "track_id")
    known = rows.where(F.col("track_id") % 4 == 0).select("camera_id", "track_id", F.concat(F.lit("P"), "global_person_id").alias("person_id"))
    return identity.identity_report(identity.identity_map(line, known))


def identity_presence(spark, sf):
    """Customers' spans as the route sheet of the identities that map to them."""
    sheet = Site(spark, sf).spans().select(F.col("person_id").alias("person_no"), "path_id", "start_time", "end_time")
    return identity.presence(identity_majority(spark, sf), sheet)


def embedding_coverage(spark, sf):
    s = Site(spark, sf)
    have = s.table("embeddings").select(F.col("vec_id").alias("track_id"))
    return tracks.embedding_coverage(s.observations().select(F.col("id").alias("track_id")), have, ["track_id"])


def csv_sightings(spark, sf):
    """Sightings written as CSV, read with their schema and given the cameras of their paths."""
    s, path = Site(spark, sf), shared_path(spark, "csv")
    files.write_csv(s.observations().select("person_id", "path_id", F.col("ts").alias("timestamp")), path)
    return files.raw_sightings(files.read_csv(spark, path, "raw_sightings"), s.graph()).drop("id")


def glob_sightings(spark, sf):
    """Sightings written as one folder of CSV files for each path, the folders read by a glob."""
    s, path = Site(spark, sf), shared_path(spark, "csv")
    for kind in [p[0] for p in PATHS if p[2]]:
        files.write_csv(s.observations().where(F.col("path_id") == kind).select("person_id", "path_id", F.col("ts").alias("timestamp")), f"{path}/{kind}")
    return files.read_csv(spark, f"{path}/*", "raw_sightings").groupBy("path_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def _streamed(spark, rows: DataFrame, made) -> DataFrame:
    """Stored rows as a stream, to its end; what it sent."""
    where, state, out = (shared_path(spark, name) for name in ("stream-in", "stream-state", "stream-out"))
    rows.write.parquet(where)
    query = made(spark.readStream.schema(rows.schema).parquet(where)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_visits(spark, sf):
    """All sightings as a stream; one of nobody, years later, lets the watermark pass them."""
    s = Site(spark, sf)
    end = s.observations().agg(F.max("id").alias("id"), F.lit(-1).cast("long").alias("person_id"), F.lit(None).cast("string").alias("path_id"), (F.max("ts") + 1e8).alias("ts")).where("ts is not null")
    return _streamed(spark, s.observations().select("id", F.col("person_id").cast("long").alias("person_id"), "path_id", "ts").unionByName(end), lambda rows: visit_stream(rows, VISITS, "1 hour"))


def stream_identities(spark, sf):
    """All tracks as a stream, batches of the tracks of one start; one of another site, years later, ends it."""
    s = Site(spark, sf)
    gate = matching.gate_of(routes.topology_intervals(s.graph()), MATCH_ONE)
    line = _line(s).select("site", "track_id", "camera_id", "start_time", "end_time", F.col("emb").cast("array<double>").alias("emb"))
    end = line.agg(F.lit("end").alias("site"), F.max("track_id").alias("track_id"), F.lit("cam").alias("camera_id"), (F.max("start_time") + 1e8).alias("start_time"), (F.max("start_time") + 1e8).alias("end_time"), F.array(F.lit(1.0)).alias("emb")).where("start_time is not null")
    found = _streamed(spark, line.unionByName(end), lambda rows: matched_stream(rows, gate, MATCH_ONE, "1 hour"))
    return found.withColumn("match_dist", F.col("match_dist").cast("decimal(18,6)").cast("double"))


def stream_candidates(spark, sf):
    """Sightings in four batches, by parts of their time; the candidates after the last."""
    s = Site(spark, sf)
    g, rows = s.graph(), saved(s.observations(), "seen")
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    upkeep = CandidateUpkeep(shared_path(spark, "upkeep"), s.incidents(), saved(routes.build_route_times(g), "times"), g.edges, SITE, UpkeepParams(WINDOW, 16, 3))
    part = F.least(F.lit(3), F.floor((F.col("ts") - F.lit(span["a"])) / F.lit(max(1.0, (span["z"] or 0.0) - (span["a"] or 0.0))) * 4))
    for n in range(4):
        upkeep.apply(rows.where(part == n), n)
    return upkeep.table(3)


def graph_document(spark, sf):
    """The mined network as a JSON document, read back: edges with what lies at their ends."""
    s, path = Site(spark, sf), shared_path(attach(spark), "graph")
    write_graph(s.survey(), path)
    g = read_graph(spark, path)
    return g.edges.join(g.path_table().withColumnRenamed("id", "from_path"), "from_path").join(g.camera_table().select(F.col("path_id").alias("to_path"), F.col("id").alias("to_camera")), "to_path", "left").select("from_path", "to_path", "length_m", "has_camera", "to_camera")


def run_meta(spark, sf):
    """Settings with what the table shows: the part of events that a camera sees, and the median seconds until the next."""
    s = Site(spark, sf)
    seen = s.table("events").agg(F.count_if(F.col("event_type") != SITE.hidden).alias("seen"), F.count("event_type").alias("all")).first()
    left = network.departures(s.observations(), 7 * 86400.0).select(F.lit(1).alias("one"), "seconds")
    period = network.exact_quantile(left, "one", "seconds", 0.5, 3600.0).first()
    return s.graph().meta_table("sim", round(seen["seen"] / seen["all"], 6) if seen["all"] else None, float(int(period["quantile"])) if period else None, "events")


def persons(spark, sf):
    return files.persons_of(Site(spark, sf).observations())


def incident_rows(spark, sf):
    """Every event on the hidden path as an incident."""
    rows = Site(spark, sf).events(True).select(F.col("id").alias("incident_id"), F.col("ts").alias("time"))
    return files.rebased_incidents(rows, SITE.hidden)


def sql_file(spark, sf):
    """A query file with a parameter, over a registered table."""
    files.register({"sightings": Site(spark, sf).observations()})
    return files.run_sql_file(spark, str(Path(__file__).with_name("sightings_since.sql")), {"since": INCIDENTS[1][1]})


def source_reload(spark, sf):
    """Three sources stored; one is replaced by fewer rows, one by none, one stays."""
    s, path = Site(spark, sf), shared_path(spark, "sources")
    rows = s.observations().withColumn("source", F.when(F.col("id") % 3 == 0, "none").when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    files.replace_source(rows, path)
    files.replace_source(rows.where((F.col("source") == "odd") & (F.col("person_id") < 50)), path, ["odd", "none"])
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


_list = [lateral_candidates, visits_basic, visits_repaired, trajectories, person_timeline, near_hidden, anchors, path_stats, route_times, route_times_near_hidden, candidates, candidate_summary, feasibility_eval, visit_recall, presence_labels, topology_intervals, topology_horizon, track_pair_gate, track_pair_counts, track_summary, track_densify, identity_majority, fragmented_persons, missing_participants, reid_counts, pairwise_reid, timeline_repeat_check, full_outer_diff, run_visits, person_labels, nearest_tracks, half_match, risk_levels, label_rate, match_tracks, match_each_start, match_parts, synthetic_identities, candidate_report, identity_report, identity_presence, embedding_coverage, csv_sightings, glob_sightings, stream_visits, stream_identities, stream_candidates, half_report, graph_document, run_meta, persons, incident_rows, sql_file, source_reload]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _list}


# ------------------------------------------------------------------------------------------------ the same in SQL

_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
_BASE = f"""obs AS (SELECT event_id AS id, user_id AS person_id, event_type AS path_id, epoch(ts) AS ts FROM events WHERE event_type <> '{SITE.hidden}'),
truth AS (SELECT user_id AS person_id, epoch(ts) - 10800.0::DOUBLE AS start_time, epoch(ts) + 10800.0::DOUBLE AS end_time FROM events WHERE event_type = '{SITE.hidden}'),
paths(id, length_m, camera) AS (VALUES {_values(PATHS)}),
edges(from_path, to_path) AS (VALUES {_values(EDGES)}),
incidents(incident_id, t) AS (VALUES {_values(INCIDENTS)})"""


def _visits_sql(rounds: int, out: str = "visits") -> str:
    """The repair rounds spelled out over single sightings."""
    sql, seen = [], "obs"
    for r in range(rounds + 1):
        sql.append(f"""{out}_m{r} AS (SELECT *, CASE WHEN path_id IS DISTINCT FROM lag(path_id) OVER w OR ts - lag(ts) OVER w > {VISITS.split_gap} OR lag(id) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM {seen} WINDOW w AS (PARTITION BY person_id ORDER BY ts, id)),
{out}_n{r} AS (SELECT id, person_id, path_id, ts, sum(s) OVER (PARTITION BY person_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS no FROM {out}_m{r}),
{out}_v{r} AS (SELECT person_id, no, min(path_id) AS path_id, min(ts) AS enter_ts, max(ts) AS exit_ts, count(*) AS n_obs FROM {out}_n{r} GROUP BY ALL)""")
        if r < rounds:
            sql.append(f"""{out}_f{r} AS (SELECT person_id, no, before FROM (SELECT *, lag(path_id) OVER w AS before, lead(path_id) OVER w AS after, lead(enter_ts) OVER w - lag(exit_ts) OVER w AS apart FROM {out}_v{r} WINDOW w AS (PARTITION BY person_id ORDER BY no)) WHERE before = after AND before <> path_id AND exit_ts - enter_ts <= {VISITS.flip_s} AND n_obs <= {VISITS.flip_obs} AND apart <= {2 * VISITS.flip_s}),
{out}_s{r} AS (SELECT n.id, n.person_id, coalesce(f.before, n.path_id) AS path_id, n.ts FROM {out}_n{r} n LEFT JOIN {out}_f{r} f USING (person_id, no))""")
            seen = f"{out}_s{r}"
    sql.append(f"{out} AS (SELECT person_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY no) AS INTEGER) AS visit_idx, path_id, enter_ts, exit_ts, n_obs FROM {out}_v{rounds})")
    return ",\n".join(sql)


_WALK = f"""walk(from_path, cur, length_m, via_hidden, seen) AS (
SELECT from_path, to_path, 0::DOUBLE, false, [from_path, to_path] FROM edges
UNION ALL SELECT w.from_path, e.to_path, w.length_m + p.length_m, w.via_hidden OR w.cur = '{SITE.hidden}', list_append(w.seen, e.to_path)
FROM walk w JOIN edges e ON e.from_path = w.cur JOIN paths p ON p.id = w.cur WHERE NOT list_contains(w.seen, e.to_path))"""
_ROUTES = _WALK + f""",
route_times AS (SELECT from_path, cur AS to_path, via_hidden, count(*) AS n_routes, min(length_m) / {SITE.v_max}::DOUBLE AS min_seconds, max(length_m) / {SITE.v_min}::DOUBLE AS max_seconds FROM walk GROUP BY ALL)"""
_INTERVALS = _WALK + f""",
cams AS (SELECT camera AS cam, id FROM paths WHERE camera IS NOT NULL),
intervals AS (SELECT DISTINCT a.cam AS cam_a, b.cam AS cam_b, length_m / {SITE.v_max}::DOUBLE - {SITE.jitter}::DOUBLE AS lo, length_m / {SITE.v_min}::DOUBLE + {SITE.slack}::DOUBLE AS hi FROM walk JOIN cams a ON a.id = from_path JOIN cams b ON b.id = cur
UNION ALL SELECT cam, cam, -{SITE.jitter}::DOUBLE, {2 * SITE.slack}::DOUBLE FROM cams)"""
_ANCHORS = f"""near AS (SELECT DISTINCT i.incident_id, i.t, o.person_id FROM incidents i JOIN obs o ON o.ts BETWEEN i.t - {WINDOW} AND i.t + {WINDOW}),
bef AS (SELECT n.incident_id, n.person_id, o.path_id AS a, o.ts AS ta FROM near n JOIN obs o USING (person_id) WHERE o.ts < n.t QUALIFY row_number() OVER (PARTITION BY n.incident_id, n.person_id ORDER BY o.ts DESC, o.id DESC) = 1),
aft AS (SELECT n.incident_id, n.person_id, o.path_id AS b, o.ts AS tb FROM near n JOIN obs o USING (person_id) WHERE o.ts >= n.t QUALIFY row_number() OVER (PARTITION BY n.incident_id, n.person_id ORDER BY o.ts, o.id) = 1),
anch AS (SELECT n.incident_id, n.person_id, a, ta, b, tb FROM near n LEFT JOIN bef USING (incident_id, person_id) LEFT JOIN aft USING (incident_id, person_id))"""
_CANDIDATES = _ROUTES + ",\n" + _ANCHORS + f""",
cands AS (SELECT incident_id, person_id, a, ta, b, tb, tb - ta AS gap_s, r.min_seconds AS min_crossing_s,
CASE WHEN ta IS NULL THEN 'no sighting before'
WHEN tb IS NULL AND EXISTS (SELECT 1 FROM edges e WHERE e.from_path = a AND e.to_path = '{SITE.hidden}') THEN 'pending: may be inside, not seen again yet'
WHEN tb IS NULL THEN 'no sighting after' WHEN a = b THEN 'same path before and after' WHEN r.min_seconds IS NULL THEN 'no route through hidden path'
WHEN tb - ta < r.min_seconds - {SITE.slack} THEN 'impossible: reached too fast' ELSE 'possible' END AS status
FROM anch LEFT JOIN route_times r ON r.from_path = a AND r.to_path = b AND r.via_hidden)"""
_LABELS = f"""labels_ AS (SELECT n.incident_id, n.person_id, CAST(EXISTS (SELECT 1 FROM truth g WHERE g.person_id = n.person_id AND n.t BETWEEN g.start_time AND g.end_time) AS INTEGER) AS in_hidden
FROM (SELECT DISTINCT i.incident_id, i.t, o.person_id FROM incidents i JOIN obs o ON o.ts >= i.t - {WINDOW} AND o.ts < i.t + {WINDOW}) n)"""
_R1 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(18,6)), 1) AS DOUBLE)"
_R0 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(18,6)), 0) AS DOUBLE)"
_HALVES = "WITH c AS (SELECT label::BIGINT AS track_id, 2 * row_number() OVER (PARTITION BY label ORDER BY vec_id) <= count(*) OVER w AS early, CAST(embedding AS DOUBLE[]) AS e, count(*) OVER w AS n FROM embeddings WHERE label IS NOT NULL WINDOW w AS (PARTITION BY label)), u AS (SELECT track_id, early, generate_subscripts(e, 1) AS i, unnest(e) / greatest(sqrt(list_dot_product(e, e)), 1e-9) AS x FROM c WHERE n >= {least}), m AS (SELECT track_id, early, i, avg(x) AS x FROM u GROUP BY ALL), v AS (SELECT track_id, early, list(x ORDER BY i) AS e FROM m GROUP BY ALL), p AS (SELECT b.track_id, a.track_id AS nearest, list_dot_product(a.e, b.e) / (greatest(sqrt(list_dot_product(a.e, a.e)), 1e-9) * greatest(sqrt(list_dot_product(b.e, b.e)), 1e-9)) AS s FROM v a JOIN v b ON a.early AND NOT b.early)"
_VOTES = "votes AS (SELECT label::BIGINT AS g, user_id % 10 AS p, vec_id FROM embeddings JOIN events ON vec_id = event_id)"


_LEFT = "SELECT path_id AS from_path, to_path, seconds FROM (SELECT *, lead(path_id) OVER w AS to_path, lead(ts) OVER w - ts AS seconds FROM {rows} WINDOW w AS (PARTITION BY person_id ORDER BY ts, id)) WHERE to_path <> path_id"
_MEDIAN = "SELECT from_path AS id, seconds FROM (SELECT *, row_number() OVER (PARTITION BY from_path ORDER BY seconds) AS r, count(*) OVER (PARTITION BY from_path) AS n FROM {rows}) WHERE r = greatest(1, ceil(n * 0.5))"
_SURVEY = f"""ev AS (SELECT event_id AS id, user_id AS person_id, event_type AS path_id, epoch(ts) AS ts FROM events),
dep AS ({_LEFT.format(rows='ev')}),
edges AS (SELECT from_path, to_path FROM (SELECT *, sum(n) OVER (PARTITION BY from_path) AS total FROM (SELECT from_path, to_path, count(*) AS n FROM dep GROUP BY ALL)) WHERE n >= total * {SUPPORT}),
paths AS (SELECT id, coalesce(floor(seconds), 0)::DOUBLE AS length_m, CASE WHEN id <> '{SITE.hidden}' THEN 'cam_' || id END AS camera FROM (SELECT DISTINCT path_id AS id FROM ev WHERE path_id IS NOT NULL) LEFT JOIN ({_MEDIAN.format(rows='dep')}) USING (id))"""


def _surveyed(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((_SURVEY, *parts)) + "\n"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join((_BASE, *parts)) + "\n"


_GLOB = "SELECT path_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY path_id"
_V0, _V5 = _visits_sql(0), _visits_sql(VISITS.rounds)
_VISIT = "person_id, visit_idx, path_id, enter_ts, exit_ts, n_obs"

ORACLE_SQL: dict[str, str] = {
    "visits_basic": _with(_V0) + f"SELECT {_VISIT} FROM visits",
    "visits_repaired": _with(_V5) + f"SELECT {_VISIT} FROM visits",
    "trajectories": _with(_V5) + "SELECT person_id, path_id, enter_ts AS start_time, exit_ts AS end_time, 'observed' AS source, 1.0::DOUBLE AS confidence FROM visits",
    "person_timeline": _with(_V5) + f"SELECT visit_idx, path_id, {_R1('enter_ts')} AS enter_s, {_R1('exit_ts')} AS exit_s, {_R1('exit_ts - enter_ts')} AS stay_s, n_obs FROM visits WHERE person_id = {PERSON}",
    "near_hidden": _with(_V5) + f"SELECT person_id, path_id, {_R1('enter_ts')} AS first_seen, {_R1('exit_ts')} AS last_seen, n_obs FROM visits WHERE path_id IN (SELECT from_path FROM edges WHERE to_path = '{SITE.hidden}' UNION SELECT to_path FROM edges WHERE from_path = '{SITE.hidden}') AND exit_ts >= {INCIDENTS[1][1] - WINDOW} AND enter_ts <= {INCIDENTS[1][1] + WINDOW}",
    "anchors": _with(_ANCHORS) + f"SELECT person_id, a AS last_path, {_R1('ta')} AS last_ts, b AS next_path, {_R1('tb')} AS next_ts, {_R1('tb - ta')} AS gap_s FROM anch WHERE incident_id = {ONE}",
    "path_stats": _with(_V5) + "SELECT p.id AS path_id, p.camera IS NOT NULL AS has_camera, count(v.person_id) AS visits, CAST(round(CAST(CAST(sum(CAST(v.exit_ts - v.enter_ts AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(v.person_id), 0) AS DECIMAL(18,6)), 1) AS DOUBLE) AS avg_stay_s, CAST(round(CAST(CAST(list_sort(list(CAST(v.exit_ts - v.enter_ts AS DECIMAL(18,6))) FILTER (v.person_id IS NOT NULL))[(count(v.person_id) + 1) // 2] + list_sort(list(CAST(v.exit_ts - v.enter_ts AS DECIMAL(18,6))) FILTER (v.person_id IS NOT NULL))[count(v.person_id) // 2 + 1] AS DOUBLE) / 2 AS DECIMAL(18,6)), 1) AS DOUBLE) AS median_stay_s FROM paths p LEFT JOIN visits v ON v.path_id = p.id GROUP BY p.id, p.camera",
    "route_times": _surveyed(_ROUTES) + "SELECT * FROM route_times",
    "route_times_near_hidden": _surveyed(_ROUTES) + f"SELECT from_path, to_path, via_hidden, n_routes, {_R0('min_seconds')} AS min_s, {_R0('max_seconds')} AS max_s FROM route_times WHERE from_path IN (SELECT from_path FROM edges WHERE to_path = '{SITE.hidden}')",
    "candidates": _with(_CANDIDATES, recursive=True) + "SELECT * FROM cands",
    "candidate_summary": _with(_CANDIDATES, recursive=True) + "SELECT incident_id, status, count(*) AS people FROM cands GROUP BY ALL",
    "feasibility_eval": _with(_CANDIDATES, _LABELS, recursive=True) + "SELECT status, CAST(sum(in_hidden) AS BIGINT) AS truly_inside, CAST(count(*) - sum(in_hidden) AS BIGINT) AS not_inside, count(*) AS total FROM cands JOIN labels_ USING (incident_id, person_id) GROUP BY status",
    "visit_recall": _with(_V5, "stays AS (SELECT person_id, path_id, ts AS start_time, ts + 60.0 AS end_time FROM obs)") + "SELECT path_id, count(*) AS true_stays, CAST(sum(hit) AS BIGINT) AS found, CAST(round(CAST(100.0::DOUBLE * sum(hit) / count(*) AS DECIMAL(18,6)), 1) AS DOUBLE) AS pct_found FROM (SELECT g.path_id, CAST(EXISTS (SELECT 1 FROM visits v WHERE v.person_id = g.person_id AND v.path_id = g.path_id AND v.enter_ts <= g.end_time + 5 AND v.exit_ts >= g.start_time - 5) AS INTEGER) AS hit FROM stays g JOIN paths p ON p.id = g.path_id AND p.camera IS NOT NULL) GROUP BY path_id",
    "presence_labels": _with(_LABELS) + "SELECT * FROM labels_",
    "topology_intervals": _surveyed(_INTERVALS) + "SELECT * FROM intervals",
    "topology_horizon": _surveyed(_INTERVALS) + "SELECT max(hi) AS max_gap FROM intervals",
    "track_pair_gate": _with(_INTERVALS, "tr AS (SELECT vec_id, 'cam_' || path_id AS cam, ts, embedding FROM embeddings JOIN obs ON vec_id = id)", recursive=True) + "SELECT DISTINCT a.vec_id AS track_a, b.vec_id AS track_b, b.ts - a.ts AS gap, CAST(CAST(1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DECIMAL(18,6)) AS DOUBLE) AS distance FROM tr a JOIN tr b ON a.vec_id <> b.vec_id JOIN intervals i ON i.cam_a = a.cam AND i.cam_b = b.cam AND b.ts - a.ts BETWEEN i.lo AND i.hi",
    "track_pair_counts": _with(_INTERVALS, "tr AS (SELECT vec_id, 'cam_' || path_id AS cam, ts FROM embeddings JOIN obs ON vec_id = id)", recursive=True) + "SELECT a.cam AS cam_a, b.cam AS cam_b, count(*) AS pairs FROM tr a JOIN tr b ON a.vec_id <> b.vec_id AND EXISTS (SELECT 1 FROM intervals i WHERE i.cam_a = a.cam AND i.cam_b = b.cam AND b.ts - a.ts BETWEEN i.lo AND i.hi) GROUP BY ALL",
    "track_summary": "WITH d AS (SELECT l_returnflag AS camera_id, l_suppkey AS track_id, epoch(l_shipdate) AS ts, l_quantity AS x, l_extendedprice AS y, 1.0::DOUBLE - l_discount AS c, row_number() OVER w AS up, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS down FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) SELECT * FROM (SELECT camera_id, track_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_frames, CAST(sum(CAST(c AS DECIMAL(18,9))) AS DOUBLE) / count(c) AS mean_conf, max(x) FILTER (up = 1) AS entry_x, max(y) FILTER (up = 1) AS entry_y, max(x) FILTER (down = 1) AS exit_x, max(y) FILTER (down = 1) AS exit_y FROM d GROUP BY ALL) WHERE n_frames >= 15 AND mean_conf >= 0.4",
    "track_densify": "WITH s AS (SELECT o_custkey AS person_id, o_orderstatus AS path_id, min(epoch(o_orderdate)) AS a, max(epoch(o_orderdate)) AS b FROM orders GROUP BY ALL) SELECT DISTINCT person_id, 'cam_' || path_id AS camera_id, path_id, ts, 'track' AS source FROM (SELECT person_id, path_id, unnest(list_append(list_transform(range(0, CAST(ceil((b - a) / 2592000.0) AS BIGINT)), lambda i: a + i * 2592000.0::DOUBLE), b)) AS ts FROM s)",
    "identity_majority": f"WITH {_VOTES}, n AS (SELECT g, p, count(*) AS n FROM votes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, p) AS k, CAST(sum(n) OVER (PARTITION BY g) AS BIGINT) AS t FROM n) SELECT g AS global_person_id, p AS true_id, n / t::DOUBLE AS purity, t AS n_labelled, t AS n_tracks FROM r WHERE k = 1",
    "fragmented_persons": f"WITH {_VOTES}, n AS (SELECT g, p, count(*) AS n FROM votes GROUP BY ALL), r AS (SELECT g, p FROM n QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, p) = 1) SELECT p AS true_id, count(*) AS n_identities FROM r GROUP BY p HAVING count(*) > 1",
    "missing_participants": f"SELECT DISTINCT CAST(c_custkey AS BIGINT) AS person_no FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> '{SITE.hidden}')",
    "reid_counts": f"WITH {_VOTES} SELECT count(DISTINCT g) AS n_identities, count(DISTINCT p) AS n_persons FROM votes",
    "pairwise_reid": f"WITH {_VOTES}, c AS (SELECT count(*) FILTER (a.g = b.g AND a.p = b.p)::DOUBLE AS tp, count(*) FILTER (a.g = b.g)::DOUBLE AS linked, count(*) FILTER (a.p = b.p)::DOUBLE AS wanted FROM votes a JOIN votes b ON a.vec_id < b.vec_id) SELECT tp / linked AS \"precision\", tp / wanted AS recall, 2 * tp / (linked + wanted) AS f1, (SELECT count(*) FROM (SELECT p FROM votes GROUP BY p HAVING count(DISTINCT g) > 1)) AS fragmented, (SELECT count(*) FROM (SELECT g FROM votes GROUP BY g HAVING count(DISTINCT p) > 1)) AS merged FROM c",
    "timeline_repeat_check": _with(_V5) + f"SELECT person_id, visit_idx, path_id FROM (SELECT *, lead(path_id) OVER w AS np, lead(enter_ts) OVER w - exit_ts AS gap FROM visits WINDOW w AS (PARTITION BY person_id ORDER BY visit_idx)) WHERE np = path_id AND gap <= {VISITS.split_gap}",
    "full_outer_diff": _with(_visits_sql(0, "a"), _visits_sql(VISITS.rounds, "b")) + "SELECT person_id, path_id, enter_ts, exit_ts, n_obs, 'left' AS side FROM a WHERE (person_id, path_id, enter_ts, exit_ts, n_obs) NOT IN (SELECT (person_id, path_id, enter_ts, exit_ts, n_obs) FROM b) UNION ALL SELECT person_id, path_id, enter_ts, exit_ts, n_obs, 'right' FROM b WHERE (person_id, path_id, enter_ts, exit_ts, n_obs) NOT IN (SELECT (person_id, path_id, enter_ts, exit_ts, n_obs) FROM a)",
    "run_visits": _with("m AS (SELECT *, CASE WHEN path_id IS DISTINCT FROM lag(path_id) OVER w OR lag(id) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM obs WINDOW w AS (PARTITION BY person_id ORDER BY ts, id))", "n AS (SELECT *, sum(s) OVER (PARTITION BY person_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS no FROM m)") + "SELECT person_id, CAST(no AS BIGINT) AS visit_no, min(path_id) AS path_id, min(ts) AS start_time, max(ts) AS end_time FROM n GROUP BY person_id, no",
    "nearest_tracks": "WITH p AS (SELECT v.vec_id AS id, r.vec_id AS ref_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS s FROM embeddings v JOIN embeddings r ON v.vec_id % 100 = 0 AND r.vec_id <> v.vec_id) SELECT id, ref_id, CAST(CAST(s AS DECIMAL(18,6)) AS DOUBLE) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, ref_id) = 1",
    "match_each_start": _with(_INTERVALS, """tr AS (SELECT vec_id, 'cam_' || path_id AS cam, ts, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY ts, 'cam_' || path_id, vec_id) AS n FROM embeddings JOIN obs ON vec_id = id WHERE embedding IS NOT NULL),
gt AS (SELECT vec_id, list({'c': cam_a, 'lo': lo, 'hi': hi}) AS gates FROM tr JOIN intervals ON cam_b = cam GROUP BY vec_id),
st(n, known, best) AS (SELECT 0::BIGINT, CAST([] AS STRUCT(name VARCHAR, looks DOUBLE[], c VARCHAR, until DOUBLE)[]), CAST(NULL AS STRUCT(d DOUBLE, name VARCHAR))
UNION ALL SELECT n, CASE WHEN best IS NULL THEN list_append(known, {'name': cam || '/' || vec_id, 'looks': e, 'c': cam, 'until': ts}) ELSE list_transform(known, lambda k: CASE WHEN k.name = best.name THEN {'name': k.name, 'looks': list_transform(list_zip(k.looks, e), lambda z: z[1] + z[2]), 'c': cam, 'until': greatest(k.until, ts)} ELSE k END) END, best
FROM (SELECT t.*, known, list_sort(list_filter(list_transform(list_filter(known, lambda k: len(list_filter(gates, lambda g: g.c = k.c AND t.ts - k.until BETWEEN g.lo AND g.hi)) > 0), lambda k: {'d': 1 - list_dot_product(k.looks, t.e) / greatest(sqrt(list_dot_product(k.looks, k.looks)), 1e-9), 'name': k.name}), lambda b: b.d <= 0.6))[1] AS best FROM st JOIN tr t ON t.n = st.n + 1 LEFT JOIN gt USING (vec_id)))""", recursive=True) + "SELECT 'all' AS site, vec_id AS track_id, cam AS camera_id, ts AS start_time, ts AS end_time, coalesce(best.name, cam || '/' || vec_id) AS global_id, CAST(CAST(best.d AS DECIMAL(18,6)) AS DOUBLE) AS match_dist FROM st JOIN tr USING (n)",
    "risk_levels": "SELECT event_id, CASE WHEN NOT value / 100 < 1 OR value IS NULL THEN 'PENDING' WHEN value / 100 >= 0.8 THEN 'HIGH' WHEN value / 100 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM events",
    "label_rate": _with(_LABELS) + "SELECT count(*) AS incidents, CAST(sum(rows) AS BIGINT) AS rows, avg(n) AS mean_inside FROM (SELECT incident_id, sum(in_hidden) AS n, count(*) AS rows FROM labels_ GROUP BY incident_id)",
    "candidate_report": _with(_CANDIDATES, recursive=True) + f"SELECT person_id, a AS last_path, {_R1('ta')} AS last_ts, b AS next_path, {_R1('tb')} AS next_ts, {_R1('gap_s')} AS gap_s, {_R0('min_crossing_s')} AS min_crossing_s, status FROM cands WHERE incident_id = {ONE}",
    "half_match": _HALVES.format(least=2) + " SELECT track_id, nearest, CAST(CAST(s AS DECIMAL(18,6)) AS DOUBLE) AS similarity, track_id = nearest AS is_self FROM p QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, nearest) = 1",
    "half_report": _HALVES.format(least=4) + ", b AS (SELECT track_id, track_id = nearest AS is_self FROM p QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, nearest) = 1) SELECT n AS tracks, CAST(CAST(r AS DECIMAL(18,6)) AS DOUBLE) AS rank_1, CAST(CAST(1.0::DOUBLE / n AS DECIMAL(18,6)) AS DOUBLE) AS chance, CAST(CAST(own AS DECIMAL(18,6)) AS DOUBLE) AS mean_own, CAST(CAST(other AS DECIMAL(18,6)) AS DOUBLE) AS mean_other FROM (SELECT count(*) AS n, avg(CAST(is_self AS DOUBLE)) AS r FROM b), (SELECT avg(s) FILTER (track_id = nearest) AS own, avg(s) FILTER (track_id <> nearest) AS other FROM p)",
    "identity_report": f"WITH t AS (SELECT user_id AS u, CASE WHEN vec_id % 4 = 0 THEN label END AS p FROM embeddings JOIN events ON vec_id = event_id), n AS (SELECT u, p, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY ALL), m AS (SELECT u, max(n) / sum(n)::DOUBLE AS purity FROM n GROUP BY u) SELECT count(*) AS identities, count(purity) AS labelled, count(*) - count(purity) AS unlabelled, CAST(sum(CAST(purity AS DECIMAL(18,9))) AS DOUBLE) / count(purity) AS mean_purity, count(*) FILTER (purity < 1) AS impure FROM (SELECT DISTINCT u FROM t) LEFT JOIN m USING (u)",
    "identity_presence": f"WITH {_VOTES}, n AS (SELECT g, p, count(*) AS n FROM votes GROUP BY ALL), r AS (SELECT g, p FROM n QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, p) = 1) SELECT g AS person_id, o_orderstatus AS path_id, min(epoch(o_orderdate)) AS start_time, max(epoch(o_orderdate)) AS end_time FROM r JOIN orders ON o_custkey = p GROUP BY ALL",
    "embedding_coverage": _with() + "SELECT count(*) AS tracks, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing FROM obs LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = id",
    "csv_sightings": _with() + "SELECT person_id, camera AS camera_id, path_id, ts, 'sim' AS source FROM obs LEFT JOIN paths ON paths.id = path_id",
    "glob_sightings": _with() + _GLOB,
    "graph_document": _surveyed() + "SELECT from_path, to_path, p.length_m, p.camera IS NOT NULL AS has_camera, q.camera AS to_camera FROM edges JOIN paths p ON p.id = from_path JOIN paths q ON q.id = to_path",
    "run_meta": _with(f"dep AS ({_LEFT.format(rows='obs')})") + f"SELECT * FROM (VALUES ('hidden_path', '{SITE.hidden}'), ('v_min_mps', '{SITE.v_min}'), ('v_max_mps', '{SITE.v_max}'), ('time_slack_s', '{SITE.slack}'), ('source', 'sim'), ('preset', 'events')) AS m(key, value) UNION ALL SELECT 'p_detect', CAST(round(count(*) FILTER (event_type <> '{SITE.hidden}') / count(event_type)::DOUBLE, 6) AS VARCHAR) FROM events UNION ALL SELECT 'obs_period_s', CAST(floor(seconds)::DOUBLE AS VARCHAR) FROM ({_MEDIAN.format(rows='(SELECT 1 AS from_path, seconds FROM dep)')})",
    "persons": _with() + "SELECT DISTINCT person_id AS id, printf('Person_%04d', person_id + 1) AS label FROM obs",
    "incident_rows": f"SELECT CAST(event_id + 1 AS INTEGER) AS id, '{SITE.hidden}' AS affected_path_id, epoch(ts) AS start_time, 1.0::DOUBLE AS severity, 'simulated' AS status FROM events WHERE event_type = '{SITE.hidden}'",
    "sql_file": _with() + f"SELECT path_id, count(*) AS n, min(ts) AS first_ts FROM obs WHERE ts >= {INCIDENTS[1][1]} GROUP BY path_id",
    "source_reload": _with() + "SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n, min(ts) AS first_ts FROM obs WHERE id % 3 <> 0 AND (id % 2 = 0 OR person_id < 50) GROUP BY ALL",
    "person_labels": _with() + "SELECT DISTINCT person_id, printf('Person_%04d', person_id + 1) AS label, person_id + 1 AS number FROM obs",
}
ORACLE_SQL |= {"stream_visits": ORACLE_SQL["visits_repaired"], "stream_identities": ORACLE_SQL["match_each_start"], "stream_candidates": ORACLE_SQL["candidates"], "lateral_candidates": ORACLE_SQL["candidates"]}
