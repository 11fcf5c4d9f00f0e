"""Candidates of incidents kept up to date while sightings arrive.

Each micro-batch changes the anchors of few candidates: those whose person has a new sighting nearer to the incident, and
persons who come into the window for the first time. Only these are computed and sent; the rest of the table stays as it is.

The stored state is a history of sightings, in buckets by person, and the anchors as a base with changes of later batches
over it. Both are written once per batch number, so a batch that is given again after a failure leaves the same files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.candidates import classified, in_window
from waymark.plans.config import SiteParams

ANCHOR = "struct<ts: double, id: long, path_id: string>"
STATE = f"incident_id int, t double, person_id long, a {ANCHOR}, b {ANCHOR}, batch long"
HISTORY = "id long, person_id long, path_id string, ts double, batch long, bucket int"


@dataclass(frozen=True)
class UpkeepParams:
    """window: seconds around an incident. buckets: of the history, by person. fold: batches after which changes become a new base."""

    window: float = 900.0
    buckets: int = 64
    fold: int = 32


class CandidateUpkeep:
    """Keeps ``incident_candidates`` of fixed incidents (incident_id, t) in a shared folder.

    route_times and edges are the network's. Give batches of sightings (id, person_id, path_id, ts) with rising numbers to
    ``apply``, by itself or as ``foreachBatch``; ``table`` is the whole answer so far, ``updates(n)`` what batch n changed.
    """

    def __init__(self, folder: str, incidents: DataFrame, route_times: DataFrame, edges: DataFrame, site: SiteParams, params: UpkeepParams = UpkeepParams()):
        self.folder, self.incidents, self.route_times, self.edges, self.site, self.params = folder.rstrip("/"), incidents.select(F.col("incident_id").cast("int").alias("incident_id"), F.col("t").cast("double").alias("t")), route_times, edges, site, params
        self.spark = incidents.sparkSession

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        """Stored rows of earlier batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").where(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, batch: int, by: list[str]) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _state(self, before: int) -> DataFrame:
        """The newest anchors of each candidate: the last base and the changes since."""
        base = (before - 1) // self.params.fold * self.params.fold
        rows = self._read("base", STATE, before).where(F.col("batch") == base).unionByName(self._read("changes", STATE, before).where(F.col("batch") >= base))
        return rows.groupBy("incident_id", "t", "person_id").agg(F.max_by(F.struct("a", "b"), "batch").alias("_ab")).select("incident_id", "t", "person_id", "_ab.a", "_ab.b")

    def _bucket(self, person):
        return F.pmod(F.xxhash64(person), F.lit(self.params.buckets)).cast("int")

    @staticmethod
    def _anchors(rows: DataFrame) -> DataFrame:
        """Of (incident_id, t, person_id, id, path_id, ts) rows the last sighting before t and the first at or after it."""
        seen, before = F.struct("ts", "id", "path_id"), F.col("ts") < F.col("t")
        return rows.groupBy("incident_id", "t", "person_id").agg(F.max(F.when(before, seen)).alias("a"), F.min(F.when(~before, seen)).alias("b"))

    def apply(self, sightings: DataFrame, batch: int) -> None:
        """One batch: history first, then the candidates that it makes or changes."""
        if batch and batch % self.params.fold == 0:
            self._write(self._state(batch), "base", batch, ["batch"])
        new = sightings.where("ts is not null and person_id is not null").select(F.col("id").cast("long").alias("id"), F.col("person_id").cast("long").alias("person_id"), "path_id", F.col("ts").cast("double").alias("ts")).withColumn("bucket", self._bucket(F.col("person_id")))
        self._write(new, "history", batch, ["batch", "bucket"])
        new = self.spark.read.schema(HISTORY).parquet(f"{self.folder}/history").where(F.col("batch") == batch).drop("batch")
        known = self._state(batch).select("incident_id", "t", "person_id", F.col("a").alias("_a"), F.col("b").alias("_b"))
        # known candidates meet the batch's own sightings of their persons
        near = self._anchors(known.join(new, "person_id").select("incident_id", "t", "person_id", "id", "path_id", "ts"))
        key = ["incident_id", "t", "person_id"]
        merged = near.join(known, key).select(*key, F.greatest("a", "_a").alias("a"), F.least("b", "_b").alias("b"), "_a", "_b")
        changed = merged.where(~F.col("a").eqNullSafe(F.col("_a")) | ~F.col("b").eqNullSafe(F.col("_b"))).select(*key, "a", "b")
        # persons new to an incident's window meet their history, read from the buckets that hold them
        fresh = in_window(self.incidents, new, self.params.window).join(known.select(*key), key, "left_anti").withColumn("bucket", self._bucket(F.col("person_id")))
        past = self._read("history", HISTORY, batch + 1).join(fresh.select("bucket").distinct(), "bucket", "left_semi")
        first = self._anchors(fresh.join(past, ["bucket", "person_id"]).select("incident_id", "t", "person_id", "id", "path_id", "ts"))
        self._write(changed.unionByName(first), "changes", batch, ["batch"])

    def _classified(self, anchored: DataFrame) -> DataFrame:
        flat = anchored.select("incident_id", "t", "person_id", F.col("a.path_id").alias("a"), F.col("a.ts").alias("ta"), F.col("b.path_id").alias("b"), F.col("b.ts").alias("tb"))
        return classified(flat, self.route_times, self.edges, self.site)

    def table(self, upto: int) -> DataFrame:
        """The candidates after batch ``upto``, as ``incident_candidates`` gives them over all sightings so far."""
        return self._classified(self._state(upto + 1))

    def updates(self, batch: int) -> DataFrame:
        """Candidates that the batch made or changed, in their new state."""
        return self._classified(self._read("changes", STATE, batch + 1).where(F.col("batch") == batch).drop("batch"))
