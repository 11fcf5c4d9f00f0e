"""Matching of a stream of tracks: the identities of a site are state that expires.

The same gallery as in the batch operator, with the same names for identities. Tracks wait until the watermark has passed
the end of their batch, so that late ones within its delay still find their place; an identity goes as soon as no later
track can join it. Waiting tracks are stored in blocks and vectors as the bytes of their doubles, since a value's and a number's way to the JVM costs more than the matching. State and timers are in Spark's checkpoint, so a query that starts again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from waymark.operators.matching import MATCHED, Gallery, Gate, Identity, MatchParams, as_track, in_order
from waymark.streaming.state import after, packed, prepared, put, timed, unpacked

COLUMNS = ["track_id", "camera_id", "start_time", "end_time", "emb"]


class SiteGallery(StatefulProcessor):
    """A site's tracks that wait for their batch to be whole, and its identities that a later track may still join."""

    def __init__(self, gate: Gate, params: MatchParams):
        self.gate, self.params = gate, params

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "track_id array<long>, camera_id array<string>, start_time array<double>, end_time array<double>, emb array<binary>")
        self.known = handle.getListState("known", "name string, looks binary, camera string, until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        more = list(packed((*(row[c] for c in COLUMNS[:4]), np.asarray(row["emb"], np.float64).tobytes()) for row in rows))
        if more:
            self.waiting.appendList(more)  # at once: each append reads what is there
            self.handle.registerTimer(after(min(min(block[2]) for block in more) + self.params.batch_s))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = in_order([dict(zip(COLUMNS, (*row[:4], np.frombuffer(row[4])), strict=True)) for row in unpacked(self.waiting.get())])
        gallery = Gallery(self.gate, self.params.max_dist, [Identity(r[0], np.frombuffer(r[1]), r[2], r[3]) for r in self.known.get()])
        batches, done = [], 0
        while done < len(waiting) and after(waiting[done]["start_time"] + self.params.batch_s) <= passed:
            anchor, end = waiting[done]["start_time"], done
            while end < len(waiting) and waiting[end]["start_time"] <= anchor + self.params.batch_s:
                end += 1
            batches.append((anchor, waiting[done:end]))
            done = end
        found = gallery.run((anchor, [as_track(r) for r in batch]) for anchor, batch in batches)
        for (_, batch), taken in zip(batches, found, strict=True):
            for row, (name, dist) in zip(batch, taken, strict=True):
                yield Row(site=key[0], **{c: row[c] for c in COLUMNS[:4]}, global_id=name, match_dist=dist)
        gallery.forget(passed / 1000, now=True)
        known = gallery.known()
        put(self.waiting, list(packed((*(row[c] for c in COLUMNS[:4]), row["emb"].tobytes()) for row in waiting[done:])))
        put(self.known, [(k.name, k.looks.tobytes(), k.camera, k.until) for k in known])
        if done < len(waiting):
            self.handle.registerTimer(after(waiting[done]["start_time"] + self.params.batch_s))
        if known:
            self.handle.registerTimer(max(passed + 1, after(min(k.until for k in known) + self.gate.reach)))


def matched_stream(tracks: DataFrame, gate: Gate, params: MatchParams = MatchParams(), late: str = "60 seconds") -> DataFrame:
    """The rows of ``match_tracks`` for a stream of tracks (site, track_id, camera_id, start_time, end_time, emb), once each.

    A track is sent when the watermark, ``late`` behind the newest start, has passed its batch; tracks that come later than
    that are dropped, and what is sent is the batch operator's answer for the others. Tracks without a time or a vector are
    left out. Append mode.
    """
    prepared(tracks.sparkSession)
    rows = tracks.where("end_time is not null and emb is not null").select(F.col("site").cast("string").alias("site"), F.col("track_id").cast("long").alias("track_id"), "camera_id", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), F.col("emb").cast("array<double>").alias("emb"))
    return timed(rows, "start_time", late).groupBy("site").transformWithState(SiteGallery(gate, params), MATCHED, "append", "eventTime")
