"""What the stateful streams share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import attach

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are one value of a list state. Each value costs an exchange of pickled rows with the JVM, many times what it holds.
BLOCK = 1024


def prepared(spark: SparkSession) -> SparkSession:
    """Executors get the package, and state is kept in RocksDB with a column family for each variable, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return attach(spark)


def timed(rows: DataFrame, seconds: str, late: str) -> DataFrame:
    """Adds the event time of a column of seconds, rounded up to microseconds, and its watermark; rows without a time go. Seconds count from 1970,
    and a stream takes times up to then for late."""
    at = F.timestamp_micros(F.ceil(F.col(seconds) * 1e6).cast("long"))
    return rows.where(F.col(seconds).isNotNull()).withColumn("_time", at).withWatermark("_time", late)


def after(seconds: float) -> int:
    """The first millisecond of event time at which no row of these seconds or earlier can come any more."""
    return math.floor(seconds * 1000) + 2


def packed(rows: Iterable[tuple]) -> Iterator[tuple[list, ...]]:
    """Rows as blocks of columns, in their order."""
    rows = iter(rows)
    while block := list(islice(rows, BLOCK)):
        yield tuple(list(column) for column in zip(*block, strict=True))


def unpacked(blocks: Iterable[tuple]) -> Iterator[tuple]:
    """The rows of blocks of columns."""
    for block in blocks:
        yield from zip(*block, strict=True)


def put(state, rows: list[tuple]) -> None:
    """A list state's new values, if any."""
    if rows:
        state.put(rows)
    else:
        state.clear()
