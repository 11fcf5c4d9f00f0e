"""Readers and writers of tables and parametrised SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.scalar import person_label
from waymark.plans.schema import TABLES
from waymark.sources.graph import PathGraph


def read_csv(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """CSV files with a header, globs included, in the table's schema; columns are taken in the file's order."""
    return spark.read.schema(TABLES[table]).option("header", True).option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Full reload of a table."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_source(df: DataFrame, path: str, sources: list[str] | None = None) -> None:
    """Replace all rows of the named sources by those of ``df``, none included; rows of other sources stay.

    ``sources`` None: those that ``df`` has rows of. Naming one that ``df`` has no row of deletes it."""
    spark = df.sparkSession
    if sources is not None:
        df = df.where(F.col("source").isin(sources))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    if sources:
        held = {r["source"] for r in df.select("source").distinct().collect()}  # of the few that are named
        part = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for name in set(sources) - held:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part('source', name)}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_sightings(observations: DataFrame, path: str, parts: int) -> None:
    """Sightings clustered by person and time, so that row-group statistics prune reads by person."""
    observations.repartitionByRange(parts, "person_id", "ts").sortWithinPartitions("person_id", "ts").write.mode("overwrite").parquet(path)


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql_file(spark: SparkSession, path: str, params: dict | None = None) -> DataFrame:
    """A query file with ``:name`` parameters; comment lines are dropped first."""
    text = "\n".join(x for x in Path(path).read_text().splitlines() if not x.lstrip().startswith("--"))
    return spark.sql(text.strip().rstrip(";"), args=params or {})


def typed_param(text: str) -> int | float | str:
    """A command line's value: a number with a point is a float, other digits an int, anything else text."""
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def limited(df: DataFrame, n: int = 40) -> DataFrame:
    """For display only."""
    return df.limit(n)


def persons_of(observations: DataFrame) -> DataFrame:
    ids = observations.select(F.col("person_id").alias("id")).where("id is not null").distinct()
    return ids.select("id", person_label(F.col("id")).alias("label"))


def raw_sightings(rows: DataFrame, graph: PathGraph) -> DataFrame:
    """(person_id, path_id, timestamp) as observations with the path's camera; the id is a hash of the three."""
    cameras = graph.camera_table().select(F.col("id").alias("camera_id"), F.col("path_id"))
    named = rows.withColumnRenamed("timestamp", "ts").join(F.broadcast(cameras), "path_id", "left")
    return named.select(F.xxhash64("person_id", "path_id", "ts").alias("id"), "person_id", "camera_id", "path_id", "ts", F.lit("sim").alias("source"))


def rebased_incidents(rows: DataFrame, hidden: str) -> DataFrame:
    """(incident_id from 0, time) as incidents numbered from 1."""
    return rows.select((F.col("incident_id") + 1).cast("int").alias("id"), F.lit(hidden).alias("affected_path_id"), F.col("time").alias("start_time"), F.lit(1.0).alias("severity"), F.lit("simulated").alias("status"))


def crops(spark: SparkSession, root: str) -> DataFrame:
    """(camera_id, track_id, files) of image crops stored as root/camera/track/frame.jpg; pixels are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root).select("path")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.jpg$", i)
    return files.groupBy(part(1).alias("camera_id"), part(2).cast("int").alias("track_id")).agg(F.array_sort(F.collect_list("path")).alias("files"))
