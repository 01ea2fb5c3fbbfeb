"""Tables of the engine as views over columnar files, and the binding of the sample tables to radio sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(column: str):
    """Seconds since 1970 of a zone-less timestamp, as a double; the session's time zone plays no part."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column}) / 1e6D")


def observations(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """events as sightings: id, ts (epoch seconds), subject, kind, value, k, lat, lon. Places are separable: jitter of 22 m, neighbours 0.9 km apart."""
    e = table(spark, sf_dir, "events")
    if stream:
        e = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes no path of a single file
    e = e.select(
        F.col("event_id").alias("id"), epoch_seconds("ts").alias("ts"), F.col("user_id").alias("subject"), F.col("event_type").alias("kind"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return e.withColumns({
        "lat": F.expr("33.4D + 0.01D * (k % 10) + 0.00005D * (id % 5)"),
        "lon": F.expr("-112.0D - 0.01D * floor(k / 10)"),
    })


#: The same binding for DuckDB; queries begin WITH and this.
OBS = """obs AS (
  SELECT event_id AS id, epoch_us(ts) / 1e6 AS ts, user_id AS subject, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         33.4::DOUBLE + 0.01::DOUBLE * (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) + 0.00005::DOUBLE * (event_id % 5) AS lat,
         -112.0::DOUBLE - 0.01::DOUBLE * floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10) AS lon
  FROM events
)"""
