"""Raw beacons: one JSON body with its request headers per row, from files or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.cleaning import text_field
from footfall.schema import BEACONS, MAX_EVENT_BYTES


def read_beacons(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Beacon rows (schema.BEACONS) as JSON lines, batch or stream."""
    reader = (spark.readStream if streaming else spark.read).schema(BEACONS)
    return reader.json(path)


def respect_opt_out(beacons: DataFrame) -> DataFrame:
    """Visitors who asked not to be tracked send nothing. Uses the `gpc` and `dnt` columns
    when the feed has them."""
    out = beacons
    if "gpc" in beacons.columns:
        out = out.where(~F.coalesce(F.col("gpc"), F.lit(False)))
    if "dnt" in beacons.columns:
        out = out.where(~F.coalesce(F.col("dnt").isin("1", "yes"), F.lit(False)))
    return out


def parse(beacons: DataFrame) -> DataFrame:
    """Adds `payload` (VARIANT), `public_id` and `reject`: 'too_large', 'bad_json' or null."""
    small = F.octet_length("body") <= MAX_EVENT_BYTES
    b = beacons.withColumn("payload", F.try_parse_json(F.when(small, F.col("body"))))
    is_object = F.schema_of_variant("payload").startswith("OBJECT")
    return b.withColumn("public_id", text_field(F.col("payload"), "$.s")).withColumn(
        "reject",
        F.when(~small, "too_large").when(~F.coalesce(is_object, F.lit(False)), "bad_json"))
