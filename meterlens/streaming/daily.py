"""Readings as they arrive: energy by meter, direction and day. An extension; the batch operators need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_energy(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """stream (mp_id, obis, ts: timestamp, kwh) -> mp_id, obis, d, kwh, n; a day is final once the watermark is past it. Repeated readings count once."""
    once = stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["mp_id", "obis", "ts"])
    day = F.window("ts", "1 day")
    out = once.groupBy("mp_id", "obis", day.alias("w")).agg(F.sum("kwh").alias("kwh"), F.count("kwh").alias("n"))
    return out.select("mp_id", "obis", F.to_date("w.start").alias("d"), "kwh", "n")
