"""Readings: wide and long, without duplicates, import beside export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_dst_day, local_time, slot_time
from ..schema import EXPORT_PREFIX, IMPORT_PREFIX, MAX_SLOTS


def deduplicated(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in an order that should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def padded(slots: Column, n: int = MAX_SLOTS) -> Column:
    """Slots up to n, the missing ones null."""
    return F.slice(F.concat(slots, F.array_repeat(F.lit(None).cast("double"), n)), 1, n)


def to_wide(long: DataFrame, keys: list[str], slot: str = "slot_idx", value: str = "kwh") -> DataFrame:
    """A row for each key with the array of its slots; of a slot met twice the largest value."""
    by_slot = F.map_from_entries(F.collect_list(F.struct(F.col(slot).cast("int"), F.col(value))))
    once = long.groupBy(*keys, slot).agg(F.max(value).alias(value))
    wide = once.groupBy(*keys).agg(by_slot.alias("__m"))
    return wide.withColumn("slots", F.transform(F.sequence(F.lit(1), F.lit(MAX_SLOTS)), lambda i: F.try_element_at("__m", i))).drop("__m")


def to_long(wide: DataFrame, slots: str = "slots") -> DataFrame:
    """A row for each slot that has a value: slot_idx, ts and kwh beside the other columns. No shuffle."""
    rest = [c for c in wide.columns if c != slots]
    rows = wide.select(*rest, F.posexplode(slots).alias("__pos", "kwh")).filter("kwh is not null")
    rows = rows.withColumn("slot_idx", (F.col("__pos") + 1).cast("long")).drop("__pos")
    return rows.withColumn("ts", slot_time("d", "slot_idx"))


def of_meters(readings: DataFrame, meters: DataFrame, key: str = "mp_id") -> DataFrame:
    """Readings of the listed meters; a semi join, so that it is done before slots are exploded."""
    return readings.join(meters.select(key).distinct(), key, "left_semi")


def side_by_side(long: DataFrame, keys: list[str]) -> DataFrame:
    """import_kwh and export_kwh by key, largest where several; dst_day by the source's date."""
    best = lambda prefix: F.max(F.when(F.col("obis").startswith(prefix), F.col("kwh")))
    out = long.groupBy(*keys).agg(best(IMPORT_PREFIX).alias("import_kwh"), best(EXPORT_PREFIX).alias("export_kwh"))
    return out.withColumn("dst_day", is_dst_day("d"))


def split_signed(df: DataFrame, value: str = "kwh") -> DataFrame:
    """Positive values as import, negative ones as export; a null is 0 in both."""
    v = F.col(value)
    return df.withColumn("import_kwh", F.when(v > 0, v).otherwise(0.0)).withColumn("export_kwh", F.when(v < 0, -v).otherwise(0.0))


def localized(frame: DataFrame, source: str = "Etc/GMT-1") -> DataFrame:
    """ts as wall-clock time, and d and hour from it; dst_day stays as it was made from the source's date."""
    out = frame.withColumn("ts", local_time("ts", source))
    return out.withColumn("d", F.to_date("ts")).withColumn("hour", F.hour("ts"))
