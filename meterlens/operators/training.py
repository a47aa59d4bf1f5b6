"""The modelling table: one row per meter and time, with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ASSETS, DAY_SLOTS
from .register import live_flags, unambiguous
from .slots import deduplicated, of_meters, side_by_side, to_long


def training_set(wide: DataFrame, meters: DataFrame, order: list[str], only_unambiguous: bool = False, min_coverage: float = 0.0) -> DataFrame:
    """wide (mp_id, obis, d, plz, slots) of the meters in the register, long, import beside export, with flags and dates.

    min_coverage: meters with a smaller share of slots that have a value go.
    """
    if only_unambiguous:
        meters = unambiguous(meters)
    picked = deduplicated(of_meters(wide, meters), ["mp_id", "obis", "d"], order)
    if min_coverage > 0:
        share = F.avg(F.size(F.filter(F.slice("slots", 1, DAY_SLOTS), lambda x: x.isNotNull())) / F.lit(float(DAY_SLOTS)))
        picked = of_meters(picked, picked.groupBy("mp_id").agg(share.alias("__c")).filter(F.col("__c") >= min_coverage))
    rows = side_by_side(to_long(picked), ["mp_id", "plz", "ts", "d", "slot_idx"])
    return live_flags(rows.join(meters.drop("reg_plz"), "mp_id"))


def ordered(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt by ranges of the meter and sorted within: files in order without one global sort."""
    dealt = rows.repartitionByRange(partitions, "mp_id") if partitions else rows.repartitionByRange("mp_id")
    return dealt.sortWithinPartitions("mp_id", "ts")


def report(rows: DataFrame) -> DataFrame:
    share = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 1)
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("mp_id").alias("meters"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), share("import_kwh").alias("import_pct"), share("export_kwh").alias("export_pct"))


def asset_counts(rows: DataFrame, assets: tuple[str, ...] = ASSETS) -> DataFrame:
    """Per asset: meters flagged, live at some time, with a time before that, flagged not to have it. What holds of a meter at some time first, then one sum."""
    made = {}
    for a in assets:
        has, live = F.col(f"has_{a}"), F.col(f"{a}_live")
        made |= {f"{a}__flagged": has, f"{a}__live_somewhere": live, f"{a}__has_pre_period": has & ~live, f"{a}__flagged_negative": ~has}
    meters = rows.groupBy("mp_id").agg(*(F.bool_or(when).alias(n) for n, when in made.items()))
    parts = ", ".join(f"'{a}', {a}__flagged, {a}__live_somewhere, {a}__has_pre_period, {a}__flagged_negative" for a in assets)
    return meters.agg(*(F.count_if(n).alias(n) for n in made)).selectExpr(f"stack({len(assets)}, {parts}) as (asset, flagged, live_somewhere, has_pre_period, flagged_negative)")


def composition(rows: DataFrame, assets: tuple[str, ...] = ("pv", "battery", "hp")) -> DataFrame:
    """What the evaluated meters are made of: their number and the share with each asset, in whole percent. To be read before any metric."""
    meters = rows.select("mp_id", *(f"has_{a}" for a in assets)).distinct()
    return meters.agg(F.count("*").alias("meters"), *(F.round(100.0 * F.count_if(f"has_{a}") / F.count("*"), 0).alias(f"pct_{a}") for a in assets))
