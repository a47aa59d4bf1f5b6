"""The asset register: flags, dates, and the chain from register row to meter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decimal_comma, german_date, tri_state
from ..schema import ASSETS

FLAGS = {"hp": "has_hp", "pv": "has_pv", "battery": "has_battery", "ev": "has_ev", "hp_boil": "has_hp_boiler"}
DATES = {"inbetr": "commissioned", "signed": "signed", "baustart": "baustart", "uebergabe": "uebergabe"}
SOURCES = (("commissioned", "inbetrieb"), ("uebergabe", "uebergabe"), ("baustart", "baustart"), ("signed", "unterschrift"))


def register_rows(raw: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """The register's texts as flags, dates and numbers. columns: logical name to the file's; missing ones become null."""
    text = lambda key: F.trim(F.col(f"`{columns[key]}`")) if columns.get(key) else F.lit(None).cast("string")
    out = raw.select(
        text("gp").alias("gp"), *(tri_state(text(k)).alias(v) for k, v in FLAGS.items()), decimal_comma(text("kwp")).alias("pv_kwp"),
        *(german_date(text(k)).alias(v) for k, v in DATES.items()), text("plz").alias("plz"), text("ort").alias("ort"),
    )
    return out.filter("gp <> ''")


def with_live_from(rows: DataFrame) -> DataFrame:
    """asset_live_from (the latest date known, so that nothing is live too early), whether it is estimated, and what it rests on."""
    source = F.lit("none")
    for column, name in reversed(SOURCES):
        source = F.when(F.col(column).isNotNull(), name).otherwise(source)
    live = F.greatest(*(F.col(x) for x in ("commissioned", "uebergabe", "baustart", "signed")))
    return rows.withColumn("asset_live_from", live).withColumn("live_from_estimated", F.col("commissioned").isNull()).withColumn("live_from_source", source)


def labelled_meters(rows: DataFrame, points: DataFrame, meters: DataFrame) -> DataFrame:
    """register ⨝ points (zp, gp) ⨝ meters (zp, mp_id): a row for each meter of each register row's partner."""
    return with_live_from(rows.join(points, "gp").join(meters, "zp"))


def meter_table(labels: DataFrame, assets: tuple[str, ...] = ASSETS, last: bool = True, strict: bool = False) -> DataFrame:
    """One row per meter: OR-ed flags, each asset's date, the partner's number of meters. strict: only dates of commissioning count."""
    pick = F.max if last else F.min
    made: list[Column] = [F.min("gp").alias("gp"), F.min("zp").alias("zp"), F.min("plz").alias("reg_plz"), F.min("ort").alias("ort"), F.max("pv_kwp").alias("pv_kwp"), F.count("*").alias("n_register_rows")]
    for a in assets:
        has = F.col(f"has_{a}")
        counts = has & ~F.col("live_from_estimated") if strict else has
        made += [F.coalesce(F.bool_or(has), F.lit(False)).alias(f"has_{a}"), pick(F.when(counts, F.col("asset_live_from"))).alias(f"{a}_from"), F.coalesce(F.bool_or(F.when(has, F.col("live_from_estimated"))), F.lit(False)).alias(f"{a}_from_estimated")]
    sizes = labels.groupBy("gp").agg(F.countDistinct("mp_id").alias("n_meters_for_gp"))
    return labels.groupBy("mp_id").agg(*made).join(sizes, "gp", "left")


def unambiguous(meters: DataFrame) -> DataFrame:
    """Meters whose partner has no other; an unknown number passes."""
    return meters.filter(~F.coalesce(F.col("n_meters_for_gp") != 1, F.lit(False)))


def live_flags(rows: DataFrame, assets: tuple[str, ...] = ASSETS, day: str = "d") -> DataFrame:
    """{asset}_live: whether the asset existed on the row's day."""
    return rows.withColumns({f"{a}_live": F.col(f"{a}_from").isNotNull() & F.coalesce(F.col(day) >= F.col(f"{a}_from"), F.lit(False)) for a in assets})


def label_summary(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count("*").alias("n_rows"), F.countDistinct("mp_id").alias("meters"), F.count("asset_live_from").alias("with_date"))


def register_against_export(totals: DataFrame, labels: DataFrame, features: DataFrame) -> DataFrame:
    """Per PV flag: meters live before the window, and how many of them export."""
    start = features.agg(F.min("d").alias("__start"))  # one row
    joined = totals.join(labels, "mp_id").crossJoin(F.broadcast(start))
    joined = joined.filter((F.col("coverage") > 0.5) & (F.col("asset_live_from") < F.col("__start")) & F.col("has_pv").isNotNull())
    return joined.groupBy("has_pv").agg(F.count("*").alias("meters"), F.count_if(F.col("exp_kwh") > 1).alias("exporting"))


def label_check(totals: DataFrame, labels: DataFrame) -> DataFrame:
    """Register rows beside what was measured; pv_flag_contradicted where the register says no and the meter exports."""
    keep = ["mp_id", "has_pv", "has_ev", "has_hp", "has_battery", "asset_live_from", "pv_kwp", "imp_kwh", "exp_kwh", "coverage"]
    return totals.join(labels, "mp_id").select(*keep, (~F.col("has_pv") & (F.col("exp_kwh") > 1)).alias("pv_flag_contradicted"))
