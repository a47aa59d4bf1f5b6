"""The survey dataset: labels, weather, composition, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HEAT_PUMPS, OTHER_HEATING, RESISTIVE
from .slots import localized, split_signed


def answer(asset: str) -> Column:
    """1, 0 or null: what a household says of an asset. Answers that fit neither class count as none."""
    heating, water = F.col("heating_type_primary"), F.col("hotwater_type")
    yes_no = {
        "pv": (F.col("solar_installed") == "true", F.col("solar_installed") == "false"),
        "ev": (F.col("electric_car") == "true", F.col("electric_car") == "false"),
        "hp": (heating.isin(*HEAT_PUMPS), heating.isin(*OTHER_HEATING)),
        "electric_heating": (heating.isin(*HEAT_PUMPS, *RESISTIVE), heating.isin(*OTHER_HEATING)),
        "boiler": (water == "boiler", water.isNotNull() & ~water.isin("boiler", "unknown")),
    }
    if asset not in yes_no:
        raise ValueError(f"the survey has no label for {asset!r}; it has {sorted(yes_no)}")
    yes, no = yes_no[asset]
    return F.when(yes, 1.0).when(no, 0.0)


def survey_labels(profiles: DataFrame, asset: str, eligible: DataFrame | None = None) -> DataFrame:
    """mp_id, gp, y, tier of the households that give an answer; of those in ``eligible`` (mp_id) where that is given."""
    y = answer(asset)
    out = profiles.select(F.col("location_profile_id").alias("mp_id"), F.coalesce("gpnr", "location_profile_id").alias("gp"), y.alias("y"))
    out = out.filter("y is not null").withColumn("tier", F.when(F.col("y") == 1, "gold_positive").otherwise("gold_negative"))
    return out if eligible is None else out.join(eligible.select("mp_id").distinct(), "mp_id", "left_semi")


def eligible_meters(readings: DataFrame, min_days: int, meter: str = "mp_id", ts: str = "ts") -> DataFrame:
    return readings.groupBy(meter).agg(F.countDistinct(F.date_trunc("day", F.col(ts))).alias("days")).filter(F.col("days") >= min_days)


def hourly_temperature(weather: DataFrame, time: str = "timestamp_utc", value: str = "tre200h0") -> DataFrame:
    hour = F.date_trunc("hour", F.col(time).cast("timestamp_ntz"))
    return weather.groupBy(hour.alias("hr")).agg(F.avg(F.col(value).try_cast("double")).alias("temp_c"))


def with_temperature(readings: DataFrame, temperature: DataFrame) -> DataFrame:
    """temp_c of the hour a reading falls in; null where there is none."""
    return readings.join(temperature, F.date_trunc("hour", F.col("ts")) == F.col("hr"), "left").drop("hr")


def frame(series: DataFrame, temperature: DataFrame | None = None) -> DataFrame:
    """Signed UTC series as the frame that detectors take, in local time."""
    from ..functions.columns import is_dst_day

    rows = series.select(F.col("location_profile_id").alias("mp_id"), F.col("start_datetime_utc").alias("ts"), F.col("kWh").alias("kwh"))
    rows = split_signed(rows).drop("kwh").withColumn("dst_day", is_dst_day(F.to_date("ts")))
    rows = with_temperature(rows, temperature) if temperature is not None else rows.withColumn("temp_c", F.lit(None).cast("double"))
    return localized(rows, "UTC")


def composition(profiles: DataFrame) -> DataFrame:
    share = lambda when: F.round(100 * F.avg(F.when(when, 1.0).otherwise(0.0)), 1)
    return profiles.agg(F.count("*").alias("households"), share(F.col("solar_installed") == "true").alias("solar_pct"), share(F.col("heating_type_primary").isin(*HEAT_PUMPS)).alias("heat_pump_pct"), share(F.col("electric_car") == "true").alias("electric_car_pct"))


def cohort(profiles: DataFrame, **answers: str | tuple[str, ...]) -> DataFrame:
    """Households whose answers are among the given ones."""
    for column, wanted in answers.items():
        profiles = profiles.filter(F.col(column).isin(*([wanted] if isinstance(wanted, str) else wanted)))
    return profiles
