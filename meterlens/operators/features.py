"""Features of a day, coverage and export, from slot arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..schema import CHARGE_LEVELS, EXPORT, IMPORT, RUN_LEVEL, WINDOWS

NAMES = ["total", "n_present", "vmax", "vmean", "vstd", "p10", "p50", *(f"{w}_sum" for w in WINDOWS), *(f"n_{x}" for x in CHARGE_LEVELS), "max_run", "n_runs", "step_up_max", "step_dn_max"]


def slot_features(day: Column, raw: Column, ordered: Column, runs: Column, jumps: Column) -> dict[str, Column]:
    mean = fx.array_mean(day)
    out = {
        "total": fx.array_sum(day), "n_present": F.size(F.filter(raw, lambda x: x.isNotNull())).cast("long"), "vmax": F.array_max(day), "vmean": mean, "vstd": fx.array_std(day, F.col("__mean")),
        "p10": fx.array_quantile(ordered, 0.1), "p50": fx.array_quantile(ordered, 0.5),
    }
    out |= {f"{w}_sum": fx.window_sum(day, *ends) for w, ends in WINDOWS.items()}
    out |= {f"n_{x}": fx.count_from(day, level) for x, level in CHARGE_LEVELS.items()}
    return out | {"max_run": F.coalesce(F.array_max(runs), F.lit(0)).cast("long"), "n_runs": F.size(runs).cast("long"), "step_up_max": F.array_max(jumps), "step_dn_max": F.array_min(jumps)}


def row_features(wide: DataFrame) -> DataFrame:
    """wide (…, d, slots) with the features of each row; what several features share is computed once."""
    rest = [c for c in wide.columns if c != "slots"]
    base = wide.withColumn("__raw", F.slice("slots", 1, 96)).withColumn("__day", fx.filled("slots"))
    base = base.withColumn("__ordered", F.array_sort("__day")).withColumn("__mean", fx.array_mean(F.col("__day"))).withColumn("__runs", fx.runs_from(F.col("__day"), RUN_LEVEL)).withColumn("__jumps", fx.steps(F.col("__day")))
    made = slot_features(*(F.col(f"__{x}") for x in ("day", "raw", "ordered", "runs", "jumps")))
    return base.select(*rest, *(made[n].alias(n) for n in NAMES))


def day_features(wide: DataFrame, n_slots: str | None = None) -> DataFrame:
    """One row per meter-day: the features of both directions (imp_, exp_), ym, dow, mon and dst_day."""
    odd = (F.col(n_slots) != 96) if n_slots else F.lit(False)
    rows = row_features(wide.withColumn("__dst", odd | fx.is_dst_day("d")))
    sides = [F.max(F.when(F.col("obis") == code, F.col(n))).alias(f"{p}_{n}") for p, code in (("imp", IMPORT), ("exp", EXPORT)) for n in NAMES]
    out = rows.groupBy("mp_id", "d").agg(F.bool_or("__dst").alias("dst_day"), *sides)
    return out.withColumn("ym", fx.year_month("d")).withColumn("dow", fx.sunday_zero("d")).withColumn("mon", F.month("d").cast("long"))


def coverage(features: DataFrame) -> DataFrame:
    """Per meter-month: days, values present, empty days, share of the slots that have a value."""
    n = F.col("imp_n_present")
    return features.groupBy("mp_id", "ym").agg(
        F.count("*").alias("meter_days"), F.sum(n).alias("vals_present"), F.sum(F.when(n == 0, 1).otherwise(0)).alias("empty_days"), F.round(F.sum(n) / (96.0 * F.count("*")), 4).alias("coverage")
    )


def pv_export(features: DataFrame, least: float = 1.0) -> DataFrame:
    """Meters that export: the first month they do, total, peak and number of months."""
    month = features.groupBy("mp_id", "ym").agg(F.sum("exp_total").alias("kwh"), F.max("exp_vmax").alias("peak"))
    does = F.col("kwh") > least
    out = month.groupBy("mp_id").agg(F.min(F.when(does, F.col("ym"))).alias("first_export_ym"), F.sum("kwh").alias("export_kwh_total"), F.max("peak").alias("export_peak_kwh_15min"), F.count_if(does).alias("months_exporting"))
    return out.filter(F.col("export_kwh_total") > least)


def meter_totals(features: DataFrame) -> DataFrame:
    return features.groupBy("mp_id").agg(F.sum("imp_total").alias("imp_kwh"), F.sum("exp_total").alias("exp_kwh"), (F.sum("imp_n_present") / (96.0 * F.count("*"))).alias("coverage"), F.count("*").alias("days"))
