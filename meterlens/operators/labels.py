"""Label tiers from the register and from measured export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PV_NONE_KWH, PV_SURE_KWH

REGISTER_ASSETS = ("pv", "hp", "ev", "battery")


def meter_summary(rows: DataFrame, min_days: int = 0, only_unambiguous: bool = True) -> DataFrame:
    """One row per meter of the modelling table: days, totals, flags, and whether assets were live at its first reading."""
    made = [F.min("gp").alias("gp"), F.min("n_meters_for_gp").alias("n_meters_for_gp"), F.countDistinct("d").alias("days"), F.min("d").alias("first_day"), F.max("d").alias("last_day")]
    made += [F.bool_or(f"has_{a}").alias(f"has_{a}") for a in REGISTER_ASSETS] + [F.min_by(f"{a}_live", "ts").alias(f"{a}_live") for a in REGISTER_ASSETS]
    out = rows.groupBy("mp_id").agg(*made, F.sum("export_kwh").alias("export_kwh_total"), F.sum("import_kwh").alias("import_kwh_total")).filter(F.col("days") >= min_days)
    return out.filter("n_meters_for_gp = 1") if only_unambiguous else out


def label_tiers(summary: DataFrame, asset: str) -> DataFrame:
    """mp_id, gp, y (null: unlabelled), tier. Register flags say little where they say no; a battery's no is kept as silver."""
    if asset not in REGISTER_ASSETS:
        raise ValueError(f"unknown asset {asset!r}")
    if asset == "pv":
        kwh = F.col("export_kwh_total")
        tier = F.when(kwh >= PV_SURE_KWH, "gold_positive").when(kwh < PV_NONE_KWH, "gold_negative").otherwise("ambiguous")
    else:
        flag, live = (F.coalesce(F.col(x), F.lit(False)) for x in (f"has_{asset}", f"{asset}_live"))
        tier = F.when(flag & live, "weak_positive").when(flag, "ambiguous").otherwise("silver_negative" if asset == "battery" else "unlabelled")
    y = F.when(tier.isin("gold_positive", "weak_positive"), 1.0).when(tier.isin("gold_negative", "silver_negative"), 0.0)
    return summary.select("mp_id", "gp", y.alias("y"), tier.alias("tier"))


def tier_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("tier").agg(F.count("*").alias("n"))


def describe(labels: DataFrame, asset: str) -> str:
    """The tiers' sizes in a line, with what the labels are worth."""
    tiers = {r["tier"]: r["n"] for r in tier_counts(labels).collect()}
    line = ", ".join(f"{k}={v}" for k, v in sorted(tiers.items()))
    if asset == "battery" and tiers.get("silver_negative"):
        return f"{line} (negatives partly contaminated: precision is a lower bound)"
    return line if tiers.get("gold_negative") else f"{line} (no negatives: flag rate bounds false positives from above)"
