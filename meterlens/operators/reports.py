"""Inspection reports, as the aggregates behind tables and plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape(rows: DataFrame) -> DataFrame:
    mwh = lambda c: F.round(F.sum(c) / 1000, 1)
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("mp_id").alias("meters"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.countDistinct("d").alias("days"), mwh("import_kwh").alias("import_mwh"), mwh("export_kwh").alias("export_mwh"))


# The coverage buckets, and the share of the days from which each holds.
BUCKETS = (("a. complete (>=95%)", 0.95), ("b. partial (50-95%)", 0.50), ("c. sparse (<50%)", 0.0))


def coverage_buckets(rows: DataFrame) -> DataFrame:
    """Meters by the share of all days on which they have readings."""
    meter = rows.groupBy("mp_id").agg(F.countDistinct("d").alias("days"))
    span = rows.agg(F.countDistinct("d").alias("total"))  # one row
    bucket = F.coalesce(*(F.when(F.col("days") >= least * F.col("total"), name) for name, least in BUCKETS))
    return meter.crossJoin(F.broadcast(span)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("meters"), F.round(F.avg("days")).alias("avg_days"))


def _by_live(rows: DataFrame, key, live: str) -> DataFrame:
    on, off = F.avg(F.when(F.col(live), F.col("import_kwh"))), F.avg(F.when(~F.col(live), F.col("import_kwh")))
    return rows.filter(~F.col("dst_day")).groupBy(key).agg(on.alias("live"), off.alias("not_live"))


def hour_profile(rows: DataFrame, live: str) -> DataFrame:
    out = _by_live(rows, F.hour("ts").cast("long").alias("h"), live)
    return out.select("h", F.round("live", 3).alias("live"), F.round("not_live", 3).alias("not_live"), F.round(F.col("live") - F.col("not_live"), 3).alias("diff"))


def slot_profile(rows: DataFrame, live: str) -> DataFrame:
    return _by_live(rows.filter("slot_idx <= 96"), "slot_idx", live)


def import_export_profile(rows: DataFrame, live: str) -> DataFrame:
    return rows.filter(F.col(live) & ~F.col("dst_day") & (F.col("slot_idx") <= 96)).groupBy("slot_idx").agg(F.avg("import_kwh").alias("imp"), F.avg("export_kwh").alias("exp"))


def top_peaks(rows: DataFrame, n: int = 15, by: tuple[str, ...] = ("mp_id",)) -> DataFrame:
    out = rows.groupBy(*by).agg(F.round(F.max("import_kwh"), 2).alias("peak_kwh_15min"), F.round(F.max("import_kwh") * 4, 1).alias("implied_kw"), F.round(F.sum("import_kwh")).alias("total_kwh"))
    return out.orderBy(F.desc("peak_kwh_15min"), *by).limit(n)


def top_days(rows: DataFrame, n: int = 6) -> DataFrame:
    return rows.groupBy("mp_id", "d").agg(F.max("import_kwh").alias("pk")).orderBy(F.desc("pk"), "mp_id", "d").limit(n)


def catalogue(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mp_id").agg(F.countDistinct("d").alias("days"), F.min("d").alias("d0"), F.max("d").alias("d1"))


def browse_list(rows: DataFrame, n: int = 400) -> DataFrame:
    """The n meters with the most days, to choose from."""
    return catalogue(rows).orderBy(F.desc("days"), "mp_id").limit(n)


def heatmap(rows: DataFrame) -> DataFrame:
    """Mean net kWh by time of day and day, in long form."""
    net = F.coalesce("import_kwh", F.lit(0.0)) - F.coalesce("export_kwh", F.lit(0.0))
    return rows.groupBy((F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("long").alias("tod"), "d").agg(F.avg(net).alias("kwh"))


def heatmap_limit(cells: DataFrame, q: float = 0.995) -> DataFrame:
    return cells.agg(F.percentile(F.abs("kwh"), F.lit(q)).alias("kwh_limit"))


def season_profile(rows: DataFrame) -> DataFrame:
    """kW by hour in winter and summer: the mean over the months' means."""
    season = F.when(F.month("ts").isin(12, 1, 2), "winter").when(F.month("ts").isin(6, 7, 8), "summer")
    by_month = rows.groupBy(season.alias("season"), F.month("ts").alias("mon"), F.hour("ts").cast("long").alias("h")).agg(F.avg("import_kwh").alias("kwh"))
    return by_month.filter("season is not null").groupBy("season", "h").agg((F.avg("kwh") * 4).alias("kw"))


def header_facts(rows: DataFrame) -> DataFrame:
    """Days, span, yearly energy (only of spans of 180 days or more; the plain sum otherwise) and peak in kW, by meter."""
    span = F.datediff(F.max("d"), F.min("d")) + 1
    out = rows.groupBy("mp_id").agg(F.countDistinct("d").alias("days"), span.cast("long").alias("span_days"), F.sum("import_kwh").alias("imp"), F.sum("export_kwh").alias("exp"), (F.max("import_kwh") * 4).alias("peak_kw"))
    years = F.when(F.col("span_days") >= 180, F.col("span_days") / 365.25).otherwise(1.0)
    return out.withColumn("import_kwh_a", F.col("imp") / years).withColumn("export_kwh_a", F.col("exp") / years).drop("imp", "exp")


def window_trace(rows: DataFrame, first: str, last: str) -> DataFrame:
    return rows.filter(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def register_lookup(rows: DataFrame, meter) -> DataFrame:
    """What the register says of one meter; by meter, so that one row comes out for it."""
    flags = [c for c in rows.columns if c.startswith("has_")]
    return rows.filter(F.col("mp_id") == meter).groupBy("mp_id").agg(*(F.any_value(c, True).alias(c) for c in flags))
