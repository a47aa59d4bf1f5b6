"""Shape features of a meter for the learned detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..schema import SUMMER, WINTER
from .detectors import BY_NAME, _hour, wide_scores

NAMES = ["share_night", "share_midday", "share_evening", "seas_ratio", "seas_night_ratio", "weekend_ratio", "band_37", "band_74", "band_11", "frac_over_6kw", "frac_over_10kw", "peak_ratio", "cv", "night_over_1kw", "night_over_1_8kw", "tariff_contrast"]


def shape_features(frame: DataFrame, with_slope: bool = False) -> DataFrame:
    """mp_id and the features; null where a denominator is not positive. Meters without import have no row."""
    rows = frame.filter(~F.col("dst_day")).withColumn("v", F.coalesce("import_kwh", F.lit(0.0)))
    v, n, total = F.col("v"), F.count("*"), F.sum("v")
    night = _hour((0, 4), (21, 23))
    winter, summer = F.month("ts").isin(*WINTER), F.month("ts").isin(*SUMMER)
    weekend = F.dayofweek("ts").isin(1, 7)
    total_of = lambda where: F.coalesce(F.sum(F.when(where, v)), F.lit(0.0))
    mean_of = lambda where: F.avg(F.when(where, v))
    part: dict[str, Column] = {
        "share_night": ratio(total_of(_hour((0, 5))), total), "share_midday": ratio(total_of(_hour((10, 14))), total), "share_evening": ratio(total_of(_hour((18, 23))), total),
        "seas_ratio": ratio(total_of(winter), total_of(summer)), "seas_night_ratio": ratio(total_of(winter & night), total_of(summer & night)), "weekend_ratio": ratio(mean_of(weekend), mean_of(~weekend)),
        "band_37": F.count_if(v.between(0.85, 1.10)) / n, "band_74": F.count_if(v.between(1.70, 2.05)) / n, "band_11": F.count_if(v.between(2.55, 3.05)) / n,
        "frac_over_6kw": F.count_if(v > 1.5) / n, "frac_over_10kw": F.count_if(v > 2.5) / n,
        "peak_ratio": ratio(F.percentile(v, F.lit(0.999)), F.percentile(v, F.lit(0.5))), "cv": ratio(F.stddev_samp(v), F.avg(v)),
        "night_over_1kw": F.count_if(night & (v > 0.25)) / F.greatest(F.count_if(night), F.lit(1)), "night_over_1_8kw": F.count_if(night & (v > 0.45)) / F.greatest(F.count_if(night), F.lit(1)),
        "tariff_contrast": ratio(mean_of(_hour((0, 1), (22, 23))), mean_of(_hour((15, 17)))),
    }
    out = rows.groupBy("mp_id").agg(total.alias("__total"), *(part[k].alias(k) for k in NAMES)).filter("__total > 0").drop("__total")
    if with_slope:
        slope = wide_scores(frame, [BY_NAME["hp_temp_slope"]])
        out = out.join(slope.select("mp_id", ratio(F.col("hp_temp_slope"), F.col("hp_temp_slope__mean")).alias("hdd_slope_norm")), "mp_id", "left")
    return out
