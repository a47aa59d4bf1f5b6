"""Detectors as aggregate expressions: any number of them in one pass over the readings.

A detector gives a score (null: cannot be assessed) from columns over ts, d, hour,
import_kwh, export_kwh, dst_day and, for some, temp_c. Those over single readings share
one aggregation by meter; those over days one by (meter, day) first, from which the
others' sums come as well, so that readings are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, stable_uniform
from ..operators.blocks import ev_sustained_blocks
from ..schema import DAY_SLOTS, SUMMER, WINTER



def _imp() -> Column:
    return F.coalesce("import_kwh", F.lit(0.0))


def _months(*m: int) -> Column:
    return F.month("ts").isin(*m)


def _hour(*spans: tuple[int, int]) -> Column:
    """Hours from..to, both ends in."""
    out = F.lit(False)
    for a, b in spans:
        out = out | F.col("hour").between(a, b)
    return out


def _share(hit: Column, where: Column) -> Column:
    return F.avg(F.when(where, F.when(hit, 1.0).otherwise(0.0)))


def _mean(v: Column, where: Column) -> Column:
    return F.avg(F.when(where, v))


def _sum(v: Column, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, v)), F.lit(0.0))


def _n(where: Column) -> Column:
    return F.count_if(where)


@dataclass
class Detector:
    """parts: aggregates by name; score: an expression over their columns (prefixed with the detector's name)."""

    name: str
    asset: str
    parts: Callable[[], dict[str, Column]]
    score: Callable[[Callable[[str], Column]], Column]
    evidence: tuple[str, ...] = ()
    night_based: bool = False
    circular: bool = False
    anti_predictive: bool = False
    keeps_dst: bool = False
    daily: Callable[[], dict[str, Column]] | None = field(default=None)


def _used(keeps: bool) -> Column:
    return F.lit(True) if keeps else ~F.col("dst_day")


def _pv_export_total() -> dict[str, Column]:
    e = F.coalesce("export_kwh", F.lit(0.0))
    return {"total": F.sum(e), "peak": F.max(e)}


def _pv_midday_dip() -> dict[str, Column]:
    summer = _months(*SUMMER) & ~F.col("dst_day")
    v = F.col("import_kwh")
    return {"n": _n(summer), "mid": _mean(v, summer & _hour((10, 14))), "side": _mean(v, summer & _hour((6, 8), (17, 19)))}


def _dark(*months: int) -> Column:
    return _months(*months) & _hour((22, 23)) & ~F.col("dst_day")


def _battery() -> dict[str, Column]:
    low = _imp() < 0.02
    return {"n": _n(_dark(6, 7)), "share": _share(low, _dark(6, 7)), "n_winter": _n(_dark(12, 1)), "share_winter": _share(low, _dark(12, 1))}


def _boiler_band() -> dict[str, Column]:
    where = _months(*SUMMER) & _hour((0, 5), (23, 23)) & ~F.col("dst_day")
    return {"n": _n(where), "share": _share(_imp() > 0.45, where)}


def _boiler_contrast() -> dict[str, Column]:
    summer = _months(*SUMMER) & ~F.col("dst_day")
    v = F.col("import_kwh")
    return {"n": _n(summer), "cheap": _mean(v, summer & _hour((0, 1), (22, 23))), "dear": _mean(v, summer & _hour((15, 17)))}


def _hp_share() -> dict[str, Column]:
    out = {}
    for s, months in (("winter", WINTER), ("summer", SUMMER)):
        where = _months(*months) & ~F.col("dst_day")
        out |= {f"n_{s}": _n(where), f"night_{s}": _sum(F.col("import_kwh"), where & _hour((0, 5))), f"all_{s}": _sum(F.col("import_kwh"), where)}
    return out


def _ev_peak() -> dict[str, Column]:
    return {"peak": F.max("import_kwh") * 4}


def _nearest_rate(x: Callable[[str], Column]) -> Column:
    off = F.least(*(F.abs(x("peak") - r) / r for r in (3.7, 7.4, 11.0)))
    return F.when(x("peak") > 0, F.greatest(F.lit(0.0), 1 - off))


def _difference_of_shares(x: Callable[[str], Column]) -> Column:
    enough = (x("n_winter") >= 30 * DAY_SLOTS) & (x("n_summer") >= 30 * DAY_SLOTS) & (x("all_winter") > 0) & (x("all_summer") > 0)
    return F.when(enough, x("night_winter") / x("all_winter") - x("night_summer") / x("all_summer"))


# Detectors over days: aggregates by (mp_id, d) first, then by meter.


def _hp_ratio_daily() -> dict[str, Column]:
    out = {}
    for s, months in (("winter", WINTER), ("summer", SUMMER)):
        where = _months(*months) & _hour((0, 5), (22, 23)) & ~F.col("dst_day")
        out |= {f"n_{s}": _n(where), f"kwh_{s}": F.when(_n(where) > 0, _sum(F.col("import_kwh"), where))}
    return out


def _hp_ratio_parts() -> dict[str, Column]:
    return {x: f(F.col(f"hp_winter_ratio__{x}")) for x, f in (("n_winter", F.sum), ("n_summer", F.sum), ("kwh_winter", F.avg), ("kwh_summer", F.avg))}


def _slope_daily() -> dict[str, Column]:
    night = _hour((0, 4), (21, 23)) & ~F.col("dst_day")
    return {"kwh": F.when(_n(night) > 0, _sum(F.col("import_kwh"), night)), "t": _mean(F.col("temp_c"), night)}


def _slope_parts() -> dict[str, Column]:
    kwh, t = F.col("hp_temp_slope__kwh"), F.col("hp_temp_slope__t")
    both = kwh.isNotNull() & t.isNotNull()
    hdd, y = F.when(both, F.greatest(15 - t, F.lit(0.0))), F.when(both, kwh)
    return {"n": _n(both), "sd": F.stddev_pop(hdd), "slope": F.regr_slope(y, hdd), "base": F.regr_intercept(y, hdd), "corr": ratio(F.covar_pop(y, hdd), F.stddev_pop(F.when(both, y)) * F.stddev_pop(hdd)), "mean": F.avg(y)}


RULES = [
    Detector("pv_export_total", "pv", _pv_export_total, lambda x: x("total"), ("peak",), circular=True, keeps_dst=True),
    Detector("pv_midday_dip", "pv", _pv_midday_dip, lambda x: F.when((x("n") >= 30 * DAY_SLOTS) & (x("side") > 0), 1 - x("mid") / x("side")), ("n",)),
    Detector("battery_dark_zero", "battery", _battery, lambda x: F.when(x("n") >= 100, x("share")), ("n",)),
    Detector("battery_seasonal_gap", "battery", _battery, lambda x: F.when((x("n") >= 100) & (x("n_winter") >= 100), x("share") - x("share_winter")), ("n", "n_winter")),
    Detector("boiler_night_band", "boiler", _boiler_band, lambda x: F.when(x("n") >= 500, x("share")), ("n",), night_based=True),
    Detector("boiler_tariff_contrast", "boiler", _boiler_contrast, lambda x: F.when(x("n") >= 2000, ratio(x("cheap"), x("dear"))), ("n",), night_based=True),
    Detector("hp_winter_ratio", "hp", _hp_ratio_parts, lambda x: F.when((x("n_winter") >= 640) & (x("n_summer") >= 640), ratio(x("kwh_winter"), x("kwh_summer"))), ("n_winter", "n_summer"), night_based=True, daily=_hp_ratio_daily),
    Detector("hp_night_share", "hp", _hp_share, _difference_of_shares, ("n_winter", "n_summer"), night_based=True),
    Detector("hp_temp_slope", "hp", _slope_parts, lambda x: F.when((x("n") >= 180) & (x("sd") > 0), x("slope")), ("n", "base", "corr"), night_based=True, daily=_slope_daily),
    Detector("ev_peak_band", "ev", _ev_peak, _nearest_rate, ("peak",), anti_predictive=True, keeps_dst=True),
]
BY_NAME = {d.name: d for d in RULES}


def wide_scores(frame: DataFrame, detectors: list[Detector]) -> DataFrame:
    """One row per meter: a column for each detector's score, and its parts as name__part."""
    named = lambda d, made: [c.alias(f"{d.name}__{k}") for k, c in made.items()]
    single, daily = [d for d in detectors if d.daily is None], [d for d in detectors if d.daily is not None]
    tables = []
    if single:
        tables.append(frame.groupBy("mp_id").agg(*(c for d in single for c in named(d, d.parts()))))
    if daily:
        days = frame.groupBy("mp_id", "d").agg(*(c for d in daily for c in named(d, d.daily())))
        tables.append(days.groupBy("mp_id").agg(*(c for d in daily for c in named(d, d.parts()))))
    out = tables[0] if len(tables) == 1 else tables[0].join(tables[1], "mp_id")
    return out.select("*", *(d.score(lambda p, d=d: F.col(f"{d.name}__{p}")).alias(d.name) for d in detectors))


def scores(frame: DataFrame, detectors: list[Detector] | None = None, blocks: bool = True, random_assets: tuple[str, ...] = ()) -> DataFrame:
    """mp_id, detector, asset, score, evidence (a map of texts): one row per meter and detector."""
    chosen = RULES if detectors is None else detectors
    if "temp_c" not in frame.columns:
        chosen = [d for d in chosen if d.name != "hp_temp_slope"]
    wide = wide_scores(frame, chosen)
    item = lambda d: F.struct(F.lit(d.name).alias("detector"), F.lit(d.asset).alias("asset"), F.col(d.name).cast("double").alias("score"), F.create_map(*(y for e in d.evidence for y in (F.lit(e), F.col(f"{d.name}__{e}").cast("string")))).alias("evidence"))
    items = [item(d) for d in chosen]
    if "hp_temp_slope" in [d.name for d in chosen]:  # the same slope, held against electric heating of any kind
        slope = BY_NAME["hp_temp_slope"]
        items.append(F.struct(F.lit("eh_temp_slope").alias("detector"), F.lit("electric_heating").alias("asset"), F.col(slope.name).cast("double").alias("score"), F.create_map(F.lit("n"), F.col("hp_temp_slope__n").cast("string")).alias("evidence")))
    items += [F.struct(F.lit(f"random_{a}").alias("detector"), F.lit(a).alias("asset"), stable_uniform(F.col("mp_id").cast("string")).alias("score"), F.create_map().cast("map<string,string>").alias("evidence")) for a in random_assets]
    out = wide.select("mp_id", F.inline(F.array(*items)))
    if blocks:
        own = ev_sustained_blocks(frame)
        out = out.unionByName(own.select("mp_id", F.lit("ev_sustained_blocks").alias("detector"), F.lit("ev").alias("asset"), "score", F.create_map(F.lit("n_blocks"), F.col("n_blocks").cast("string")).alias("evidence")))
    return out


def scored_by(frame: DataFrame, name: str, asset: str, score: Callable[[str, pd.DataFrame], float]) -> DataFrame:
    """A user's own detector in pandas, a meter at a time; what raises counts as not assessable."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            found = score(str(key[0]), rows.sort_values("ts"))
        except Exception:  # one detector must not end a run
            found = None
        return pd.DataFrame({"mp_id": [key[0]], "detector": [name], "asset": [asset], "score": [None if found is None or found != found else float(found)]})

    kind = frame.schema["mp_id"].dataType.simpleString()
    return frame.groupBy("mp_id").applyInPandas(run, f"mp_id {kind}, detector string, asset string, score double")
