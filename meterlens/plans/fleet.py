"""Whole-fleet checks, one customer's report, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mixed, wilson
from ..operators.metrics import percentile_in_pool
from ..operators.reports import header_facts
from ..operators.slots import localized, of_meters, side_by_side, to_long
from ..schema import CONFIDENCE, EXPECTED_SHARE, PV_YEARLY_FOR_BATTERY, VERDICTS
from .detectors import RULES, scores


def sample_meters(readings: DataFrame, n: int, min_days: int = 365, seed: int = 11) -> DataFrame:
    """n meters with enough days, the same ones on every run."""
    days = readings.groupBy("mp_id").agg(F.countDistinct("d").alias("days")).filter(F.col("days") >= min_days)
    return days.orderBy(mixed("mp_id", seed), "mp_id").limit(n)


def fleet_frame(raw: DataFrame, source: str = "Etc/GMT-1") -> DataFrame:
    """The wide raw layer (mp_id, obis, d, slots) as the frame that detectors take, in local time."""
    return localized(side_by_side(to_long(raw.select("mp_id", "obis", "d", "slots")), ["mp_id", "ts", "d", "slot_idx"]), source)


def fleet_scores(raw: DataFrame, detectors: list[str] | None = None, n: int = 2000, min_days: int = 365, seed: int = 11, source: str = "Etc/GMT-1") -> DataFrame:
    """Scores of a sample of the fleet, from raw readings: mp_id, detector, asset, score. detectors: those with a threshold; None: all rules.

    The meters are chosen before slots are exploded; readings go to local time as
    everywhere else. Rules that need temperatures are left out, as raw readings have none.
    """
    picked = of_meters(raw, sample_meters(raw, n, min_days, seed))
    chosen = [d for d in RULES if d.name != "hp_temp_slope" and (detectors is None or d.name in detectors)]
    blocks = detectors is None or "ev_sustained_blocks" in detectors
    return scores(fleet_frame(picked, source), chosen, blocks=blocks).select("mp_id", "detector", "asset", "score")


def prevalence(scores: DataFrame, thresholds: DataFrame, circular: tuple[str, ...] = (), expected: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per detector with a threshold (asset, detector, threshold): share of meters flagged, its interval, and what to make of it."""
    expected = EXPECTED_SHARE if expected is None else expected
    s = F.col("score")
    out = scores.join(thresholds, ["asset", "detector"]).groupBy("asset", "detector", "threshold").agg(F.count("score").alias("n_scored"), (F.count("score") / F.count("*")).alias("coverage"), F.avg(F.when(s.isNotNull(), F.when(s >= F.col("threshold"), 1.0).otherwise(0.0))).alias("p"))
    out = out.filter("n_scored > 0")
    lo, hi = wilson(F.col("p"), F.col("n_scored"))
    bound = lambda i: F.coalesce(*(F.when(F.col("asset") == a, v[i]) for a, v in expected.items()), F.lit(float(i)))
    out = out.select("asset", "detector", "threshold", "n_scored", F.round("coverage", 3).alias("coverage"), F.col("p").alias("__p"), lo.alias("__lo"), hi.alias("__hi"), bound(0).alias("expected_lo"), bound(1).alias("expected_hi"))
    verdict = F.when(F.col("detector").isin(*circular), "circular") if circular else F.when(F.lit(False), "")
    verdict = verdict.when(F.col("__lo") > F.col("expected_hi"), "above").when(F.col("__hi") < F.col("expected_lo"), "below").otherwise("plausible")
    return out.select("asset", "detector", "threshold", "n_scored", "coverage", F.round("__p", 4).alias("implied_prevalence"), F.round("__lo", 4).alias("ci_lo"), F.round("__hi", 4).alias("ci_hi"), "expected_lo", "expected_hi", verdict.alias("verdict"))


def meters_of_partner(partners: DataFrame, points: DataFrame, gp: str) -> DataFrame:
    """partners (zp, gp) and points (zp, mp_id), both as delivered -> zp, mp_id (null: no meter known) of one partner."""
    own = partners.filter(F.trim("gp") == gp.strip()).select(F.trim("zp").alias("zp"))
    return own.join(points.select(F.trim("zp").alias("zp"), F.trim("mp_id").try_cast("long").alias("mp_id")), "zp", "left")


def explained(scores: DataFrame, thresholds: DataFrame, pool: DataFrame, least_pool: int = 20) -> DataFrame:
    """Per score: whether it reaches the threshold, its place in the pool (where that is large enough), and how far to trust it."""
    placed = percentile_in_pool(scores, pool, ["asset", "detector"])
    word = F.coalesce(*(F.when(F.col("asset") == a, w) for a, w in CONFIDENCE.items()), F.lit("unknown"))
    out = placed.join(thresholds, ["asset", "detector"], "left")
    verdict = F.when(F.col("score").isNull(), "not assessable").when(F.col("threshold").isNull(), "no threshold").when(F.col("score") >= F.col("threshold"), "detected").otherwise("not detected")
    return out.select("mp_id", "asset", "detector", "score", "threshold", verdict.alias("verdict"), F.when(F.col("pool") > least_pool, F.col("share")).alias("pool_share"), word.alias("confidence"))


def meter_report(frame: DataFrame, scores: DataFrame, thresholds: DataFrame, pool: DataFrame, least_pool: int = 20) -> DataFrame:
    """A row per meter and detector: how complete the readings are, energy (by the year from 180 days on), peak, and explained().

    A detector that does worse than chance is marked as one to ignore, whatever its asset's confidence.
    """
    facts = header_facts(frame).withColumn("complete_pct", F.round(100.0 * F.col("days") / F.col("span_days"), 1))
    worse = [d.name for d in RULES if d.anti_predictive]
    told = explained(scores, thresholds, pool, least_pool)
    told = told.withColumn("confidence", F.when(F.col("detector").isin(*worse), "ignore: worse than chance").otherwise(F.col("confidence")))
    return facts.join(told, "mp_id")


def years_of(frame: DataFrame) -> DataFrame:
    """mp_id, years, export_a (kWh a year)."""
    years = F.greatest((F.datediff(F.max("d"), F.min("d")) + 1) / 365.25, F.lit(1e-6))
    return frame.groupBy("mp_id").agg(years.alias("years"), (F.coalesce(F.sum("export_kwh"), F.lit(0.0)) / years).alias("export_a"))


def verdicts(scores: DataFrame, years: DataFrame) -> DataFrame:
    """mp_id, label, verdict, value (what is held against the cut-offs). PV goes by the year; a battery without PV is a no."""
    rows = scores.join(years, "mp_id")
    label, word = F.lit(None).cast("string"), F.lit(None).cast("string")
    value = F.when(F.col("detector") == "pv_export_total", F.col("score") / F.col("years")).otherwise(F.col("score"))
    for name, detector, cuts in VERDICTS:
        own: Column = F.lit("no")
        for cut, text in reversed(cuts):
            own = F.when(value >= cut, text).otherwise(own)
        if detector == "battery_dark_zero":
            own = F.when(F.col("export_a") > PV_YEARLY_FOR_BATTERY, own).otherwise("no")
        this = F.col("detector") == detector
        label, word = F.when(this, name).otherwise(label), F.when(this, own).otherwise(word)
    out = rows.select("mp_id", label.alias("label"), F.when(F.col("score").isNull(), "n/a").otherwise(word).alias("verdict"), value.alias("value"))
    return out.filter("label is not null")


def declared_from_register(meters: DataFrame) -> DataFrame:
    """mp_id, label, declared: a row per asset of VERDICTS; null where the register is silent."""
    pairs = (("PV", "has_pv"), ("Battery", "has_battery"), ("Heat pump", "has_hp"), ("EV", "has_ev"), ("Boiler", "has_hp_boiler"))
    return meters.select("mp_id", F.inline(F.array(*(F.struct(F.lit(n).alias("label"), F.col(x).alias("declared")) for n, x in pairs))))


def declared_from_survey(profiles: DataFrame) -> DataFrame:
    from ..schema import HEAT_PUMPS

    pairs = (("PV", F.col("solar_installed") == "true"), ("Battery", F.lit(None).cast("boolean")), ("Heat pump", F.col("heating_type_primary").isin(*HEAT_PUMPS)), ("EV", F.col("electric_car") == "true"), ("Boiler", F.col("hotwater_type") == "boiler"))
    return profiles.select(F.col("location_profile_id").alias("mp_id"), F.inline(F.array(*(F.struct(F.lit(n).alias("label"), (v if n == "Battery" else F.coalesce(v, F.lit(False))).alias("declared")) for n, v in pairs))))


def agreement(rows: DataFrame) -> DataFrame:
    """rows (verdict, declared) with agreement: agrees, differs, inconclusive or not declared."""
    detected = F.col("verdict").isin("yes", "likely")
    word = F.when(F.col("declared").isNull(), "not declared").when(F.col("verdict").isin("possible", "weak"), "inconclusive").when(detected == F.col("declared"), "agrees").otherwise("differs")
    return rows.withColumn("agreement", word)
