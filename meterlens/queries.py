"""Queries of the engine's own operators over the test tables in their roles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as fx
from .operators import blocks, labels, metrics, register, reports, slots, survey, training
from .operators import features as feats
from .plans import detectors, evaluate, fleet, learned, shapes
from .schema import ASSETS, PRIORS
from .sources import files, load_csv, raw_store, roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, so that sums in another order compare equal; to nine where a mean of few digits may end at the seventh."""
    return df.withColumns({n: F.round(n, places) for n in [c for c, t in df.dtypes if t == "double"]})


def longs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


# Readings.


@query
def readings_long(s, d):
    return roles.long(s, d).select("mp_id", "obis", "d", "slot_idx", "ts", "kwh")


@query
def readings_dedup(s, d):
    return roles.unique_events(s, d)


@query
def duplicate_keys(s, d):
    return slots.duplicate_keys(roles.events(s, d), ["mp_id", "obis", "d"])


@query
def day_pivot(s, d):
    return roles.frame(s, d)


@query
def wide_slots(s, d):
    """The wide layer: v001 to v100 of each meter-day, as text."""
    w = roles.wide(s, d)
    return w.select("mp_id", "obis", "d", F.array_join(F.transform("slots", lambda x: F.round(x * 100).cast("long").cast("string")), ",", "-").alias("v"))


@query
def present_meters(s, d):
    odd = roles.source(s, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("mp_id"))
    return slots.of_meters(roles.events(s, d), odd).select("mp_id").distinct()


@query
def signed_split(s, d):
    e = roles.source(s, d, "events").select("event_id", (F.col("value") / 100 - 0.5).alias("kwh"))
    return r6(slots.split_signed(e))


@query
def dst_flag(s, d):
    t = roles.source(s, d, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return t.select("d", fx.is_dst_day("d").alias("dst_day"), fx.sunday_zero("d").alias("dow"))


@query
def localize(s, d):
    t = roles.source(s, d, "lineitem").select(F.timestamp_add("MINUTE", (15 * (F.col("l_orderkey") % 96)).cast("int"), F.col("l_shipdate").cast("timestamp_ntz")).alias("ts")).distinct()
    return longs(t.select(F.col("ts").alias("source_ts"), "ts").transform(slots.localized))


@query
def batch_readings(s, d):
    return roles.events(s, d).filter(F.col("mp_id").isin(3, 5, 7, 11, 13)).filter("kwh is not null").select("event_id", "mp_id", "kwh")


# Load files: the wide readings written as delivered, and taken in again.


def _slot_text(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.array_join(F.transform("slots", lambda x: F.round(x * 100).cast("long").cast("string")), ",", "-")).drop("slots")


@query
def ingest_kinds(s, d):
    found = load_csv.classify(s, roles.mixed_folder(s))
    return s.createDataFrame([(k, path.rpartition("/")[2]) for k, paths in found.items() for path in paths], "kind string, file string")


@query
def ingest_layout(s, d):
    lay = load_csv.layout_of(s, roles.load_file(s, d))
    return s.createDataFrame([(",".join(lay.meta), lay.n_slots, lay.n_fields, lay.trailing, ",".join(map(str, lay.widths)))], "meta string, n_slots long, n_fields long, trailing boolean, widths string")


@query
def ingest_rows(s, d):
    return longs(_slot_text(load_csv.read_load(s, roles.load_file(s, d))))


@query
def ingest_gate(s, d):
    """Rows whose date cannot be read, which forbid a conversion."""
    rows = load_csv.read_load(s, roles.load_file(s, d))
    rows = rows.withColumn("datum", F.when((F.col("mp_id") % 29 == 1) & F.col("datum").isNotNull(), "31.02.2024").otherwise(F.col("datum"))).withColumn("d", fx.german_date("datum"))
    return s.createDataFrame([(raw_store.unreadable_dates(rows),)], "n_bad long")


@query
def ingest_profile(s, d):
    return longs(raw_store.profile_files(s, [roles.load_file(s, d)], files.scratch(s, "profile")).drop("path"))


def _converted(s, d):
    """Converted, left alone the second time, and converted again by force: the rows are there once."""
    path, out = roles.load_file(s, d), files.scratch(s, "converted")
    for force in (False, False, True):
        raw_store.convert(s, [path], out, force)
    return raw_store.read_raw(s, out)


@query
def ingest_convert(s, d):
    return longs(_slot_text(_converted(s, d))).withColumn("ym", F.col("ym").cast("string"))


@query
def ingest_readings(s, d):
    name = f"readings_{uuid.uuid4().hex}"
    raw_store.readings_view(_converted(s, d), name)
    return s.sql(f"SELECT mp_id, obis, d, slot_idx, ts, kwh FROM {name}")


@query
def ingest_small(s, d):
    """A delivered table with drifted headers, by logical names; one of them is not there."""
    t = load_csv.read_small(s, roles.drifted(s, d))
    found = load_csv.resolved(t.columns, {"gp": ["GP-Nr"], "pv": ["PV"], "kwp": ["Leistung"], "hp": ["Wärmepumpe"], "ev": ["EV"]})
    return t.select(*((t[f"`{c}`"] if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()))


@query
def sink_files(s, d):
    """Totals written as CSV and as Parquet, and read again."""
    rows, folder, out = meter_totals(s, d).select("mp_id", "imp_kwh", "exp_kwh", "days"), files.scratch(s, "sink"), None
    for form in ("csv", "parquet"):
        raw_store.write_table(rows, f"{folder}/{form}", form)
        back = s.read.schema(rows.schema).option("header", True).format(form).load(f"{folder}/{form}").withColumn("form", F.lit(form))
        out = back if out is None else out.unionByName(back)
    return out


@query
def ordered_rows(s, d):
    return training.ordered(_training(s, d)).select("mp_id", "ts")


# Day features.


@query
def day_features(s, d):
    return r6(roles.features(s, d), 9)


@query
def window_sums(s, d):
    return r6(feats.row_features(roles.wide(s, d)).select("mp_id", "obis", "d", *(n for n in feats.NAMES if n.endswith("_sum"))))


@query
def run_length(s, d):
    w = roles.wide(s, d).select("mp_id", "obis", "d", fx.runs_from(fx.filled("slots"), 0.30).alias("r"))
    return w.select("mp_id", "obis", "d", F.coalesce(F.array_max("r"), F.lit(0)).cast("long").alias("max_run"), F.size("r").cast("long").alias("n_runs"))


@query
def slot_steps(s, d):
    return r6(feats.row_features(roles.wide(s, d)).select("mp_id", "obis", "d", "step_up_max", "step_dn_max"))


@query
def slot_quantiles(s, d):
    w = roles.wide(s, d).select("mp_id", "obis", "d", F.array_sort(F.filter("slots", lambda x: x.isNotNull())).alias("v"))
    return r6(w.select("mp_id", "obis", "d", *(fx.array_quantile(F.col("v"), q).alias(n) for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")))))


@query
def coverage(s, d):
    return feats.coverage(roles.features(s, d))


@query
def pv_export(s, d):
    return r6(feats.pv_export(roles.features(s, d)))


@query
def meter_totals(s, d):
    return r6(feats.meter_totals(roles.features(s, d)))


@query
def profile(s, d):
    from .sources.load_csv import profile as profile_of

    rows = roles.wide(s, d).withColumn("datum", F.date_format("d", "d.M.yyyy")).withColumn("n_slots", F.lit(96)).withColumn("slots", F.slice("slots", 1, 96))
    return profile_of(rows)


# Register and labels.


@query
def register_flags(s, d):
    raw = roles.register(s, d)
    return raw.select("o_orderkey", *(fx.tri_state(k).alias(v) for k, v in (("PV", "has_pv"), ("HP", "has_hp"), ("EV", "has_ev"), ("BAT", "has_battery"), ("BOIL", "has_hp_boiler"))), fx.decimal_comma("KWP").alias("pv_kwp"))


@query
def register_chain(s, d):
    return roles.labels(s, d).select("mp_id", "zp", "gp", "has_pv", "has_hp", "commissioned", "signed", "plz", "ort")


@query
def live_from(s, d):
    return roles.labels(s, d).groupBy("asset_live_from", "live_from_estimated", "live_from_source").agg(F.count("*").alias("n"))


@query
def label_summary(s, d):
    return register.label_summary(roles.labels(s, d))


@query
def meter_meta(s, d):
    return register.meter_table(roles.labels(s, d))


@query
def meter_meta_strict(s, d):
    return register.meter_table(roles.labels(s, d), last=False, strict=True).select("mp_id", *(f"{a}_from" for a in ASSETS))


@query
def unambiguous_meters(s, d):
    return register.unambiguous(register.meter_table(roles.labels(s, d))).select("mp_id", "n_meters_for_gp")


def _training(s, d):
    w = roles.wide(s, d).withColumn("plz", F.lit("5000"))
    return training.training_set(w, register.meter_table(roles.labels(s, d)), ["obis"])


@query
def live_gate(s, d):
    return _training(s, d).select("mp_id", "ts", "d", *(f"{a}_live" for a in ASSETS))


@query
def training_set(s, d):
    return r6(_training(s, d).select("mp_id", "zp", "plz", "ts", "d", "slot_idx", "import_kwh", "export_kwh", "dst_day", "has_pv", "pv_from", "pv_live", "pv_kwp", "gp", "n_meters_for_gp", "n_register_rows", "ort"))


@query
def training_report(s, d):
    return training.report(_training(s, d))


@query
def training_min_coverage(s, d):
    w = roles.wide(s, d).withColumn("plz", F.lit("5000"))
    return training.training_set(w, register.meter_table(roles.labels(s, d)), ["obis"], min_coverage=0.02).select("mp_id").distinct()


@query
def asset_counts(s, d):
    return training.asset_counts(_training(s, d))


@query
def validate_contradiction(s, d):
    f = roles.features(s, d)
    late = roles.labels(s, d)
    totals = feats.meter_totals(f).withColumn("coverage", F.col("coverage") * 50)
    return register.register_against_export(totals, late, f)


@query
def label_check(s, d):
    return r6(register.label_check(feats.meter_totals(roles.features(s, d)), roles.labels(s, d)))


@query
def meter_summary(s, d):
    return r6(labels.meter_summary(_training(s, d), 20, False))


@query
def label_tiers_pv(s, d):
    return labels.label_tiers(labels.meter_summary(_training(s, d), 1, False).withColumn("export_kwh_total", F.col("export_kwh_total") * 12), "pv")


@query
def label_tiers_flag(s, d):
    summary = labels.meter_summary(_training(s, d), 1, False)
    out = [labels.label_tiers(summary, a).withColumn("asset", F.lit(a)) for a in ("hp", "ev", "battery")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def tier_counts(s, d):
    return labels.tier_counts(labels.label_tiers(labels.meter_summary(_training(s, d), 1, False), "battery"))


@query
def register_lookup(s, d):
    return reports.register_lookup(register.meter_table(roles.labels(s, d)), 17)


@query
def survey_labels(s, d):
    p = roles.profiles(s, d)
    out = None
    for a in ("pv", "ev", "hp", "electric_heating", "boiler"):
        one = survey.survey_labels(p, a).withColumn("asset", F.lit(a))
        out = one if out is None else out.unionByName(one)
    return out


@query
def survey_composition(s, d):
    return survey.composition(roles.profiles(s, d))


@query
def survey_cohort(s, d):
    return survey.cohort(roles.profiles(s, d), solar_installed="true", heating_type_primary=("wood", "oilHeating")).select("location_profile_id")


@query
def eligible_meters(s, d):
    e = roles.source(s, d, "events").withColumnRenamed("user_id", "mp_id")
    return survey.eligible_meters(e, 25)


@query
def weather_join(s, d):
    e = roles.source(s, d, "events")
    w = e.select(F.col("ts").cast("string").alias("timestamp_utc"), F.when(F.col("event_id") % 10 == 0, "-").otherwise((F.col("value") / 10).cast("string")).alias("tre200h0")).filter("event_type <> 'view'")
    rows = e.select("event_id", "ts")
    return r6(survey.with_temperature(rows, survey.hourly_temperature(w)))


# Reports.


@query
def shape_summary(s, d):
    return reports.shape(roles.frame(s, d))


@query
def coverage_buckets(s, d):
    return reports.coverage_buckets(roles.frame(s, d))


@query
def hour_profile(s, d):
    return reports.hour_profile(_training(s, d), "pv_live")


@query
def slot_profile(s, d):
    return r6(reports.slot_profile(_training(s, d), "hp_live"), 9)


@query
def import_export_profile(s, d):
    return r6(reports.import_export_profile(_training(s, d), "pv_live"), 9)


@query
def top_peaks(s, d):
    return reports.top_peaks(roles.frame(s, d))


@query
def top_days(s, d):
    return r6(reports.top_days(roles.frame(s, d)))


@query
def catalogue(s, d):
    return reports.catalogue(roles.frame(s, d))


@query
def heatmap(s, d):
    return r6(reports.heatmap(roles.frame(s, d)), 9)


@query
def heatmap_limit(s, d):
    return r6(reports.heatmap_limit(reports.heatmap(roles.frame(s, d))))


@query
def season_profile(s, d):
    return r6(reports.season_profile(roles.season(s, d)))


@query
def header_facts(s, d):
    return r6(reports.header_facts(roles.season(s, d)))


@query
def window_trace(s, d):
    return r6(reports.window_trace(roles.frame(s, d), "2024-01-05", "2024-01-07").select("mp_id", "ts", "import_kwh", "export_kwh"))


@query
def browse_list(s, d):
    return reports.browse_list(roles.frame(s, d))


@query
def register_composition(s, d):
    return training.composition(_training(s, d))


@query
def label_meters(s, d):
    summary = labels.meter_summary(_training(s, d), 1, False)
    return evaluate.all_meters(*(labels.label_tiers(summary, a) for a in ("pv", "hp", "ev", "battery")))


@query
def auto_strata(s, d):
    """Labels of heat pumps, by battery too, as a night-based detector takes part."""
    own = labels.label_tiers(labels.meter_summary(_training(s, d), 1, False), "hp").withColumn("asset", F.lit("hp"))
    out = evaluate.ownership_strata(own, register.meter_table(roles.labels(s, d)), ["pv_midday_dip", "hp_winter_ratio"], least_positive=1)
    return out.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))


# Detectors.


def _detector(name: str, asset: str) -> Query:
    def run(s, d):
        return r6(detectors.wide_scores(roles.season(s, d), [detectors.BY_NAME[name]]).select("mp_id", F.col(name).alias("score")))

    run.__name__ = asset
    return run


for _q, _n in (
    ("det_pv_total", "pv_export_total"), ("det_pv_dip", "pv_midday_dip"), ("det_battery", "battery_dark_zero"), ("det_battery_gap", "battery_seasonal_gap"), ("det_boiler_band", "boiler_night_band"),
    ("det_boiler_contrast", "boiler_tariff_contrast"), ("det_hp_ratio", "hp_winter_ratio"), ("det_hp_share", "hp_night_share"), ("det_hp_slope", "hp_temp_slope"), ("det_ev_peak", "ev_peak_band"),
):
    query(_detector(_n, _q))


@query
def det_all(s, d):
    """Every rule in one pass, as score rows."""
    return r6(detectors.scores(roles.season(s, d), blocks=False).select("mp_id", "detector", "asset", "score"))


@query
def det_ev_blocks(s, d):
    return r6(blocks.ev_sustained_blocks(roles.dense(s, d)))


@query
def ev_blocks(s, d):
    return r6(blocks.sustained_blocks(roles.dense(s, d)))


@query
def random_score(s, d):
    return r6(roles.frame(s, d).select("mp_id").distinct().select("mp_id", fx.stable_uniform("mp_id").alias("score")))


@query
def gbm_features(s, d):
    return r6(shapes.shape_features(roles.season(s, d)))


def _gbm_rows(s, d):
    return shapes.shape_features(roles.frame(s, d).withColumn("hour", F.hour("ts")))


@query
def gbm_oof(s, d):
    f = _gbm_rows(s, d)
    y = f.select("mp_id", F.col("mp_id").cast("string").alias("gp"), F.when(F.col("share_night") > 0.26, 1.0).otherwise(0.0).alias("y"))
    out = learned.out_of_fold(f, y, "ev", trees=5)
    return out if out is not None else s.createDataFrame([], "mp_id long, detector string, asset string, score double")


# Evaluation.

BY = ["stratum", "asset", "detector"]


@query
def roc_auc(s, d):
    return r6(metrics.roc_auc(roles.scored_labels(s, d), BY))


@query
def avg_precision(s, d):
    return r6(metrics.average_precision(roles.scored_labels(s, d), BY))


@query
def recall_precision(s, d):
    return r6(metrics.at_threshold(roles.scored_labels(s, d), BY, F.when(F.col("detector") == "length", 1500.0).otherwise(40.0)).select(*BY, "recall", "precision", "f1", "youden"))


@query
def lift(s, d):
    return r6(metrics.at_threshold(roles.scored_labels(s, d), BY, F.when(F.col("detector") == "length", 1500.0).otherwise(40.0)).select(*BY, "flag_rate", "lift"))


@query
def youden_threshold(s, d):
    return r6(metrics.best_threshold(roles.scored_labels(s, d), BY))


@query
def f1_threshold(s, d):
    return r6(metrics.best_threshold(roles.scored_labels(s, d), BY, "f1"))


@query
def prevalence_threshold(s, d):
    return r6(metrics.threshold_for_share(roles.scored_labels(s, d), BY, 0.15))


@query
def prior_thresholds(s, d):
    rows = roles.scored_labels(s, d)
    every = rows
    for a in ("hp", "ev", "boiler"):
        every = every.unionByName(rows.withColumn("asset", F.lit(a)))
    return r6(metrics.threshold_for_share(every, BY, PRIORS))


@query
def grouped_folds(s, d):
    return metrics.grouped_folds(roles.scored_labels(s, d), "gp")


@query
def bootstrap_auc(s, d):
    return metrics.bootstrap(roles.scored_labels(s, d), BY)


@query
def paired_bootstrap(s, d):
    rows = roles.scored_labels(s, d)
    pair = rows.groupBy("stratum", "asset", "mp_id").agg(F.max("y").alias("y"), F.max(F.when(F.col("detector") == "length", F.col("score"))).alias("score_b"), F.max(F.when(F.col("detector") == "mixed", F.col("score"))).alias("score_a"))
    return metrics.paired_bootstrap(pair, ["stratum", "asset"])


def _labels_and_scores(s, d):
    rows = roles.scored_labels(s, d)
    return rows.select("asset", "mp_id", "gp", "y").distinct(), rows.select("asset", "detector", "mp_id", "score")


def _board(s, d):
    y, sc = _labels_and_scores(s, d)
    return evaluate.leaderboard(y.withColumn("stratum", F.lit("all")), sc)


@query
def leaderboard(s, d):
    return r6(evaluate.ranked(_board(s, d)))


def _strata(s, d):
    y, sc = _labels_and_scores(s, d)
    split = roles.source(s, d, "documents").select(F.col("doc_id").alias("mp_id"), F.col("lang").alias("stratum"))
    return evaluate.strata(y, split), sc


@query
def strata(s, d):
    return _strata(s, d)[0].groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))


@query
def masking(s, d):
    y, sc = _strata(s, d)
    rows = evaluate.labelled_scores(y, sc)
    board = metrics.roc_auc(rows, BY).join(metrics.at_threshold(rows, BY, F.when(F.col("detector") == "length", 1500.0).otherwise(40.0)), BY)
    return r6(evaluate.masking(board, "de", "en"))


@query
def best_two(s, d):
    board = metrics.roc_auc(roles.scored_labels(s, d), BY).withColumn("circular", F.lit(False))
    return r6(evaluate.best_two(board).select(*BY, "auc", "place"))


@query
def head_to_head(s, d):
    y, sc = _labels_and_scores(s, d)
    y = y.withColumn("stratum", F.lit("all"))
    return evaluate.head_to_head(y, sc, evaluate.leaderboard(y, sc))


def _known(s, d):
    rows = roles.scored_labels(s, d).select("mp_id", "detector", "score")
    return rows.filter("mp_id % 5 <> 0"), rows.filter("mp_id % 4 = 0").withColumn("score", F.col("score") + 1)


@query
def missing_scores(s, d):
    rows = roles.scored_labels(s, d)
    return evaluate.missing_scores(rows, _known(s, d)[0], rows)


@query
def score_topup(s, d):
    return evaluate.topped_up(*_known(s, d))


@query
def percentile_rank(s, d):
    rows = roles.scored_labels(s, d)
    return r6(metrics.percentile_in_pool(rows.select("asset", "detector", "mp_id", "score"), rows, ["asset", "detector"]))


# Fleet, reports for one, verdicts.


def _limits(s):
    return s.createDataFrame([("pv", "length", 1500.0), ("pv", "mixed", 40.0)], "asset string, detector string, threshold double")


@query
def fleet_wilson(s, d):
    return fleet.prevalence(roles.scored_labels(s, d), _limits(s), ("mixed",))


@query
def fleet_sample(s, d):
    return fleet.sample_meters(roles.frame(s, d), 25, 20)


@query
def fleet_scores(s, d):
    """Scores of sampled meters from the wide readings, in local time."""
    names = [r.name for r in detectors.RULES]
    return r6(fleet.fleet_scores(roles.wide(s, d), names, 40, 5))


@query
def meter_report(s, d):
    """Completeness, energy and every detector's verdict for each meter."""
    f = files.written(roles.season(s, d), "season")
    own = files.written(r6(detectors.scores(f, blocks=False).select("mp_id", "detector", "asset", "score")), "scores")
    limits = s.createDataFrame([("pv", "pv_export_total", 1000.0), ("ev", "ev_peak_band", 0.5), ("battery", "battery_dark_zero", 0.35)], "asset string, detector string, threshold double")
    return r6(fleet.meter_report(f, own, limits, own))


@query
def resolve_partner(s, d):
    z, m = roles.points(s, d)
    return fleet.meters_of_partner(z.withColumn("zp", F.concat(F.lit(" "), "zp")), m.withColumn("mp_id", F.col("mp_id").cast("string")), " 42 ")


@query
def explain_meter(s, d):
    rows = roles.scored_labels(s, d)
    return r6(fleet.explained(rows.select("asset", "detector", "mp_id", "score"), _limits(s), rows))


def _verdicts(s, d):
    f = roles.season(s, d)
    return fleet.verdicts(detectors.scores(f, blocks=False), fleet.years_of(f))


@query
def verdicts(s, d):
    return r6(_verdicts(s, d))


@query
def agreement(s, d):
    declared = fleet.declared_from_register(register.meter_table(roles.labels(s, d)))
    return fleet.agreement(_verdicts(s, d).join(declared, ["mp_id", "label"])).select("mp_id", "label", "verdict", "declared", "agreement")


@query
def declared_survey(s, d):
    return fleet.declared_from_survey(roles.profiles(s, d))


@query
def meter_day_totals(s, d):
    """The flagship: energy of each meter-day, from wide readings to import beside export."""
    f = roles.frame(s, d)
    return r6(f.groupBy("mp_id", "d").agg(F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh"), F.count("*").alias("n")))
