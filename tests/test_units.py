"""Edge cases by hand, properties, and operators that the test tables do not reach."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.functions import columns as fx
from meterlens.operators import blocks, metrics, register, slots
from meterlens.plans import detectors, evaluate
from meterlens.sources import load_csv, raw_store
from meterlens.streaming.daily import daily_energy


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) if values else [F.lit(1)])
    return df.select(column).first()[0]


def test_tri_state(spark):
    assert [one(spark, fx.tri_state("v"), v=v) for v in (" X", "x", " - ", "?", "")] == [True, True, False, None, None]


@pytest.mark.parametrize("text,want", [("1.9.2023", dt.date(2023, 9, 1)), ("01.09.23", dt.date(2023, 9, 1)), ("2023-09-01", dt.date(2023, 9, 1)), ("31.2.2023", None), ("x", None)])
def test_dates(spark, text, want):
    assert one(spark, fx.german_date("v"), v=text) == want


def test_local_time(spark):
    def at(text):
        return one(spark, fx.local_time(F.lit(text).cast("timestamp_ntz")))

    assert at("2025-07-01 12:00").hour == 13 and at("2025-01-01 12:00").hour == 12
    assert at("2025-10-26 01:30") == at("2025-10-26 02:30") == dt.datetime(2025, 10, 26, 2, 30)


def test_dst_days(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as d").filter(fx.is_dst_day("d"))
    assert [r[0] for r in days.collect()] == [dt.date(2024, 3, 31), dt.date(2024, 10, 27)]


def test_header_names():
    assert load_csv.plain(" PV-Leistung in kWp ") == "pvleistunginkwp" and load_csv.plain("Zählpunktbezeichnung") == "zahlpunktbezeichnung" and load_csv.plain("Straße") == "strasse"
    got = load_csv.resolved([" PV", "PV-Leistung in kWp ", "Wärmepumpe"], {"pv": ["PV"], "kwp": ["Leistung"], "hp": ["Waermepumpe", "Warmepumpe"], "no": ["EV"]})
    assert got == {"pv": " PV", "kwp": "PV-Leistung in kWp ", "hp": "Wärmepumpe", "no": None}


def test_wide_to_long_round_trip(spark):
    rng = random.Random(1)
    rows = [(m, "1-1:1.29.0*255", dt.date(2024, 3, d), s, round(rng.random(), 3)) for m in (1, 2) for d in (30, 31) for s in rng.sample(range(1, 97), 30)]
    long = spark.createDataFrame(rows, "mp_id long, obis string, d date, slot_idx long, kwh double")
    back = slots.to_long(slots.to_wide(long, ["mp_id", "obis", "d"]))
    assert sorted((r.mp_id, r.obis, r.d, r.slot_idx, r.kwh) for r in back.collect()) == sorted(rows)


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, 2, "b"), (2, 5, "c")], "k long, o long, v string")
    once = slots.deduplicated(df, ["k"], ["o"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, slots.deduplicated(once, ["k"], ["o"]).collect())) == [(1, 2, "b"), (2, 5, "c")]


def brute_blocks(ts, v, low=0.85, high=3.2):
    inside = [x >= low and (i == 0 or ts[i] - ts[i - 1] == dt.timedelta(minutes=15)) for i, x in enumerate(v)]
    out, i = [], 0
    while i < len(v):
        j = i
        while j < len(v) and inside[j]:
            j += 1
        own = np.array(v[i:j])
        if len(own) >= 3 and low <= own.mean() <= high and own.std() <= 0.3 * own.mean():
            out.append((ts[i], len(own)))
        i = max(j, i + 1)
    return out


def test_blocks_brute(spark):
    rng = random.Random(7)
    at, ts, v = dt.datetime(2024, 1, 1), [], []
    level = 0.1
    for _ in range(3000):
        if rng.random() < 0.12:
            level = rng.choice((0.1, 0.9, 1.8, 2.7, 4.0))
        if rng.random() > 0.02:
            ts.append(at)
            v.append(round(level * rng.uniform(0.8, 1.2), 3))
        at += dt.timedelta(minutes=15)
    df = spark.createDataFrame([(1, a, b) for a, b in zip(ts, v)], "mp_id long, ts timestamp_ntz, import_kwh double")
    got = sorted((r.start_ts, r.length) for r in blocks.sustained_blocks(df).collect())
    assert got == brute_blocks(ts, v) and len(got) > 20


def test_block_after_gap_and_few(spark):
    start = dt.datetime(2024, 1, 1, 23, 0)
    rows = [(1, start + dt.timedelta(minutes=15 * i), 1.0) for i in range(8)] + [(1, start + dt.timedelta(hours=9, minutes=15 * i), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "mp_id long, ts timestamp_ntz, import_kwh double").withColumn("d", F.to_date("ts")).withColumn("dst_day", F.lit(False))
    got = blocks.sustained_blocks(df).collect()
    assert [(r.start_slot, r.length) for r in got] == [(92, 8)]  # the three after the gap are two
    assert blocks.ev_sustained_blocks(df).first().score == 0.0


def test_slope_of_constant_days(spark):
    """Days that all use the same: a slope of zero and no correlation, no error."""
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0, None, float(i % 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "mp_id long, ts timestamp_ntz, import_kwh double, export_kwh double, temp_c double")
    df = df.withColumn("d", F.to_date("ts")).withColumn("hour", F.hour("ts")).withColumn("dst_day", F.lit(False))
    got = {r.detector: (r.score, r.evidence) for r in detectors.scores(df).collect()}
    assert got["hp_temp_slope"][0] == 0.0 and got["hp_temp_slope"][1]["corr"] is None


def test_ranks_with_heavy_ties(spark):
    """A score that most rows have, beside others: parts of unlike size."""
    rng = np.random.default_rng(5)
    s = np.where(rng.random(1500) < 0.6, 0.0, np.round(rng.random(1500), 2))
    y = (rng.random(1500) < 0.3 + 0.3 * s).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "y": y, "score": s, "mp_id": range(1500)}))
    assert abs(metrics.roc_auc(df, ["g"]).first().auc - metrics.auc_of(y, s)) < 1e-12
    order = np.lexsort((np.arange(1500), -s))
    precision = np.cumsum(y[order]) / np.arange(1, 1501)
    assert abs(metrics.average_precision(df, ["g"]).first().ap - precision[y[order] == 1].mean()) < 1e-12
    placed = {r.mp_id: r.share for r in metrics.percentile_in_pool(df.select("g", "mp_id", "score"), df, ["g"]).collect()}
    assert all(abs(placed[i] - (s < s[i]).mean()) < 1e-12 for i in range(1500))


def test_auc_properties(spark):
    df = spark.createDataFrame([("a", float(i % 2), 1.0, i) for i in range(10)] + [("b", 1.0, 2.0, 1), ("b", 0.0, 1.0, 2), ("b", None, 5.0, 3), ("c", 1.0, 1.0, 1)], "g string, y double, score double, mp_id long")
    got = {r.g: r.auc for r in metrics.roc_auc(df, ["g"]).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": None}


def test_threshold_brute(spark):
    rng = np.random.default_rng(2)
    for n, wide in ((60, False), (900, True)):
        s = np.round(rng.random(n), 6 if wide else 2)
        y = (rng.random(n) < s).astype(float)
        cuts = np.unique(s) if len(np.unique(s)) <= 200 else np.quantile(s, np.linspace(0, 1, 200))
        j = [(s[y == 1] >= t).mean() - (s[y == 0] >= t).mean() for t in cuts]
        df = spark.createDataFrame(pd.DataFrame({"g": "x", "y": y, "score": s, "mp_id": range(n)}))
        got = metrics.best_threshold(df, ["g"]).first().threshold
        assert abs((s[y == 1] >= got).mean() - (s[y == 0] >= got).mean() - max(j)) < 1e-9
    only = spark.createDataFrame([("x", 1.0, float(i)) for i in range(11)], "g string, y double, score double")
    assert metrics.best_threshold(only, ["g"]).first().threshold == 2.0


def test_folds_keep_groups(spark):
    df = spark.createDataFrame([(i, f"g{i % 13}") for i in range(100)], "mp_id long, gp string")
    folds = metrics.grouped_folds(df, "gp")
    counts = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert folds.count() == 13 and max(counts) - min(counts) <= 1


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([("a", float(i % 3 == 0), float((i * 7) % 11)) for i in range(60)], "g string, y double, score double")
    a, b = (metrics.bootstrap(df, ["g"], times=100).first() for _ in range(2))
    assert a == b and a.lo <= a.value <= a.hi


def test_unambiguous_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "mp_id long, n_meters_for_gp long")
    assert sorted(r.mp_id for r in register.unambiguous(df).collect()) == [1, 3]


def test_detector_guard_and_own_detector(spark):
    rows = [(1, dt.datetime(2024, 7, 1) + dt.timedelta(minutes=15 * i), 0.01, None) for i in range(50)]
    df = spark.createDataFrame(rows, "mp_id long, ts timestamp_ntz, import_kwh double, export_kwh double")
    df = df.withColumn("d", F.to_date("ts")).withColumn("hour", F.hour("ts")).withColumn("dst_day", F.lit(False))
    got = {r.detector: r.score for r in detectors.scores(df, random_assets=("pv",)).collect()}
    assert got["battery_dark_zero"] is None and got["pv_export_total"] == 0.0 and 0 <= got["random_pv"] < 1 and got["ev_sustained_blocks"] == 0.0
    assert detectors.scored_by(df, "mine", "pv", lambda m, x: len(x)).first().score == 50.0
    assert detectors.scored_by(df, "bad", "pv", lambda m, x: 1 / 0).first().score is None


def test_score_cache(spark, tmp_path):
    known = spark.createDataFrame([(1, "a", 1.0)], "mp_id long, detector string, score double")
    known.write.parquet(f"{tmp_path}/known")
    meters = spark.createDataFrame([(1,), (2,)], "mp_id long")
    first = evaluate.cached_scores(f"{tmp_path}/none", meters, spark.createDataFrame([("a",)], "detector string"), lambda m: m.select("mp_id", F.explode("detectors").alias("detector"), F.lit(7.0).alias("score")), f"{tmp_path}/first")
    assert sorted(map(tuple, first.collect())) == [(1, "a", 7.0), (2, "a", 7.0)]
    out = evaluate.cached_scores(f"{tmp_path}/known", meters, spark.createDataFrame([("a",)], "detector string"), lambda m: m.select("mp_id", F.lit("a").alias("detector"), F.lit(5.0).alias("score")), f"{tmp_path}/new")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1.0), (2, "a", 5.0)]


def load_file(path, named=True, date="01.09.2023", slots_=96, trailing=True, rows=3):
    clock = [f"{i // 4:02d}:{i % 4 * 15:02d}" for i in [*range(1, slots_), 0]]
    head = ["MP ID", *(["Zählpunktbezeichnung"] if named else []), "OBIS-Code", "Datum", "PLZ", *clock]
    lines = ["﻿" + ";".join(head) + ";" * trailing]
    for r in range(rows):
        lines.append(";".join([str(100 + r), "CH10000000000000000", "1-1:1.29.0*255", date, "5000", *(str(i / 100) if i % 5 else "" for i in range(slots_))]) + ";" * trailing)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("named,slots_,trailing", [(True, 96, True), (False, 96, True), (False, 100, False), (True, 92, False)])
def test_load_layouts(spark, tmp_path, named, slots_, trailing):
    path = load_file(tmp_path / "a.csv", named, slots_=slots_, trailing=trailing)
    lay = load_csv.layout_of(spark, path)
    assert lay.meta == ["mp_id", "zp", "obis", "datum", "plz"] and lay.n_slots == slots_ and lay.trailing == trailing
    row = load_csv.read_load(spark, path).orderBy("mp_id").first()
    assert row.mp_id == 100 and row.zp == "CH10000000000000000" and row.d == dt.date(2023, 9, 1) and row.slots[1] == 0.01 and row.slots[0] is None and len(row.slots) == 100


def test_load_refuses(spark, tmp_path):
    with pytest.raises(ValueError):
        load_csv.layout_of(spark, load_file(tmp_path / "b.csv", date="Sep 1"))
    with pytest.raises(ValueError):
        raw_store.converted(load_csv.read_load(spark, load_file(tmp_path / "c.csv", date="31.02.2023")))


def test_convert_once(spark, tmp_path):
    path, out = load_file(tmp_path / "d.csv"), str(tmp_path / "out")
    assert raw_store.convert(spark, [path], out) == [path] and raw_store.convert(spark, [path], out) == []
    raw = raw_store.read_raw(spark, out)
    assert raw.count() == 3 and raw.filter("ym = '2023-09'").count() == 3
    raw_store.readings_view(raw)
    assert spark.sql("select count(*) from readings").first()[0] == 3 * 76
    report = raw_store.profile_files(spark, [path], out).first()
    assert report.n_rows == 3 and report.fatal is None and report.empty_rows == 0 and report.partial_rows == 3
    assert load_csv.classify(spark, str(tmp_path))["load"][0].endswith("d.csv")


def test_load_rows_of_all_kinds(spark, tmp_path):
    """A header that comes again is no row, a short row ends in nulls, what follows the usual width is left out; a value that is no number fails."""
    path = tmp_path / "g.csv"
    load_file(path, rows=4)
    head, first, second, third, fourth = path.read_text(encoding="utf-8").rstrip("\n").split("\n")
    short = ";".join(second.split(";")[:10])
    path.write_text("\r\n".join([head, first, short, head.lstrip("\ufeff"), "", third + "x;y", " " + fourth.replace(";0.01;", "; 0.01 ;")]), encoding="utf-8")
    got = load_csv.read_load(spark, str(path)).orderBy("mp_id").collect()
    assert [(r.mp_id, str(r.d), len(r.slots)) for r in got] == [(m, "2023-09-01", 100) for m in range(100, 104)]
    assert [x for x in got[1].slots if x is not None] == [0.01, 0.02, 0.03, 0.04] and got[0].slots == got[2].slots == got[3].slots
    assert load_csv.read_load(spark, str(path)).select("mp_id").count() == 4
    path.write_text("\n".join([head, first, second.replace(";0.01;", ";0,01;"), third]), encoding="utf-8")
    with pytest.raises(Exception, match="0,01"):
        raw_store.convert(spark, [str(path)], str(tmp_path / "out"))


def test_convert_again(spark, tmp_path):
    """By force, or where the file has changed, a file's rows are replaced; a bad one leaves what was there; a stray separator shifts nothing."""
    path, out = load_file(tmp_path / "d.csv"), str(tmp_path / "out")
    raw_store.convert(spark, [path], out)
    assert raw_store.convert(spark, [path], out, force=True) == [path] and raw_store.read_raw(spark, out).count() == 3
    load_file(tmp_path / "d.csv", rows=5)
    assert raw_store.convert(spark, [path], out) == [path] and raw_store.read_raw(spark, out).count() == 5
    other = load_file(tmp_path / "e.csv", date="02.10.2023")
    raw_store.convert(spark, [path, other], out)
    assert sorted(r.ym for r in raw_store.read_raw(spark, out).select("ym").distinct().collect()) == ["2023-09", "2023-10"]
    load_file(tmp_path / "e.csv", date="31.02.2023")
    with pytest.raises(ValueError):
        raw_store.convert(spark, [other], out)
    assert raw_store.read_raw(spark, out).count() == 8
    text = (tmp_path / "d.csv").read_text(encoding="utf-8").split("\n")
    (tmp_path / "f.csv").write_text("\n".join([*text[:2], text[2] + ";stray;x", *text[3:]]), encoding="utf-8")
    assert load_csv.layout_of(spark, str(tmp_path / "f.csv")).n_slots == 96


def test_kinds():
    assert [load_csv.kind_of(h) for h in ("MP ID;OBIS;Datum;00:15", "MP ID;Zählpunktbezeichnung", "Zählpunkt;GPartner", "GP-Nr; PV", "x")] == ["load", "mpid_map", "zaehler_gp", "gigi", "unknown"]


def test_streaming(spark, tmp_path):
    rows = [(1, "i", dt.datetime(2024, 1, 1, 10), 1.0), (1, "i", dt.datetime(2024, 1, 1, 10), 1.0), (1, "i", dt.datetime(2024, 1, 1, 11), 2.0)]
    spark.createDataFrame(rows, "mp_id long, obis string, ts timestamp, kwh double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("mp_id long, obis string, ts timestamp, kwh double").parquet(f"{tmp_path}/in")
    q = daily_energy(stream).writeStream.format("memory").queryName("daily").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.kwh, r.n) for r in spark.sql("select * from daily").collect()] == [(3.0, 2)]


def test_bootstrap_queries_resample_in_full(spark, sf):
    from meterlens import queries
    from meterlens.operators import metrics
    from meterlens.sources import roles

    want = metrics.bootstrap(roles.scored_labels(spark, sf), queries.BY, times=2000).collect()
    assert sorted(queries.bootstrap_auc(spark, sf).collect()) == sorted(want)
    drawn = []
    real = queries.metrics.paired_bootstrap
    queries.metrics.paired_bootstrap = lambda df, by, *a, times=2000, **k: drawn.append(times) or real(df, by, *a, times=1, **k)
    try:
        queries.paired_bootstrap(spark, sf)
        queries.head_to_head(spark, sf)
    finally:
        queries.metrics.paired_bootstrap = real
    assert drawn == [2000, 2000]
