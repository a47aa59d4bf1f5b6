"""Test tables in the roles of readings, register, survey and scores (a fixed mapping, the same in Spark and in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_dst_day
from ..operators.features import day_features
from ..operators.slots import deduplicated, side_by_side, to_long, to_wide
from ..schema import EXPORT, IMPORT
from .files import moved, put, scratch


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, mp_id, obis, d, slot_idx, kwh."""
    slot = F.hour("ts") * 4 + F.floor(F.minute("ts") / 15) + 1
    obis = F.when(F.col("event_type") == "purchase", EXPORT).otherwise(IMPORT)
    return source(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("mp_id"), obis.alias("obis"), F.to_date("ts").alias("d"), slot.cast("long").alias("slot_idx"), (F.col("value") / 100).alias("kwh"))


def unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(events(spark, sf_dir), ["mp_id", "obis", "d", "slot_idx"], ["event_id"])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mp_id, obis, d, slots."""
    return to_wide(unique_events(spark, sf_dir), ["mp_id", "obis", "d"])


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(wide(spark, sf_dir))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mp_id, ts, d, slot_idx, import_kwh, export_kwh, dst_day."""
    return side_by_side(long(spark, sf_dir), ["mp_id", "ts", "d", "slot_idx"])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_features(wide(spark, sf_dir))


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of readings of four meters, and few of a hundred others, as a detector takes them, with a made-up temperature by hour."""
    t = source(spark, sf_dir, "lineitem")
    ts = F.timestamp_add("MINUTE", (15 * (F.col("l_orderkey") % 96)).cast("int"), F.col("l_shipdate").cast("timestamp_ntz"))
    out_ = F.col("l_returnflag") == "R"
    rows = t.select(F.when(F.col("l_orderkey") % 5 == 0, 100 + F.col("l_partkey") % 97).otherwise(F.col("l_suppkey") % 4).alias("mp_id"), ts.alias("ts"), (F.col("l_quantity") / 16).alias("kwh"), out_.alias("out"))
    rows = rows.groupBy("mp_id", "ts").agg(F.sum(F.when(~F.col("out"), F.col("kwh"))).alias("import_kwh"), F.sum(F.when(F.col("out"), F.col("kwh"))).alias("export_kwh"))
    rows = rows.withColumn("d", F.to_date("ts")).withColumn("hour", F.hour("ts"))
    return rows.withColumn("dst_day", is_dst_day("d")).withColumn("temp_c", F.round(10 - 10 * F.cos(2 * F.pi() * F.dayofyear("d") / 365), 2))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as register rows: flags as the register writes them, and dates of which some are missing."""
    o = source(spark, sf_dir, "orders")
    flag = lambda k: F.when((F.col("o_orderkey") + k) % 3 == 0, F.when(F.col("o_orderpriority") == "1-URGENT", " X").when(F.col("o_orderpriority") == "5-LOW", "-")).otherwise(F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "O", " - "))
    day = lambda k, days: F.when(F.col("o_orderkey") % 4 != k, F.date_format(F.date_add(F.to_date("o_orderdate"), days), "d.M.yyyy"))
    return o.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("GP-Nr"), flag(0).alias("PV"), flag(1).alias("HP"), flag(2).alias("EV"), flag(3).alias("BAT"), flag(4).alias("BOIL"), F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(",5")).alias("KWP"),
        day(0, 42).alias("INB"), day(1, -145).alias("SIG"), day(2, -17).alias("BAU"), day(3, 30).alias("UEB"), F.lit("5000").alias("PLZ"), F.lit(" Ort ").alias("ORT"),
    )


COLUMNS = {"gp": "GP-Nr", "hp": "HP", "pv": "PV", "battery": "BAT", "ev": "EV", "hp_boil": "BOIL", "kwp": "KWP", "inbetr": "INB", "signed": "SIG", "baustart": "BAU", "uebergabe": "UEB", "plz": "PLZ", "ort": "ORT"}


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Partner to point, point to meter: a customer's point; customers share a meter's number space with the events' users."""
    c = source(spark, sf_dir, "customer")
    zp = F.concat(F.lit("CH"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return c.select(zp.alias("zp"), F.col("c_custkey").cast("string").alias("gp")), c.select(zp.alias("zp"), (F.col("c_custkey") % 200).alias("mp_id"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.register import labelled_meters, register_rows

    z, m = points(spark, sf_dir)
    return labelled_meters(register_rows(register(spark, sf_dir), COLUMNS), z, m)


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stratum, asset, detector, mp_id, gp, y, score: documents as meters, their length as the score."""
    d, y = source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels")
    rows = d.join(y, "doc_id", "left")
    one = lambda name, s: rows.select(F.lit("all").alias("stratum"), F.lit("pv").alias("asset"), F.lit(name).alias("detector"), F.col("doc_id").alias("mp_id"), F.col("source").alias("gp"), F.col("quality").cast("double").alias("y"), s.alias("score"))
    return one("length", F.col("n_chars").cast("double")).unionByName(one("mixed", ((F.col("doc_id") * 37) % 101).cast("double")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as households of the survey."""
    c = source(spark, sf_dir, "customer")
    heat = ("airWaterPump", "geothermalHeatPump", "electricRadiator", "oilHeating", "wood", "unknown")
    water = ("boiler", "heatPumpBoiler", "unknown", "solar")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return c.select(
        F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("location_profile_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("gpnr"), F.when(F.col("c_mktsegment") == "BUILDING", "true").when(F.col("c_acctbal") > 0, "false").alias("solar_installed"),
        F.when(F.col("c_custkey") % 7 == 0, "true").otherwise("false").alias("electric_car"), pick(heat).alias("heating_type_primary"), F.when(F.col("c_custkey") % 11 != 0, pick(water)).alias("hotwater_type"),
    )


DENSE_DAYS = 14


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of made-up readings of all customers: a timer (even keys) or sessions at odd times, one day missing."""
    k = source(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mp_id"))
    rows = k.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(DENSE_DAYS - 1)))).withColumn("sl", F.explode(F.sequence(F.lit(0), F.lit(95))))
    start = lambda day: (F.col("mp_id") * 37 + day * 53) % 96
    at, before = F.col("sl") - start(F.col("dy")), F.col("sl") + 96 - start(F.col("dy") - 1)
    session = at.between(0, 7) | ((F.col("dy") > 0) & before.between(0, 7))
    timer = F.col("sl").between(8, 15)
    v = F.when(F.col("mp_id") % 2 == 0, F.when(timer, 1.0).otherwise(0.05)).otherwise(F.when(session, 1.8).otherwise(0.05))
    ts = F.timestamp_add("MINUTE", (F.col("dy") * 1440 + F.col("sl") * 15).cast("int"), F.lit("2024-05-01").cast("timestamp_ntz"))
    rows = rows.filter(F.col("dy") != (F.col("mp_id") * 7) % DENSE_DAYS).select("mp_id", ts.alias("ts"), v.alias("import_kwh"))
    return rows.withColumn("d", F.to_date("ts")).withColumn("dst_day", F.lit(False))


HEADER = ";".join(["\ufeffMP ID", "Zählpunktbezeichnung", "OBIS-Code", "Datum", "PLZ", *(f"{i // 4:02d}:{i % 4 * 15:02d}" for i in [*range(1, 96), 0]), ""])


def load_file(spark: SparkSession, sf_dir: str) -> str:
    """The wide readings as a load file as delivered; some rows lack a date or a meter, some end after 50 slots. Returns its path."""
    w = wide(spark, sf_dir)
    values = F.transform(F.slice("slots", 1, 96), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    values = F.when(F.dayofmonth("d") % 7 == 3, F.array_join(F.slice(values, 1, 50), ";")).otherwise(F.concat(F.array_join(values, ";"), F.lit(";")))
    meter = F.col("mp_id").cast("string")
    fields = [F.when(F.col("mp_id") % 23 != 0, meter).otherwise(""), F.concat(F.lit("CH"), F.lpad(meter, 12, "0")), "obis", F.when(F.col("mp_id") % 19 != 0, F.date_format("d", "dd.MM.yyyy")).otherwise(""), F.lit(" 5000 "), values]
    lines = w.select(F.lit(1).alias("o"), F.concat_ws(";", *fields).alias("value"))
    head = spark.createDataFrame([(0, HEADER)], "o int, value string")
    folder = scratch(spark, "load")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{folder}/parts")
    part = spark.read.format("binaryFile").load(f"{folder}/parts").select("path").first()["path"]
    moved(spark, part, f"{folder}/load.csv")
    return f"{folder}/load.csv"


def mixed_folder(spark: SparkSession) -> str:
    """A folder with one small file of each kind, one of them below."""
    folder = scratch(spark, "mixed")
    for name, head in (("a.csv", HEADER), ("sub/b.csv", "MP ID;Zählpunktbezeichnung;Ort"), ("c.csv", "Zählpunkt;GPartner"), ("d.csv", "GP-Nr; PV;EV"), ("e.csv", "something;else"), ("f.txt", "GP-Nr")):
        put(spark, f"{folder}/{name}", head + "\r\n1;2;3\r\n")
    return folder


def drifted(spark: SparkSession, sf_dir: str) -> str:
    """Customers as a small delivered table whose headers have drifted. Returns its folder."""
    c = source(spark, sf_dir, "customer")
    folder = scratch(spark, "drifted")
    c.select(F.col("c_custkey").cast("string").alias("\ufeffGP-Nr."), F.col("c_mktsegment").alias(" PV "), F.col("c_nationkey").cast("string").alias("PV-Leistung in kWp "), F.col("c_name").alias("Wärmepumpe")).write.option("header", True).option("sep", ";").csv(folder)
    return folder
