"""The wide raw layer: Parquet by file and month, a manifest of converted files, views, and reports as JSON."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slots import to_long
from .files import exists, moved, removed, stamp
from .load_csv import Layout, layout_of, profile, read_load

MAX_DIRECTIONS = 10
UNREADABLE = "unreadable"
#: Bytes of a load file that a task converts, and how few it may be.
PART, LEAST_PART = 128 << 20, 16 << 20


def _bad_date():
    return F.col("datum").isNotNull() & F.col("d").isNull()


def unreadable_dates(rows: DataFrame) -> int:
    return rows.filter(_bad_date()).count()


def _refused(bad: int) -> None:
    if bad:
        raise ValueError(f"{bad} rows have a date that cannot be read; the layout is likely wrong")


def _stored(rows: DataFrame) -> DataFrame:
    return rows.select("mp_id", "zp", "obis", "plz", "d", "n_slots", "slots", "ym")


def converted(rows: DataFrame) -> DataFrame:
    """Rows of a load that can be stored; ValueError where a date cannot be read, as a shifted layout shows up so."""
    _refused(unreadable_dates(rows))
    return _stored(rows.filter("mp_id is not null and d is not null"))


def _parts(spark: SparkSession, size: int) -> int:
    """Into how many parts a load file of a size is converted: of PART bytes, or smaller ones as long as there are cores for them."""
    return max(1, -(-size // PART), min(spark.sparkContext.defaultParallelism, size // LEAST_PART))


def convert(spark: SparkSession, paths: list[str], out: str, force: bool = False) -> list[str]:
    """Puts load files into out/raw (by file and ym, zstd) and returns those that were converted. A file counts as done while its path, length and time stay.

    A file's rows are a folder of their own that is written aside and then put in the
    old one's place: converting it again, or after a crash, replaces and never adds.
    Rows are looked at and written in one pass: those whose date cannot be read go to a
    month of their own, and if there are any the file is refused and what was there stays.
    """
    done = {r["stamp"] for r in spark.read.json(f"{out}/_converted").select("stamp").collect()} if exists(spark, f"{out}/_converted") else set()
    new = []
    for path in paths:
        mark = stamp(spark, path)
        if mark in done and not force:
            continue
        size = int(mark.rsplit("|", 2)[1])
        own = f"f{hashlib.md5(mark.split('|')[0].encode()).hexdigest()}"
        aside = f"{out}/raw/_aside-{own}"
        rows = read_load(spark, path).filter((F.col("mp_id").isNotNull() & F.col("d").isNotNull()) | _bad_date())
        rows = _stored(rows.withColumn("ym", F.when(_bad_date(), UNREADABLE).otherwise(F.col("ym"))))
        # No shuffle: each part of the file is sorted and written where it is read, so that a month is not one task's.
        rows.coalesce(_parts(spark, size)).sortWithinPartitions("ym", "mp_id", "d").write.mode("overwrite").partitionBy("ym").option("compression", "zstd").parquet(aside)
        if exists(spark, f"{aside}/ym={UNREADABLE}"):
            bad = spark.read.parquet(f"{aside}/ym={UNREADABLE}").count()
            removed(spark, aside)
            _refused(bad)
        moved(spark, aside, f"{out}/raw/src={own}")
        spark.createDataFrame([(mark,)], "stamp string").coalesce(1).write.mode("append").json(f"{out}/_converted")
        new.append(path)
    return new


def read_raw(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/raw").drop("src")


def readings_view(raw: DataFrame, name: str = "readings") -> DataFrame:
    """The long readings as a view for SQL."""
    long = to_long(raw)
    long.createOrReplaceTempView(name)
    return long


def profile_files(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """A row per load file, with what forbids its conversion, also written as out/profile (JSON)."""
    all_rows = None
    for path in paths:
        lay: Layout = layout_of(spark, path)
        row = profile(read_load(spark, path, lay)).withColumn("path", F.lit(path)).withColumn("slots_a_day", F.lit(lay.n_slots))
        fatal = F.when(F.col("n_obis") > MAX_DIRECTIONS, "too many directions").when(F.col("date_min").isNull() | (F.col("unparsable_rows") > 0), "dates or meters missing")
        row = row.withColumn("empty_pct", F.round(100.0 * F.col("empty_rows") / F.col("n_rows"), 2)).withColumn("fatal", fatal)
        all_rows = row if all_rows is None else all_rows.unionByName(row)
    if all_rows is None:
        raise ValueError("no load files")
    all_rows.coalesce(1).write.mode("overwrite").json(f"{out}/profile")
    return spark.read.schema(all_rows.schema).json(f"{out}/profile")


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Scores, features, boards: as Parquet, or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)
