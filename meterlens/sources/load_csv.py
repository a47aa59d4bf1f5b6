"""Load files and small tables as delivered: what they are, how they are laid out, and reading them.

A load file's header may leave out a column and its rows may be of different widths, so
the layout comes from the rows: all lines are looked at, in one Spark job, for their width
and for which field holds a date; most rows decide on both.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import german_date, year_month
from ..schema import MAX_SLOTS
from .files import first_line

BOM = "﻿"
CLOCK = re.compile(r"\d{1,2}:\d{2}")
# What the fields of a row look like.
PATTERNS = {"datum": r"^(\d{1,2}\.\d{1,2}\.(\d{2}|\d{4})|\d{4}-\d{2}-\d{2})$", "zp": r"^[A-Za-z]{2}[0-9A-Za-z]{10,}$", "obis": r"^\d+-\d+:"}
KINDS = ("load", "mpid_map", "zaehler_gp", "gigi", "unknown")
LEAST_SLOTS = 88


def plain(name: str) -> str:
    """Letters and digits of a header, in lower case, umlauts without their dots."""
    return re.sub("[^a-z0-9]", "", name.replace(BOM, "").strip().lower().translate(str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"})))


def kind_of(header: str) -> str:
    """What a file is, by its first line."""
    low = header.replace(BOM, "").lower()
    has = {"meter": "mp id" in low, "slots": "00:15" in low, "point": "zählpunkt" in low}
    if has["meter"] and has["slots"]:
        return "load"
    if has["meter"] and has["point"]:
        return "mpid_map"
    return "zaehler_gp" if "gpartner" in low else "gigi" if "gp-nr" in low else "unknown"


def classify(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The CSV files below a folder by kind, in order of their paths. Of each file one line is read, by the driver."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").format("binaryFile").load(folder).select("path")
    out: dict[str, list[str]] = {k: [] for k in KINDS}
    for path in sorted(r["path"] for r in files.collect()):
        out[kind_of(first_line(spark, path) or "")].append(path)
    return out


@dataclass
class Layout:
    meta: list[str]
    n_slots: int
    n_fields: int  # as most rows have
    trailing: bool
    widths: list[int]  # all that occur


def _separators(x) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(";")))


def _upto_first_like(line: str, pattern: str, fields: int = 12) -> Column:
    """A line up to the first field that looks like the pattern; empty: none of the first ``fields`` does."""
    field = pattern.removeprefix("^").removesuffix("$") + (r"(?=\x20*(?:;|$))" if pattern.endswith("$") else "")
    return F.regexp_extract(line, rf"^(?:[^;]*;){{0,{fields - 1}}}?\x20*{field}", 0)


def _header(spark: SparkSession, path: str) -> str:
    return (first_line(spark, path) or "").replace(BOM, "").rstrip("\r")


def layout_of(spark: SparkSession, path: str) -> Layout:
    """The layout of a load file; ValueError where it has none that makes sense."""
    header = _header(spark, path)
    if not header:
        raise ValueError(f"{path}: empty file")
    names = header.split(";")
    trailing = names[-1] == ""
    clocks = [i for i, x in enumerate(names) if CLOCK.fullmatch(x.strip())]
    meta = [plain(x) for x in names[: clocks[0]]] if clocks else []
    if "datum" not in meta:
        raise ValueError(f"{path}: no Datum column before HH:MM columns in {names[:8]}")
    after = meta[meta.index("datum") + 1 :]
    rows = spark.read.text(path).filter((F.col("value") != header) & (F.trim("value") != ""))
    seen = rows.select((_separators("value") + 1).alias("width"), *(_upto_first_like("value", p).alias(k) for k, p in PATTERNS.items()))
    seen = seen.select("width", *(F.when(F.col(k) != "", _separators(k) + 1).otherwise(0).alias(k) for k in PATTERNS))
    counts = seen.groupBy("width", *PATTERNS).agg(F.count("*").alias("n")).collect()  # a row for each shape that lines have
    usual = lambda k: max(((sum(r["n"] for r in counts if r[k] == v), -v) for v in {r[k] for r in counts} if v), default=(0, 0))[1] * -1
    facts = {"widths": {r["width"] for r in counts}, "usual": usual("width")} | {k: usual(k) for k in PATTERNS}
    if not facts["widths"]:
        raise ValueError(f"{path}: no data rows")
    if not facts["datum"]:
        raise ValueError(f"{path}: no field that looks like a date")
    n_meta = facts["datum"] + len(after)
    fields = facts["usual"]  # a stray separator in some row does not shift the others
    slots = fields - n_meta - trailing
    if not LEAST_SLOTS <= slots <= MAX_SLOTS:
        raise ValueError(f"{path}: {slots} slots in {fields} fields with {n_meta} before them is not a day")
    out = [f"meta{i}" for i in range(n_meta)]
    for k in PATTERNS:
        if facts[k] and facts[k] <= n_meta:
            out[facts[k] - 1] = k
    free = next((i for i in range(facts["datum"]) if out[i].startswith("meta")), None)
    if free is None or "obis" not in out:
        raise ValueError(f"{path}: cannot tell the meter and direction columns among {out}")
    out[free] = "mp_id"
    for i, name in enumerate(after):
        out[facts["datum"] + i] = name or out[facts["datum"] + i]
    return Layout(out, slots, fields, trailing, sorted(facts["widths"]))


def read_load(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """mp_id, zp, obis, plz, datum (text), d, ym, n_slots, slots of a load file. Short rows end in nulls; a value that is no number fails the read.

    Spark's CSV reader parses rows of the usual width straight to numbers. What it calls
    malformed (another width, no number) is split and converted field by field instead.
    """
    lay = layout or layout_of(spark, path)
    n = len(lay.meta)
    metas, slots = [f"meta_{i}" for i in range(n)], [f"slot_{i}" for i in range(lay.n_slots)]
    schema = ", ".join([*(f"{c} string" for c in metas), *(f"{c} double" for c in slots), *(["after string"] if lay.trailing else []), "line string"])
    form = {"sep": ";", "quote": "", "escape": "", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"}
    rows = spark.read.schema(schema).options(**form).csv(path)
    heads = [x.strip() or None for x in itertools.takewhile(lambda x: not CLOCK.fullmatch(x.strip()), _header(spark, path).split(";"))]
    is_header = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(metas, heads)))
    meta = dict(zip(lay.meta, (F.col(c) for c in metas)))
    none = F.lit(None).cast("string")
    fields = F.split("line", ";")
    each = F.transform(F.sequence(F.lit(n + 1), F.lit(n + MAX_SLOTS)), lambda i: F.when(i <= n + lay.n_slots, F.nullif(F.trim(F.try_element_at(fields, i)), F.lit("")).cast("double")))
    day = F.array(*(F.col(c) for c in slots), *[F.lit(None).cast("double")] * (MAX_SLOTS - lay.n_slots))
    meter = F.when(~is_header, meta["mp_id"]).cast("long")
    out = rows.filter(~is_header).select(meter.alias("mp_id"), meta.get("zp", none).alias("zp"), meta["obis"].alias("obis"), meta.get("plz", none).alias("plz"), meta["datum"].alias("datum"), F.lit(lay.n_slots).alias("n_slots"), F.when(F.col("line").isNull(), day).otherwise(each).alias("slots"))
    return out.withColumn("d", german_date("datum")).withColumn("ym", year_month("d"))


def read_small(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A table of texts: registers, mappings, survey answers, weather."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("mode", "FAILFAST").csv(path)


def resolved(columns: list[str], wanted: dict[str, list[str]]) -> dict[str, str | None]:
    """Logical names to a file's headers: an equal plain name of a candidate first, then one that holds it; None where neither is there."""
    plains = {plain(c): c for c in reversed(columns)}
    out: dict[str, str | None] = {}
    for name, candidates in wanted.items():
        keys = [plain(x) for x in candidates]
        exact = [plains[k] for k in keys if k in plains]
        part = [c for c in columns if any(k and k in plain(c) for k in keys)]
        out[name] = (exact + part + [None])[0]
    return out


def profile(rows: DataFrame) -> DataFrame:
    """What a load holds, in a row: sizes, dates, directions, rows without or with some values, rows without date or meter, repeated keys."""
    present = F.size(F.filter("slots", lambda x: x.isNotNull()))
    key = F.concat_ws("|", "mp_id", "obis", "datum")
    return rows.agg(
        F.count("*").alias("n_rows"), F.countDistinct("mp_id").alias("meters"), F.min("d").alias("date_min"), F.max("d").alias("date_max"), F.countDistinct("obis").alias("n_obis"), F.count_if(present == 0).alias("empty_rows"),
        F.count_if(present.between(1, F.col("n_slots") - 1)).alias("partial_rows"), F.count_if(F.col("datum").isNull() | F.col("mp_id").isNull()).alias("unparsable_rows"), (F.count("*") - F.countDistinct(key)).alias("duplicate_rows"),
    )
