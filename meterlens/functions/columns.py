"""Column expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_SLOTS, SLOT_MINUTES


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is positive."""
    return F.when(b > 0, a / b)


def tri_state(x: str | Column) -> Column:
    """x or X: true; -: false; anything else: unknown."""
    t = F.lower(F.trim(c(x)))
    return F.when(t == "x", True).when(t == "-", False)


def german_date(x: str | Column) -> Column:
    """d.M.yyyy, d.M.yy (of this century) or yyyy-MM-dd; null where none fits."""
    t = F.trim(c(x))
    return F.coalesce(
        F.when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(t, "d.M.yyyy")),
        F.when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2}$"), F.try_to_date(t, "d.M.yy")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")),
    )


def decimal_comma(x: str | Column) -> Column:
    return F.expr("null").cast("double") if x is None else F.replace(F.trim(c(x)), F.lit(","), F.lit(".")).try_cast("double")


def plain_name(x: str | Column) -> Column:
    """Letters and digits alone, in lower case, umlauts without their dots."""
    folded = F.replace(F.translate(F.lower(F.trim(c(x))), "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def sunday_zero(d: str | Column) -> Column:
    return (F.dayofweek(c(d)) - 1).cast("long")


def is_dst_day(d: str | Column) -> Column:
    """The last Sunday of March or October."""
    d = c(d)
    return F.month(d).isin(3, 10) & (F.dayofweek(d) == 1) & (F.month(F.date_add(d, 7)) != F.month(d))


def slot_time(d: str | Column, slot: str | Column) -> Column:
    """Start of a slot (from 1) of a day, without a zone."""
    return F.timestamp_add("MINUTE", ((c(slot) - 1) * SLOT_MINUTES).cast("int"), c(d).cast("timestamp_ntz"))


def local_time(ts: str | Column, source: str = "Etc/GMT-1", target: str = "Europe/Zurich") -> Column:
    """Wall-clock time; the readings' own clock stands at UTC+1 all year."""
    return F.convert_timezone(F.lit(source), F.lit(target), c(ts))


def year_month(d: str | Column) -> Column:
    return F.date_format(c(d), "yyyy-MM")


# Arrays of slot values. ``slots``: kWh by slot, missing ones null.


def filled(slots: str | Column) -> Column:
    """The 96 slots of a normal day, missing ones as 0."""
    return F.transform(F.slice(c(slots), 1, DAY_SLOTS), lambda x: F.coalesce(x, F.lit(0.0)))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def array_std(a: Column, mean: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))


def array_quantile(ordered: Column, q: float) -> Column:
    """Of a sorted array, interpolated between neighbours."""
    at = F.lit(q) * (F.size(ordered) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return a + (b - a) * (at - low)


def window_sum(a: Column, first: int, last: int) -> Column:
    return array_sum(F.slice(a, first, last - first + 1))


def count_from(a: Column, level: float) -> Column:
    return F.size(F.filter(a, lambda x: x >= level)).cast("long")


def runs_from(a: Column, level: float) -> Column:
    """Lengths of the runs of values of at least ``level``."""
    below = F.filter(F.transform(a, lambda x, i: F.when(x < level, i + 1)), lambda i: i.isNotNull())
    ends = F.concat(F.array(F.lit(0)), below, F.array(F.size(a) + 1))  # places where no run is
    return F.filter(F.zip_with(F.slice(ends, 2, F.size(ends) - 1), F.slice(ends, 1, F.size(ends) - 1), lambda x, y: x - y - 1), lambda n: n > 0)


def steps(a: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(a, 2, DAY_SLOTS - 1), F.slice(a, 1, DAY_SLOTS - 1), lambda x, y: x - y)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of the score interval of a share, within 0 and 1."""
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def mixed(key: str | Column, seed: int = 0) -> Column:
    """A hash of the key and the seed as 32 hexadecimal digits, the same in any engine: md5 of seed|key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), c(key).cast("string")).cast("binary"))


def stable_uniform(key: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.conv(F.substring(mixed(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
