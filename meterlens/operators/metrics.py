"""Metrics over (y, score) tables; y: 1, 0 or null (unlabelled). Groups are columns, so one pass serves all detectors.

Bootstraps resample labelled meters of a group in NumPy: a group is the score rows of one
detector on one asset, as many as there are meters with a label.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mixed

CANDIDATES = 200
#: Stretches that a group's scores are ordered in.
PARTS = 64


def _labelled(df: DataFrame) -> DataFrame:
    return df.filter("y is not null and score is not null")


def _in_parts(rows: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """rows with __part, which rises with the value: a group's rows in PARTS stretches of about equal length, so that no task orders a whole group."""
    at = F.array(*(F.lit((i + 1) / PARTS) for i in range(PARTS - 1)))
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, at, F.lit(10_000)).alias("__cuts"))
    return rows.join(cuts, by).withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))).drop("__cuts")


def _running(rows: DataFrame, by: list[str], order: list, sums: dict[str, str], down: bool = False) -> DataFrame:
    """rows of _in_parts() with running sums (name: column) in their order: those within a part, and the totals of the parts before."""
    step = -F.col("__part") if down else F.col("__part")
    earlier = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    totals = totals.select(*by, "__part", *(F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(totals, [*by, "__part"]).withColumns({n: F.col(f"__b_{n}") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.drop(*(f"__b_{n}" for n in sums))


def _by_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Positives p and negatives n of each distinct score."""
    return _labelled(df).groupBy(*by, "score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties half; null without both classes."""
    rows = _running(_in_parts(_by_score(df, by), by), by, ["score"], {"upto": "n"})
    p, n = F.sum("p"), F.sum("n")
    pairs = F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2.0))
    return rows.groupBy(*by).agg(F.when((p > 0) & (n > 0), pairs / (p * n)).alias("auc"), p.alias("n_pos"), n.alias("n_neg"))


def average_precision(df: DataFrame, by: list[str], tie: str = "mp_id") -> DataFrame:
    """Mean of the precision at each positive, from the highest score down; equal scores by ``tie``."""
    rows = _labelled(df).withColumns({"__one": F.lit(1), "__hit": F.when(F.col("y") == 1, 1).otherwise(0)})
    rows = _running(_in_parts(rows, by), by, [F.desc("score"), tie], {"seen": "__one", "hits": "__hit"}, down=True)
    return rows.groupBy(*by).agg(F.avg(F.when(F.col("y") == 1, F.col("hits") / F.col("seen"))).alias("ap"))


def _flag(threshold: Column | str | float) -> Column:
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    return F.when(F.col("score") >= t, 1.0).otherwise(0.0)


def at_threshold(df: DataFrame, by: list[str], threshold: Column | str | float) -> DataFrame:
    """recall, precision, f1, youden, flag_rate (of the unlabelled) and lift at a threshold."""
    f, y = _flag(threshold), F.col("y")
    recall, fpr = F.avg(F.when(y == 1, f)), F.avg(F.when(y == 0, f))
    precision = F.avg(F.when(y.isNotNull() & (f == 1), F.when(y == 1, 1.0).otherwise(0.0)))
    rate = F.avg(F.when(y.isNull(), f))
    out = df.filter("score is not null").groupBy(*by).agg(recall.alias("recall"), precision.alias("precision"), (recall - fpr).alias("youden"), rate.alias("flag_rate"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r))).withColumn("lift", F.when(F.col("flag_rate") > 0, r / F.col("flag_rate")))


def threshold_for_share(df: DataFrame, by: list[str], prior: float | dict[str, float], default: float = 0.15) -> DataFrame:
    """The score that a share ``prior`` of the unlabelled reaches; prior by asset: one for each, ``default`` for others."""
    of = prior if isinstance(prior, dict) else {}
    shares = sorted({default if isinstance(prior, dict) else prior, *of.values()})
    cuts = df.filter("y is null and score is not null").groupBy(*by).agg(F.percentile("score", F.array(*(F.lit(1 - x) for x in shares))).alias("__cuts"))
    place = F.lit(shares.index(default if isinstance(prior, dict) else prior))
    for asset, share in of.items():
        place = F.when(F.col("asset") == asset, shares.index(share)).otherwise(place)
    return cuts.select(*by, F.get("__cuts", place).alias("threshold"))


def best_threshold(df: DataFrame, by: list[str], objective: str = "youden") -> DataFrame:
    """The observed score (of over 200, their quantiles) with the largest objective, the lowest of equals; without negatives the positives' 20th percentile.

    Scores are counted between neighbouring candidates, so that sums over CANDIDATES rows give what reaches each.
    """
    rows, counts = _labelled(df), _by_score(df, by)
    sizes = counts.groupBy(*by).agg(F.count("*").alias("k"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    few = counts.join(sizes.filter(f"k <= {CANDIDATES}").select(*by), by).groupBy(*by).agg(F.sort_array(F.collect_list("score")).alias("cuts"))
    grid = F.array(*(F.lit(i / (CANDIDATES - 1)) for i in range(CANDIDATES)))
    many = rows.join(sizes.filter(f"k > {CANDIDATES}").select(*by), by).groupBy(*by).agg(F.array_distinct(F.percentile("score", grid)).alias("cuts"))
    cuts = few.unionByName(many)
    reached = counts.join(cuts, by).groupBy(*by, F.size(F.filter("cuts", lambda c: c <= F.col("score"))).alias("upto")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    marks = cuts.select(*by, F.posexplode("cuts").alias("i", "t"))
    at = marks.join(reached, by, "left").groupBy(*by, "i", "t").agg(*(F.sum(F.when(F.col("upto") > F.col("i"), F.col(x)).otherwise(0)).alias(y) for x, y in (("p", "tp"), ("n", "fp"))))
    tpr, fpr = F.col("tp") / F.col("pos"), F.col("fp") / F.col("neg")
    value = tpr - fpr if objective == "youden" else 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    best = at.join(sizes, by).filter("pos > 0 and neg > 0").groupBy(*by).agg(F.max_by("t", F.struct(value, -F.col("t"))).alias("best"))
    pos_only = rows.groupBy(*by).agg(F.count_if(F.col("y") == 0).alias("neg"), F.percentile(F.when(F.col("y") == 1, F.col("score")), F.lit(0.2)).alias("low"))
    return pos_only.join(best, by, "left").select(*by, F.when(F.col("neg") == 0, F.col("low")).otherwise(F.col("best")).alias("threshold"))


def grouped_folds(groups: DataFrame, key: str, k: int = 5, seed: int = 7) -> DataFrame:
    """key, fold: whole groups dealt round k folds in the order of a hash of key and seed.

    Places are counted within the hash's first three digits, and those (4096 at most) are added up.
    """
    once = groups.select(key).distinct().withColumn("__h", mixed(key, seed))
    once = once.withColumn("__part", F.substring("__h", 1, 3))
    sizes = once.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__h", key)) - 1 + F.col("__before")
    return once.join(sizes.select("__part", before.alias("__before")), "__part").select(key, (place % k).cast("long").alias("fold"))


# Bootstraps.


def auc_of(y: np.ndarray, s: np.ndarray) -> float:
    p, n = int((y == 1).sum()), int((y == 0).sum())
    if not p or not n:
        return float("nan")
    ranks = pd.Series(s).rank().to_numpy()
    return float((ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n))


def recall_of(y: np.ndarray, s: np.ndarray, t: float) -> float:
    return float((s[y == 1] >= t).mean()) if (y == 1).any() else float("nan")


def precision_of(y: np.ndarray, s: np.ndarray, t: float) -> float:
    return float((y[s >= t] == 1).mean()) if (s >= t).any() else float("nan")


def _resampled(n: int, key: tuple, times: int) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(repr(key).encode())).integers(0, n, (times, n))


def bootstrap(df: DataFrame, by: list[str], fn: Callable[[np.ndarray, np.ndarray], float] = auc_of, times: int = 2000) -> DataFrame:
    """by, value, lo, hi: the metric and its 2.5 and 97.5 percentiles over resampled rows, the same on every run."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "y"], kind="stable")
        y, s = rows["y"].to_numpy(float), rows["score"].to_numpy(float)
        drawn = [v for i in _resampled(len(y), key, times) if not np.isnan(v := fn(y[i], s[i]))]
        lo, hi = np.quantile(drawn, [0.025, 0.975]) if drawn else (np.nan, np.nan)
        return pd.DataFrame([[*key, *(None if np.isnan(x) else x for x in (fn(y, s), lo, hi))]], columns=[*by, "value", "lo", "hi"])

    fields = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    return _labelled(df).groupBy(*by).applyInPandas(run, f"{fields}, value double, lo double, hi double")


def paired_bootstrap(df: DataFrame, by: list[str], fn: Callable[[np.ndarray, np.ndarray], float] = auc_of, times: int = 2000) -> DataFrame:
    """df with score_a and score_b -> by, diff (b less a), lo, hi, p (two-sided)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score_a", "score_b", "y"], kind="stable")
        y, a, b = (rows[c].to_numpy(float) for c in ("y", "score_a", "score_b"))
        drawn = np.array([v for i in _resampled(len(y), key, times) if not np.isnan(v := fn(y[i], b[i]) - fn(y[i], a[i]))])
        if not len(drawn):
            return pd.DataFrame([[*key, None, None, None, None]], columns=[*by, "diff", "lo", "hi", "p"])
        lo, hi = np.quantile(drawn, [0.025, 0.975])
        p = min(1.0, 2 * min((drawn <= 0).mean(), (drawn >= 0).mean()))
        return pd.DataFrame([[*key, fn(y, b) - fn(y, a), lo, hi, p]], columns=[*by, "diff", "lo", "hi", "p"])

    fields = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    own = df.filter("y is not null and score_a is not null and score_b is not null")
    return own.groupBy(*by).applyInPandas(run, f"{fields}, diff double, lo double, hi double, p double")


def percentile_in_pool(scores: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """scores (by, mp_id, score) with share: of the pool's scores, how many are lower. Running counts over both, no pairs."""
    both = pool.filter("score is not null").select(*by, "score", F.lit(1).alias("w"), F.lit(None).cast(scores.schema["mp_id"].dataType).alias("mp_id"), F.lit(1).alias("side"))
    both = both.unionByName(scores.select(*by, "score", F.lit(0).alias("w"), "mp_id", F.lit(0).alias("side")))
    total = both.groupBy(*by).agg(F.sum("w").alias("pool"))
    out = _running(_in_parts(both, by), by, ["score", "side"], {"below": "w"}).filter("side = 0").join(total, by)
    return out.select(*by, "mp_id", "score", F.when(F.col("score").isNotNull() & (F.col("pool") > 0), F.col("below") / F.col("pool")).alias("share"), "pool")
