"""Mixing sources to target weights by the cube method.

A source's target over its size says how often each of its documents is taken: a
whole number of times and, with a probability, once more. The cube method draws the
latter so that the documents and words drawn match their expectations: probabilities
move along the null space of the two balancing equations until they are 0 or 1. Each
block of documents makes this flight by itself and leaves at most two undecided;
these fly again in ever fewer blocks, and the last two of a source land on the choice
that errs least.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored, unused, word_count

REPEATS = 3
WEIGHTS = (1, 2, 3)
BLOCK = 4096
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: shares of all words by weight, none above `repeats` times its size, excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    free, left, out = [s for s, _ in order], float(sum(size.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > repeats * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(repeats * size[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in set(over)]
    return out


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight phase: all but two at most are 0 or 1, and the sums of p and of p * size hold.

    Three undecided documents at a time: two equations leave one direction to move in.
    The longest documents go first, so that those left undecided are short.
    """
    p, rng = [float(x) for x in p], np.random.default_rng(seed)
    order = np.argsort(-np.asarray(size, float), kind="stable").tolist()
    draws = iter(rng.random(len(p) + 3).tolist())  # each step decides one document at least
    size = [float(x) for x in size]
    at, active = 0, []
    while True:
        while len(active) < 3 and at < len(order):
            if EPS < p[order[at]] < 1 - EPS:
                active.append(order[at])
            at += 1
        if len(active) < 3:
            return np.array(p)
        i, j, k = active
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])  # sums to 0, as does u * size
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(active, u) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(active, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for x, v in zip(active, u):
            p[x] = min(1.0, max(0.0, p[x] + step * v))
        active = [x for x in active if EPS < p[x] < 1 - EPS]


def landing(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Decides the last two or fewer: of the draws with these probabilities, the one with the least expected error in words."""
    p, open_ = p.copy(), np.flatnonzero((p > EPS) & (p < 1 - EPS))
    u = np.random.default_rng(seed).random()
    if len(open_) == 1:
        p[open_[0]] = float(u < p[open_[0]])
    elif len(open_) == 2:
        a, b = open_
        mean = p[a] * size[a] + p[b] * size[b]
        best = None
        for both in (max(0.0, p[a] + p[b] - 1), min(p[a], p[b])):
            odds = [both, p[a] - both, p[b] - both, 1 - p[a] - p[b] + both]
            errs = [abs(size[a] + size[b] - mean), abs(size[a] - mean), abs(size[b] - mean), mean]
            if best is None or np.dot(odds, errs) < best[0]:
                best = (np.dot(odds, errs), odds)
        k = min(int(np.searchsorted(np.cumsum(best[1]), u, "right")), 3)
        p[a], p[b] = ((1, 1), (1, 0), (0, 1), (0, 0))[k]
    return p


def _fly(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mixed", "size"], kind="stable").reset_index(drop=True)
        seed = zlib.crc32(repr(key).encode())
        p = flight(rows["p"].to_numpy(), rows["size"].to_numpy(), seed)
        if last:
            p = landing(p, rows["size"].to_numpy(dtype=float), seed + 1)
        return rows.assign(p=np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p)))

    return run


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """One row per document: id, source, size, source_size, target, times (how often the mix takes it), taken (words).

    A document's size is its number of words, none for a null text. A source whose
    documents have no words gets none. The null source comes last in order and is a
    source as others are. Rows with a null id take part; repeated rows are decided
    one by one. Draws depend on the rows alone, so reruns agree. What the driver
    gathers is one row per source. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    units = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    units = stored(units, "units")
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).collect()
    wanted = targets([(r["source"], r["source_size"]) for r in sources], weights, repeats)
    rows = []
    for r in sources:
        factor = wanted[r["source"]] / r["source_size"] if r["source_size"] else 0.0
        whole = min(math.floor(factor + EPS), repeats)
        part = factor - whole if EPS < factor - whole < 1 - EPS else 0.0
        rows.append((r["source"], r["source_size"], float(wanted[r["source"]]), whole, part, -(-r["docs"] // block)))
    known = spark.createDataFrame(rows, "of string, source_size long, target double, whole int, p double, blocks long")
    mark = F.xxhash64("doc", "size")
    units = units.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("mixed", mark)
    done = [units.filter("p = 0").drop("blocks", "mixed")]
    flying = units.filter("p > 0").withColumn("block", F.pmod(F.col("mixed"), F.col("blocks"))).drop("blocks")
    most = max((r[5] for r in rows if r[4] > 0), default=0)
    while most:
        landed = stored(flying.groupBy("source", "block").applyInPandas(_fly(most == 1), flying.schema), "flight")
        done.append(landed.filter("p in (0, 1)").drop("block", "mixed"))
        if most == 1:
            break
        most = -(-2 * most // block)
        flying = landed.filter("p not in (0, 1)").withColumn("block", F.pmod("block", F.lit(most)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    times = (F.col("whole") + F.col("p")).cast("long")
    return out.select(F.col("doc").alias(id_col), "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Nulls and repeated rows as in mixed()."""
    key, source, size, times, many, words, n = (unused(docs, x) for x in ("__key", "__source", "__size", "__times", "__many", "__words", "__n"))
    plan = mixed(docs, id_col, text_col, source_col).groupBy(F.col(id_col).alias(key), F.col("source").alias(source), F.col("size").alias(size))
    plan = stored(plan.agg(F.sum("times").alias(times), F.count("*").alias(many)), "times")
    released(docs.sparkSession)
    own = docs.withColumn(words, word_count(F.col(text_col)))
    same = own[id_col].eqNullSafe(plan[key]) & own[source_col].eqNullSafe(plan[source]) & (own[words] == plan[size])
    rows = own.join(plan, same)
    nth = F.row_number().over(Window.partitionBy(key, source, size).orderBy(F.col(text_col)))
    extra = F.when(nth <= F.col(times) % F.col(many), 1).otherwise(0)
    rows = rows.withColumn(n, F.floor(F.col(times) / F.col(many)) + extra).filter(F.col(n) > 0)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
