"""Toxicity by weak supervision.

Many voters (fixed word lists, patterns, and lists of words and stems mined from labelled
rows) say toxic or nothing of a document. A mined list votes on rows it was not mined
from: labelled rows are dealt to two halves, and each half's lists vote on the other. A
generative label model with a hidden class estimates by expectation maximisation how
often each voter votes on toxic and on clean documents, and how voters correlate beyond
the class: each voter also depends on one other, along the tree of the most conditional
mutual information. Given labels are one more voter while the model is estimated; its
posterior from the other votes alone is what a linear classifier on words and stems
learns. The classifier's probability is the score.

Learning looks at SAMPLE labelled rows at most (those with the smallest hash of their
id), never at held-out ones, whose crc32 of the id as text leaves 1 when divided by 3.
Scores come from the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, values

# English word lists of the voters.
INSULTS = "idiot moron stupid dumb imbecile fool loser clown pathetic worthless useless ugly coward liar jerk".split()
CONTEMPT = "scum trash garbage filth filthy vermin disgusting disgrace vile rat pig parasite degenerate subhuman".split()
VULGAR = "damn crap shit bullshit bastard bitch ass asshole fuck fucking fucker piss dick whore slut".split()
THREATS = "kill die hang burn shoot beat destroy hurt choke stab".split()
LISTS = (INSULTS, CONTEMPT, VULGAR)

#: Most labelled rows that are learned from, and most words and stems with a weight of their own.
SAMPLE, TOXIC_FEATURES, CLEAN_FEATURES = 12_000, 4000, 1000
STEMS = (4, 5, 6)
#: Mined lists: for each kind (words, stems of each length) and tier GROUPS of them. A tier holds what is toxic in more than
#: that share of its rows, at the low end of so many deviations (Wilson).
GROUPS, TIERS = 3, ((0.7, 2.5), (0.4, 1.6))
#: Mutual information (nats) from which a voter depends on another.
LEAST_SHARED = 0.002
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
INSULTED = re.compile(r"\byou(?:'re| are|r)?(?: \w+){0,3} (?:" + "|".join(INSULTS + CONTEMPT) + r")\b")
THREATENED = re.compile(r"\b(?:will|should|must|gonna|to) (?:" + "|".join(THREATS) + r") (?:you|them|him|her|all)\b")


def features_of(word: str) -> list[str]:
    """The word and its stems; the number before a stem is its length."""
    return [word] + [f"{n}{word[:n]}" for n in STEMS if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def fixed_votes(text: str | None, words: set[str]) -> list[int]:
    """1: toxic, 0: nothing. The word lists, then patterns: insults and threats to someone, several listed words, shouting."""
    low, text = (text or "").lower(), text or ""
    hits = [len(words.intersection(x)) for x in LISTS]
    upper, letters = (sum(map(str.isupper, text)), sum(map(str.isalpha, text))) if "!!" in text else (0, 0)
    return [int(h > 0) for h in hits] + [int(bool(INSULTED.search(low))), int(bool(THREATENED.search(low))), int(sum(hits) >= 3), int(letters >= 20 and upper > 0.6 * letters and sum(hits) > 0)]


class LabelModel:
    """A hidden class, and voters that depend on it and on one other voter each.

    right: P(the given label is toxic | clean, toxic). accuracy: P(a voter votes | clean, toxic). parent: the voter that each depends on (-1: none).
    table[c, v, j]: P(j votes | class c, its parent's vote v). shared: conditional mutual information with the parent.
    """

    def fit(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 12) -> np.ndarray:
        """votes: rows x voters in 0, 1; labels: 0 or 1. Returns the posterior from the votes alone.

        While the model is estimated the labels are one more voter, whose accuracy is
        estimated too; without it the class could come to mean something else that
        voters have in common (a language, say).
        """
        v, y = votes.astype(float), labels.astype(float)
        q = np.where(labels > 0, 0.9, 0.1)
        for _ in range(rounds):
            weights = (1 - q, q)
            self.prior = float(np.clip(q.mean(), 0.005, 0.9))
            self.accuracy = np.stack([(w @ v + 0.5) / (w.sum() + 1.0) for w in weights])
            both = np.stack([(v * w[:, None]).T @ v for w in weights])  # how often two voters vote together, by class
            self._tree(both, [w.sum() for w in weights])
            self.table = np.empty((2, 2, v.shape[1]))
            for c, w in enumerate(weights):
                n, one = w.sum(), w @ v
                for j, k in enumerate(self.parent):
                    if k < 0:
                        self.table[c, :, j] = self.accuracy[c, j]
                    else:  # smoothed towards what holds without the parent
                        self.table[c, 1, j] = (both[c, j, k] + self.accuracy[c, j]) / (one[k] + 1)
                        self.table[c, 0, j] = (one[j] - both[c, j, k] + self.accuracy[c, j]) / (n - one[k] + 1)
            self.right = [float(np.clip((w @ y + 0.5) / (w.sum() + 1), 0.002, 0.998)) for w in weights]
            a, b = self.right
            q = self.posterior(votes, np.where(labels > 0, np.log(b / a), np.log((1 - b) / (1 - a))))
        return self.posterior(votes)

    def _tree(self, both: np.ndarray, sizes: list[float]) -> None:
        """The spanning tree of the most mutual information within the classes, grown from voter 0."""
        shared, total = 0.0, sum(sizes)
        for joint, n in zip(both, sizes):
            one = np.diag(joint)
            cells = {(1, 1): joint, (1, 0): one[:, None] - joint, (0, 1): one[None, :] - joint, (0, 0): n - one[:, None] - one[None, :] + joint}
            margin = (n - one, one)
            for (a, b), x in cells.items():
                x = np.maximum(x, 0) + 1e-9
                shared = shared + x / total * np.log(x * (n + 1e-9) / np.maximum(np.outer(margin[a], margin[b]), 1e-9))
        m = len(shared)
        self.parent, self.shared = np.full(m, -1), np.zeros(m)
        best, link, free = shared[0].copy(), np.zeros(m, int), set(range(1, m))
        while free:
            j = max(sorted(free), key=lambda i: best[i])
            free.remove(j)
            self.parent[j], self.shared[j] = link[j] if best[j] > LEAST_SHARED else -1, best[j]
            closer = shared[j] > best
            best, link = np.where(closer, shared[j], best), np.where(closer, j, link)

    def posterior(self, votes: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """more: log-odds of other evidence."""
        given = np.where(self.parent < 0, 0, votes[:, np.maximum(self.parent, 0)])
        at = np.arange(votes.shape[1])
        p = [np.clip(t[given, at], 1e-4, 1 - 1e-4) for t in self.table]
        odds = np.where(votes > 0, np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0])))
        z = np.log(self.prior / (1 - self.prior)) + odds.sum(1) + more
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(rows: list[np.ndarray], y: np.ndarray, width: int, l2: float = 0.05, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of columns and soft labels, by accelerated gradient descent on the mean loss."""
    size = np.array([len(r) for r in rows])
    at, cols = np.repeat(np.arange(len(rows)), size), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    weight = np.where(y >= 0.5, 2.0, 1.0)  # a missed toxic document costs twice as much
    w, b = np.zeros(width), 0.0
    vw, vb = w.copy(), b
    rate = 4.0 / (1.0 + np.quantile(size, 0.99))
    for t in range(rounds):
        z = np.bincount(at, vw[cols], len(rows)) + vb
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(cols, err[at], width) / len(rows) + l2 * vw / len(rows)
        nw, nb = vw - rate * gw * 10, vb - rate * err.mean() * 10
        k = t / (t + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, votes = [], []
        for text in values(batch.column(0)):
            words = words_of(text)
            feats.append(sorted({f for w in words for f in features_of(w)}))
            votes.append(fixed_votes(text, words))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(feats, pa.list_(pa.string())), pa.array(votes, pa.list_(pa.int32())), batch.column(2)], names=["y", "feats", "votes", "half"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Weights of words and stems, and the bias. Without labelled rows of both classes: the fixed lists alone."""
    spark = docs.sparkSession
    seen = labels.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    seen = seen.groupBy(F.col(id_col).alias("of")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    ids = spark.createDataFrame(seen.orderBy(F.xxhash64("of"), "of").limit(sample).toPandas(), seen.schema)  # `sample` rows at most
    half = F.pmod(F.xxhash64("of", F.lit("half")), F.lit(2)).cast("int").alias("half")
    rows = docs.join(F.broadcast(ids), docs[id_col] == ids["of"]).select(F.col(text_col).alias("text"), "y", half)
    rows = stored(rows.mapInArrow(_sampled, "y int, feats array<string>, votes array<int>, half int"), "labelled")
    count = lambda what, k: F.sum(F.when(F.col("half") == k, what).otherwise(0)).alias
    counts = rows.select("y", "half", F.explode("feats").alias("f")).groupBy("f")
    counts = counts.agg(F.sum("y").alias("pos"), F.count("*").alias("n"), *(count(F.col("y"), k)(f"pos{k}") for k in (0, 1)), *(count(F.lit(1), k)(f"n{k}") for k in (0, 1))).filter("n >= 4")
    n, pos = (x or 0 for x in rows.agg(F.count("*"), F.sum("y")).first())
    if not 0 < pos < n:
        fixed = {w: 4.0 for x in LISTS for w in x}
        return fixed, -3.0
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (n - pos + 1))
    ranked = counts.withColumn("odds", odds).withColumn("z", F.col("odds") * F.sqrt("n"))
    chosen = pd.concat([ranked.orderBy(F.desc("z"), "f").limit(TOXIC_FEATURES).toPandas(), ranked.orderBy("z", "f").limit(CLEAN_FEATURES).toPandas()]).drop_duplicates("f").reset_index(drop=True)
    column = {f: i for i, f in enumerate(chosen["f"])}
    found = rows.select("y", "votes", "feats", "half").mapInArrow(_columns(column), "y int, votes array<int>, cols array<int>, half int").toPandas()
    sets = [np.asarray(x, np.int64) for x in found["cols"]]
    lists = [_mined(chosen, k) for k in (0, 1)]
    learned = np.zeros((len(sets), (1 + len(STEMS)) * len(TIERS) * GROUPS + 1), int)  # the last: features in no list
    for i, (own, part) in enumerate(zip(sets, found["half"])):
        learned[i, lists[1 - part][own]] = 1
    learned = learned[:, :-1]
    votes = np.hstack([np.array(found["votes"].tolist()).reshape(len(sets), -1), learned])
    y = LabelModel().fit(votes, found["y"].to_numpy())
    w, b = _train(sets, y, len(column))
    return {f: float(w[i]) for f, i in column.items() if abs(w[i]) > 1e-4}, float(b)


def _mined(chosen: pd.DataFrame, half: int) -> np.ndarray:
    """Of each feature the number of the half's list that holds it; -1: none."""
    n = np.maximum(chosen[f"n{half}"].to_numpy(float), 1e-9)
    p, at = chosen[f"pos{half}"].to_numpy(float) / n, np.full(len(n), -1)
    for tier, (share, d) in reversed(list(enumerate(TIERS))):
        low = (p + d * d / (2 * n) - d * np.sqrt(p * (1 - p) / n + d * d / (4 * n * n))) / (1 + d * d / n)
        at = np.where(low > share, tier, at)
    kinds = np.array([1 + STEMS.index(int(f[0])) if f[:1].isdigit() else 0 for f in chosen["f"]])
    groups = np.array([zlib.crc32(f.encode()) % GROUPS for f in chosen["f"]])
    return np.where(at < 0, -1, (kinds * len(TIERS) + at) * GROUPS + groups)


def _columns(column: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[column[f] for f in x if f in column] for x in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols, pa.list_(pa.int32())), batch.column(3)], names=["y", "votes", "cols", "half"])

    return run


class _Known(dict):
    """Word -> its features that have a weight."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found


def _score(weights: dict[str, float], bias: float):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(weights)
        for batch in texts:
            out = []
            for text in batch:
                hits = {f for found in map(known.__getitem__, words_of(text)) if found for f in found}
                out.append(1 / (1 + np.exp(-min(max(bias + sum(sorted(weights[f] for f in hits)), -30.0), 30.0))))
            yield pd.Series(out, dtype="float64")

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Null and empty texts get the score of a text without words. A null id is never
    held out nor learned from; a null label is none, and of several labels of one id
    toxic counts. Repeated rows get equal scores. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    weights, bias = learn(docs, labels, id_col, text_col, label_col, sample)
    score = F.pandas_udf(_score(weights, bias), "double")(F.col(text_col))
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
