"""Quality rules per document, and per host with an empirical beta prior for each rule.

A document fails the base rule if it is too short or repeats itself. Failures of every
rule (those two, repeated lines, symbols) are counted by host; for tables without an
address the ``source`` column is the host. For each rule a beta prior is fitted to the
hosts' rates by moments, in which a host counts as PRIOR_CAP documents at most, so that
no large host sets the standard it is measured by. The prior shrinks each host's rate:
a few failures at a small host do not condemn it. A host is rejected if, for some rule,
the low end of its rate (posterior mean less two standard deviations) is above FACTOR
times the prior's mean and above LEAST_RATE; its documents then go, the others stay as
the base rule says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, stored, unused

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
#: For hosts: a repeated line for every so many words, and a symbol for every so many characters of words.
LINE_WORDS, SYMBOL_SHARE = 20, 10
#: When a host is rejected: so many times the prior's mean, and this rate, at the low end.
FACTOR, LEAST_RATE, DEVIATIONS = 3.0, 0.25, 2.0
#: So many documents of a host count for the prior at most, and bounds of the prior's weight in documents.
PRIOR_CAP, STRENGTH = 100, (1.0, 1e4)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. window: a power of two.

    Windows get exact integer names by doubling: a pair of names of half the length
    is one name of the whole.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    step = 1
    while step < window:
        pair = names[:-step] * (len(words) + 1) + names[step:]
        found, names = np.unique(pair, return_inverse=True)
        step *= 2
        if len(found) == len(pair):
            return 0
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def _stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    kept()
    for batch in texts:
        yield pd.DataFrame([text_stats(t) for t in batch], columns=COUNTS, dtype="int64")


def document_stats(text: str | Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    kind = ", ".join(f"{x} long" for x in COUNTS)
    return F.pandas_udf(_stats, kind)(F.col(text) if isinstance(text, str) else text)


def rules(stats: str = "stats") -> dict[str, Column]:
    """Each rule's name and whether a document fails it."""
    n, chars, symbols, lines, again = (F.col(f"{stats}.{x}") for x in COUNTS)
    return {"short": n < MIN_WORDS, "repeats": 100 * again > MAX_REPEAT_PCT * n, "lines": LINE_WORDS * lines > n, "symbols": SYMBOL_SHARE * symbols > chars}


def base_failed(stats: str = "stats") -> Column:
    own = rules(stats)
    return own["short"] | own["repeats"]


def host_verdicts(counts: DataFrame, factor: float = FACTOR, least_rate: float = LEAST_RATE) -> DataFrame:
    """host, n, and for each rule the number of failures -> host, n, rate_<rule> (shrunk), rejected. The null host is a host.

    One row of sums goes to the driver. Without hosts the result is empty.
    """
    n, names = F.col("n").cast("double"), [c for c in counts.columns if c not in ("host", "n")]
    weight = F.least(n, F.lit(float(PRIOR_CAP)))
    sums = [F.sum(weight), F.sum(weight / n)]
    for x in names:
        p = F.col(x) / n
        sums += [F.sum(weight * p), F.sum(weight * p * p)]
    total, parts, *found = counts.agg(*sums).first()
    rates, bad = [], F.lit(False)
    for i, x in enumerate(names):
        mean, squares = (v / total for v in found[2 * i : 2 * i + 2]) if total else (0.0, 0.0)
        spread = squares - mean * mean - mean * (1 - mean) * parts / total if total else 0.0
        strength = min(max(mean * (1 - mean) / spread - 1, STRENGTH[0]), STRENGTH[1]) if spread > 1e-12 else STRENGTH[1]
        rate = (F.col(x) + mean * strength) / (n + strength)
        low = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (n + strength + 1))
        rates.append(rate.alias(f"rate_{x}"))
        bad = bad | (low > max(factor * mean, least_rate))
    return counts.select("host", "n", *rates, bad.alias("rejected"))


def _by_host(marked: DataFrame) -> DataFrame:
    """marked: host and a flag for each rule."""
    return stored(marked.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(x).alias(x) for x in marked.columns if x != "host")), "hosts")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, the five counts, base_failed, kept, host_rejected, and its host's rate_<rule>.

    Null and empty texts have no words and so fail; repeated rows count as often as
    they occur; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    seen = docs.select(F.col(id_col).alias("doc"), F.col(host_col).alias("host"), document_stats(text_col).alias("stats"))
    seen = stored(seen, "quality")
    verdicts = host_verdicts(_by_host(seen.select("host", *(c.alias(x) for x, c in rules().items())))).drop("n").withColumnRenamed("host", "of")
    out = seen.join(verdicts, F.col("host").eqNullSafe(F.col("of")))
    kept_ = ~base_failed() & ~F.col("rejected")
    return out.select(F.col("doc").alias(id_col), "stats.*", base_failed().alias("base_failed"), kept_.alias("kept"), F.col("rejected").alias("host_rejected"), *(c for c in verdicts.columns if c.startswith("rate_")))


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, that the base rule and their host's verdict keep.

    Reads docs twice instead of shuffling texts: once for the hosts' counts, once for
    the rows. Nulls, empties, repeated rows and empty tables as in quality().
    """
    bounded_batches(docs.sparkSession)
    stats = docs.select(F.col(host_col).alias("host"), document_stats(text_col).alias("stats"))
    verdicts = host_verdicts(_by_host(stats.select("host", *(c.alias(x) for x, c in rules().items()))))
    host, stats = unused(docs, "__host"), unused(docs, "__stats")
    bad = verdicts.filter("rejected").select(F.col("host").alias(host))
    passed = docs.withColumn(stats, document_stats(text_col)).filter(~base_failed(stats)).drop(stats)
    return passed.join(bad, passed[host_col].eqNullSafe(bad[host]), "left_anti")
