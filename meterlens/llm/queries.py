"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_duplicates
from .jaccard_join import similarity_components
from .line_dedup import line_duplicates
from .mixing import mixed
from .packing import packed
from .pii import personal_data
from .quality_rules import quality
from .token_output import token_round_trip
from .toxicity import toxicity
from .warc import archived_pages


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark, table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.drop(*(c for c in found.columns if c.startswith("rate_")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op7_line_dedup": r"""
        WITH lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line
                       FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM lines),
        pairs AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, below ORDER BY doc_id, i) AS nth FROM l WHERE below IS NOT NULL),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b
                 FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM pairs WHERE nth > 1)
                 GROUP BY doc_id, island),
        enough AS (SELECT r.doc_id, a, b FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN a AND b GROUP BY r.doc_id, a, b HAVING sum(w) >= 10),
        long AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM l WHERE w >= 50) WHERE nth > 1),
        gone AS (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM enough UNION SELECT doc_id, i FROM long),
        left_ AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS t, sum(l.w) AS w FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(lost.n, 0) AS n_removed,
               coalesce(left_.w, 0)::BIGINT AS n_words_left, sha256(coalesce(left_.t, '')) AS text_sha256
        FROM documents d LEFT JOIN left_ USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    "op8_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS win
                FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
        again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
        rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
        lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
        dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
        s AS (SELECT d.doc_id, d.source, len(w.ws) AS n_words,
                     length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                     length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                     coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words
              FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
        h AS (SELECT source, rule, count(*)::DOUBLE AS n, count_if(fails)::DOUBLE / count(*) AS p
              FROM (SELECT source, unnest([1, 2, 3, 4]) AS rule,
                           unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 20 * n_dup_lines > n_words, 10 * n_symbols > word_chars]) AS fails FROM f)
              GROUP BY source, rule),
        m AS (SELECT rule, sum(least(n, 100) * p) / sum(least(n, 100)) AS mu, sum(least(n, 100) * p * p) / sum(least(n, 100)) AS sq,
                     sum(least(n, 100) / n) / sum(least(n, 100)) AS inv FROM h GROUP BY rule),
        p AS (SELECT rule, mu, CASE WHEN sq - mu * mu - inv * mu * (1 - mu) > 1e-12
                                    THEN least(greatest(mu * (1 - mu) / (sq - mu * mu - inv * mu * (1 - mu)) - 1, 1.0), 1e4) ELSE 1e4 END AS strength FROM m),
        q AS (SELECT source, mu, (h.n * h.p + mu * strength) / (h.n + strength) AS rate, h.n + strength + 1 AS weight FROM h JOIN p USING (rule)),
        v AS (SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / weight) > greatest(3 * mu, 0.25)) AS rejected FROM q GROUP BY source)
        SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
               NOT f.base_failed AND NOT v.rejected AS kept, v.rejected AS host_rejected
        FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
    "op6_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM r""",
}
