"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names: for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from meterlens.llm import exact_dedup, jaccard_join, line_dedup, mixing, packing, pii, quality_rules, token_output, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[i * 7 % 24] + str(i) for i in range(9000))
CLASH = "doc, mark, row, class, size, start, end, names, pos, block, address, digest, level, label, component, stats, host, spans, times, weight, __id, __removed, __clean, __spans, __of, __mark, __host, __stats, piece, many, n_spans".split(", ")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def rows():
    plain = [
        (1, "one two three four five six"), (2, "one  two\tthree four five\nsix"), (2, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "   \n\t "), (None, "one two three four five six"), (None, None),
        (6, LONG), (7, LONG), (8, LONG + " tail"), (9, "short"), (10, "short"), (11, "été naïve 日本   x"),
    ]
    return [(i, t, "en", None if i == 9 else "a" if i is None or i % 2 else "b", None, *["x"] * len(CLASH)) for i, t in plain]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits", [64, 1])
def test_exact(docs, none, bits):
    got = exact_dedup.exact_duplicates(docs, block_bytes=1000, address_bits=bits).collect()
    data = [(r[0], norm(r[1])) for r in rows()]
    assert len(got) == len(data)
    for r in got:
        own = [i for i, t in data if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(own)
        assert r["keep_id"] == min((i for i in own if i is not None), default=None)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(v) == 1 for v in by.values())
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_jaccard(docs, none):
    got = jaccard_join.similarity_components(docs).collect()
    assert len(got) == len(rows())
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[2, 2] == 1 and by[None, 2] == 1 and by[7, 8996] == 6 and by[8, 8997] == 6 and by[10, 1] == 9 and by[4, 0] == 4 and by[5, 0] == 5
    assert by[None, 0] is None
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 9, 11, None}
    assert jaccard_join.similarity_components(none).count() == 0


def test_lines(spark, docs, none):
    got = line_dedup.line_duplicates(docs).collect()
    assert len(got) == len(rows()) and sum(r["n_removed"] for r in got if r["doc_id"] in (1, 2, 3, 4)) == 0
    assert {r["doc_id"]: r["n_removed"] for r in got}[7] == 1  # one very long line, seen in 6
    assert line_dedup.clean_documents(docs).columns == docs.columns
    assert line_dedup.line_duplicates(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r["times"] <= 3 and r["taken"] == r["times"] * r["size"] for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(docs).collect()), key=repr)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in got)
    assert mixing.mixed(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_quality(docs, none):
    got = quality_rules.quality(docs).collect()
    assert len(got) == len(rows()) and all(r["base_failed"] for r in got if r["n_words"] < 20)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert quality_rules.quality(none).count() == 0 and quality_rules.kept_documents(none).count() == 0


def test_packing(docs, none):
    got = packing.packed(docs).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert packing.packed(none).count() == 0


def test_tokens(spark, docs, none):
    got = token_output.token_round_trip(docs).orderBy("start").collect()
    assert len(got) == len(rows()) and [r["doc_id"] for r in got] == sorted((r[0] for r in rows()), key=lambda x: (x is not None, x))
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert token_output.token_round_trip(none).count() == 0


def test_pii(docs, none):
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows()) and all(r["spans"] == "" for r in got if r["doc_id"] not in (6, 7, 8))
    assert pii.personal_data(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    unlabelled = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(0 <= r["score"] <= 1 for r in unlabelled)


def test_warc(spark):
    data = [(3, "u", "x" * 200), (1, None, "x" * 200), (1, "v", "x" * 200), (2, "w", "y"), (4, "w", "y"), (None, "n", "x" * 200), (5, "z", None), (6, "é", "é" * 60), (7, "é", "é" * 60)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("hex", F.lit(1)).withColumn("first", F.lit(2))
    got = sorted(map(tuple, warc.archived_pages(spark, pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    want = [(3, 200, "revisit", 1), (1, 200, "response", None), (1, 200, "response", None), (2, 1, "response", None), (4, 1, "response", None), (None, 200, "response", None), (5, 0, "response", None), (6, 120, "response", None), (7, 120, "revisit", 6)]
    assert got == sorted(want, key=repr)
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0
