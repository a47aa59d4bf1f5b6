"""Each stage against brute force on its own input, and the whole run."""

import collections

import corpus_pipeline as p
from test_brute import brute_components

from meterlens.llm import quality_rules


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before.collect(), docs.collect())
    before, after = kept["quality_rules"]
    bad = {r["doc_id"] for r in before if (s := quality_rules.text_stats(r["text"]))[0] < 20 or 100 * s[4] > 30 * s[0]}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
    before, after = kept["line_dedup"]
    old = {r["doc_id"]: r["text"].split("\n") for r in before}
    for r in after:
        left = collections.Counter(r["text"].split("\n"))
        assert not left - collections.Counter(old[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    before, after = kept["near_duplicates"]
    groups = brute_components({r["doc_id"]: r["text"] for r in before})
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, top) in groups.items() if i == top)
    before, after = kept["mixing"]
    times = collections.Counter(r["doc_id"] for r in after)
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in before}
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    starts = collections.Counter(r["doc_id"] for r in after if r["start"] == 0)
    assert starts == times


def test_run(spark, sf):
    assert p.run(spark, sf).count() > 0 and p.ORACLE_SQL is None
