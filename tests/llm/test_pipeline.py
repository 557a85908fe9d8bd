"""Each stage of the pipeline against what it should keep."""

import re

import corpus_pipeline as c
from test_brute_force import SF, brute_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    stages = dict(c.STAGES)
    now = docs
    for name, stage in c.STAGES:
        now = stage(spark, now, SF)
        if name != "shard":
            assert now.columns == columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        seen[name] = now.collect()
    report = {r.doc_id: r.kept for r in __import__("quillgrid.llm.repetition", fromlist=["x"]).quality_report(docs).collect()}
    assert sorted(r.doc_id for r in seen["quality"]) == sorted(k for k, kept in report.items() if kept)

    before = sorted(seen["quality"], key=lambda r: r.doc_id)
    groups, _ = brute_components([r.text.translate(LOWER) for r in before])
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted({before[g].doc_id for g in groups})

    bench = set().union(*(windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    clean = [r.doc_id for r in seen["near_duplicates"] if not windows(r.text) & bench]
    assert sorted(r.doc_id for r in seen["decontaminate"]) == sorted(clean)

    counts = {}
    for r in seen["mix"]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts) <= set(clean) and max(counts.values()) <= 3
    assert len(seen["shard"]) == len(seen["mix"]) and set(stages) == set(seen)
