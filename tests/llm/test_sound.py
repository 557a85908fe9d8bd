"""Hashes that must not collide by structure, memory bounds, and plain versions of what SQL can't say."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from types import SimpleNamespace
from zlib import crc32

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import dom, html_extract, jaccard, phrase_index, repetition, scratch, token_counts, toxicity


def thue_morse(n):
    """A word of two letters and its complement, which polynomials modulo 2**64 can't tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 200, 1024, 4096])
def test_words_of_two_letters(spark, n):
    x, y = thue_morse(n)
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x}\n{y}"), (4, f"{x}\n{x}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_dup_lines for r in repetition.quality_report(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    item = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in phrase_index.find_contamination(docs, item).collect()} == {1: 1, 2: 0, 3: 1, 4: 2}


def test_index_is_reused_over_blocks(spark, monkeypatch):
    """Each item in a block of its own gives what one block gives; the index is built once."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(60))) for k in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(f"w{(k * 11 + j) % 40}" for j in range(14))) for k in range(9)], "item_id long, text string")
    want = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in phrase_index.find_contamination(docs, items).collect()}
    built = []
    build = phrase_index.build_index
    monkeypatch.setattr(phrase_index, "build_index", lambda *a: built.append(1) or build(*a))
    monkeypatch.setattr(phrase_index, "BENCH_BYTES", 30)
    assert {(r.doc_id, r.n_hit, tuple(r["items"])) for r in phrase_index.find_contamination(docs, items).collect()} == want
    assert len(built) == 1


def test_pieces_have_a_bound():
    counted = []
    count = lambda texts: counted.append(len(texts)) or [len(t) for t in texts]
    version = "bound"
    run = token_counts.by_pieces(count, version)
    long_words = ["x" * (100 + k) for k in range(500)]
    texts = [" ".join(["a b", *long_words]), "a b " + "漢字" * 5000]
    assert run(texts) == [len(t) for t in texts]
    assert run(texts) == [len(t) for t in texts]
    assert all(len(p) <= token_counts.PIECE_CHARS for p in token_counts._PIECES[version])


def test_second_call_reads_the_cache(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some text {k % 3}") for k in range(9)], "doc_id long, text string")
    path, tokenizer = f"file://{tmp_path}/cache", public_tokenizers.path("byte_bpe_50k.json")
    first = sorted(map(tuple, token_counts.token_counts(docs, tokenizer, path).collect()))
    assert spark.read.parquet(path).count() == 3
    more = docs.unionByName(spark.createDataFrame([(9, "another")], docs.schema))
    again = sorted(map(tuple, token_counts.token_counts(more, tokenizer, path).collect()))
    assert again[:9] == first and spark.read.parquet(path).count() == 4


def test_embedded_text_stays(spark):
    """Formulas, fallback content and the like belong to their paragraph; scripts and drawings don't."""
    said = "The height <math><mi>x</mi>+<mn>1</mn></math> grows, as the long record of many years shows to all who read it."
    page = f"<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article class=article><h1>On growth</h1><p>{said}</p><object><p>{said}</p></object><p>{said}<script>var x</script><svg><text>axis</text></svg></p></article></body></html>"
    row = html_extract.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row.text.count("height x+1 grows") == 3 and "var x" not in row.text and "axis" not in row.text
    assert "math" not in dom.RAW and "object" not in dom.RAW


def test_no_local_folder_on_a_cluster(spark):
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(ValueError):
        scratch.folder(cluster)


def plain_ratios(docs, labels):
    """The toxicity models in plain Python: ratio per word of each text."""
    text_of = {d: t for d, t in docs}
    fold = {d: crc32(str(d).encode()) % 5 for d in text_of}
    toxic = defaultdict(int)
    for d, y in labels:
        toxic[d] = max(toxic[d], y)
    texts = {}
    for d in toxic:
        if d in text_of and fold[d]:
            digest = hashlib.sha256(text_of[d].encode()).hexdigest()
            f, y, _ = texts.get(digest, (9, 0, ""))
            texts[digest] = (min(f, fold[d]), max(y, toxic[d]), text_of[d])
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for f, y, t in texts.values():
        if f < toxicity.CALIBRATE:
            w = words_of(t)
            words[y].update(set(w))
            pairs[y].update(set(zip(w, w[1:], strict=False)))
    left = lambda c, s, t: max(c - max(toxicity.DISCOUNT, (2 - s) * s * t + toxicity.DOUBT * math.sqrt(s * t + 1)), 0.0)
    every, all_pairs = {*words[0], *words[1]}, {*pairs[0], *pairs[1]}
    total = [max(sum(c.values()), 1) for c in words]
    types = Counter(b for _, b in all_pairs)
    after = [Counter(b for _, b in c) for c in pairs]
    own = {w: [min(left(words[y][w], total[y] / sum(total), words[0][w] + words[1][w]), left(after[y][w], total[y] / sum(total), after[0][w] + after[1][w])) / total[y] for y in (0, 1)] for w in every}
    rest = 1 - max(sum(o[y] for o in own.values()) for y in (0, 1))
    p = {w: [o[y] + rest * (types[w] + 1) / (len(all_pairs) + len(every) + 1) for y in (0, 1)] for w, o in own.items()}
    seen = [Counter(), Counter()]
    for y in (0, 1):
        for (a, _), n in pairs[y].items():
            seen[y][a] += n
    mass = {}
    for a, b in all_pairs:
        c = [pairs[y][a, b] for y in (0, 1)]
        if sum(c) >= toxicity.LEAST_PAIRS and max(c) > toxicity.DOUBT:
            at = [max(seen[y][a], 0.5) for y in (0, 1)]
            m = [left(c[y], at[y] / sum(at), sum(c)) / max(seen[y][a], 1) for y in (0, 1)]
            if sum(m) > 0:
                mass[a, b] = m
    weight = {a: max(1 - max(sum(m[y] for (x, _), m in mass.items() if x == a) for y in (0, 1)), 1e-6) for a, _ in mass}
    delta = {w: math.log(p[w][1]) - math.log(p[w][0]) for w, o in own.items() if sum(o) > 0}
    plus = {(a, b): math.log(m[1] + weight[a] * p[b][1]) - math.log(m[0] + weight[a] * p[b][0]) - math.log(p[b][1]) + math.log(p[b][0]) for (a, b), m in mass.items()}
    out = {}
    for d, t in docs:
        w = words_of(t)
        out[d] = sum(delta.get(x, 0.0) for x in w) / max(len(w), 1) + sum(plus.get(x, 0.0) for x in zip(w, w[1:], strict=False)) / max(len(w), 1)
    return out, len(delta), len(plus)


def test_toxicity_same_as_plain(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # A text in several folds, and one that only the calibration rows hold twice.
    again = docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = docs.unionByName(again).select("doc_id", "text")
    labels = labels.select("doc_id", "toxic").unionByName(again.join(labels.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "toxic"), "doc_id").select("doc_id", "toxic"))
    want, n_words, n_pairs = plain_ratios([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert n_words + n_pairs > 0
    model = toxicity.train_model(docs, labels)
    assert model.evidence.count() == n_words + n_pairs
    for r in toxicity.score(docs, model).collect():
        assert abs(r.ratio_per_word - want[r.doc_id]) < 1e-6


def test_pipeline_on_odd_rows(spark, odd, none):
    """Each stage on nulls, empty and long texts, repeated rows, clashing columns, and on no rows."""
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        got, empty = stage(spark, odd, sf), stage(spark, none, sf)
        assert empty.count() == 0
        if name != "shard":
            assert got.columns == odd.columns and got.count() <= odd.count() * 3
        else:
            assert got.count() == odd.count()
