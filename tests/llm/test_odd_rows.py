"""Each operator on nulls, empty and very long texts, ties and repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest
from conftest import TEXTS, rows

from quillgrid.llm import chat, html_extract, jaccard, mixing, phrase_index, repetition, sharding, token_counts, toxicity

N = len(rows())


def bench(spark):
    return spark.createDataFrame([(1, "same text here for all five words"), (1, "same text here for all five words"), (2, None), (3, ""), (None, "one"), (4, " ".join(f"word{k % 9973}x{k}" for k in range(100, 130)))], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(13)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")


def test_repetition(odd, none):
    got = repetition.quality_report(odd).collect()
    assert len(got) == N
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_words == by[2].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[8].n_words == 5 and by[6].n_dup_lines == 2
    assert by[5].n_repeat_words == 48 and by[5].base_failed
    assert by[12].n_words == 250_000 and by[12].kept
    assert repetition.quality_report(none).count() == 0
    kept = repetition.keep_good(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [12]
    assert repetition.keep_good(none).count() == 0


def test_mixing(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == N and mixing.mix(none).count() == 0
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert sum(r.taken for r in got) > 0
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(odd.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    taken = mixing.take(odd)
    assert taken.columns == odd.columns
    words = sum(len((r.text or "").split()) for r in taken.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.take(none).count() == 0


def test_phrase_index(spark, odd, none):
    got = phrase_index.find_contamination(odd, bench(spark)).collect()
    assert len(got) == N
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[9]["items"] == by[10]["items"] == by[11]["items"] == ["1"] and by[9].n_hit == 7
    assert by[3].n_hit == 1 and by[3]["items"] == []  # hit by an item without an id
    assert by[12]["items"] == ["4"] and by[12].n_hit == 30 and [tuple(x) for x in by[12].spans] == [(100, 130)]
    assert by[0].n_words == by[1].n_words == 0
    assert phrase_index.find_contamination(none, bench(spark)).count() == 0
    assert {r.n_hit for r in phrase_index.find_contamination(odd, bench(spark).where("false")).collect()} == {0}
    clean = phrase_index.remove(odd, bench(spark))
    assert clean.columns == odd.columns and not {3, 9, 10, 11, 12} & {r.doc_id for r in clean.collect()}


def test_phrase_index_blocks_and_slop(spark, odd, monkeypatch):
    whole = {(r.doc_id, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in phrase_index.find_contamination(odd, bench(spark)).collect()}
    monkeypatch.setattr(phrase_index, "BENCH_BYTES", 40)
    cut = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in phrase_index.find_contamination(odd, bench(spark)).collect()}
    assert cut == {x[:3] for x in whole}
    near = spark.createDataFrame([(1, "same text really here for all five words")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "same text here for all five words")], "item_id long, text string")
    assert phrase_index.find_contamination(near, item).first().n_hit == 0
    assert phrase_index.find_contamination(near, item, slop=1).first().n_hit > 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(odd, none, name):
    path = public_tokenizers.path(name)
    small = odd.where("doc_id is null or doc_id < 12")
    got = token_counts.token_counts(small, path).collect()
    assert len(got) == N - 1
    library, body, version = token_counts.read_tokenizer(path)
    if library == "tokenizers":
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        want = {k: len(plain.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(TEXTS[:12])}
    else:
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=path)
        want = {k: len(plain.encode(t or "")) for k, t in enumerate(TEXTS[:12])}
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id is not None} == want
    assert token_counts.token_counts(none, path).count() == 0


def test_token_cache(spark, odd, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    part = odd.where("doc_id < 6")
    first = token_counts.token_counts(part, path, cache).collect()
    held = spark.read.parquet(cache).count()
    assert held == 5  # null and "" are one text
    assert sorted(token_counts.token_counts(part, path, cache).collect()) == sorted(first)
    assert spark.read.parquet(cache).count() == held
    token_counts.token_counts(odd.where("doc_id < 8"), path, cache).collect()
    assert spark.read.parquet(cache).count() == held + 2


def test_jaccard(odd, none):
    got = jaccard.join(odd).collect()
    assert len(got) == N
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[k].n_shingles for k in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert {by[k].component_id for k in (9, 10, 11)} == {9}
    assert by[0].component_id == 0 and by[1].component_id == 1 and by[12].component_id == 12
    assert [r.component_id for r in got if r.doc_id is None and r.n_shingles] == [9]
    assert [r.component_id for r in got if r.doc_id is None and not r.n_shingles] == [None]
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and not {10, 11} & set(ids) and {0, 1, 2, 3, 12} <= set(ids)
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_toxicity(spark, odd, none):
    model = toxicity.train_model(odd, labels(spark))
    got = toxicity.score(odd, model).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train_model(none, labels(spark).where("false"))
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.0}


def test_sharding(odd, none):
    got = sharding.assign(odd, 4).collect()
    assert len(got) == N and sharding.assign(none, 4).count() == 0
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id in (9, 10)}) == 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (0, 1)} == {(1, 0)}
    assert all(r.grown_shard is None and r.law == "bytes" for r in got)
    placed = sharding.with_shard(odd, 4)
    assert {(r.doc_id, r.shard) for r in placed.collect()} == {(r.doc_id, r.shard) for r in got}


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "plain words only, without any markup"), (5, "u", "<article><p>a&amp;b &#233;\n c<p>second one</article><script>no</p></script>"), (5, "u", "<article><p>a&amp;b &#233;\n c<p>second one</article><script>no</p></script>")], "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = html_extract.extract(pages).collect()
    assert len(got) == 6 and [r.text for r in got[:3]] == ["", "", ""] and [r.n_chars for r in got[:2]] == [0, 0]
    assert got[4].text == got[5].text == "a&b é c\n\nsecond one"
    assert html_extract.extract(pages.where("false")).count() == 0
    deep = spark.createDataFrame([(1, "u", "<div>" * 3000 + "<p>deep</p>")], "page_id long, url string, html string")
    assert html_extract.extract(deep).count() == 1


def test_chat(spark):
    turns = spark.createDataFrame([(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 1, "assistant", "x"), (None, 0, "user", "<|im_next|>\\|")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 as head")
    got = {r.conv_id: r for r in chat.chat_format(turns).select("conv_id", chat.read_turns(chat.F.col("formatted")).alias("t"), chat.read_loss(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(x) for x in got[1].t] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")] and got[1].loss == ""
    assert [tuple(x) for x in got[None].t] == [("user", "<|im_next|>\\|"), ("assistant", "x")] and got[None].loss == "x"
    assert chat.chat_format(turns.where("false")).count() == 0
