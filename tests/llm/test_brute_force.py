"""Operators against plain versions of themselves on small data."""

import inspect
import random
import re

import duckdb
import numpy as np
import pytest

from quillgrid.llm import components, html_extract, jaccard, mixing, sharding, toxicity, training_pages
from quillgrid.llm import queries as q
from quillgrid.llm import signature_tree as tree

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(q.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    want = sorted(tuple(map(plain, row)) for row in rel.fetchall())
    df = q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_row_for_each(spark, name):
    source = "pages" if name == "op4_html" else "documents"
    assert q.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def near_copies(rng, n):
    """Texts around a few seeds, some just above and some just below the threshold, and copies."""
    seeds = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 12, 40, 120]))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
        out.append(" ".join(words))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    groups = tree.Groups(len(texts))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                groups.join(a, b)
    return [groups.find(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [4096, 16])
def test_jaccard(spark, monkeypatch, block):
    """Also with blocks so small that they are cut and meet in a second round."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 6)
    monkeypatch.setattr(jaccard, "BROADCAST_TIES", 0 if block == 16 else 500_000)
    texts = near_copies(random.Random(block), 300)
    want, sizes = brute_components(texts)
    got = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want
    assert [r.n_shingles for r in got] == sizes


@pytest.mark.parametrize("seed", range(6))
def test_signature_tree(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(5, 300)).astype(np.uint64)) for _ in range(20)]
    sets = []
    for _ in range(250):
        s = base[rng.integers(len(base))]
        kept = s[rng.random(len(s)) > rng.choice([0, 0.05, 0.12, 0.3])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, rng.integers(1, 8)).astype(np.uint64)])))
    want, got = tree.Groups(len(sets)), tree.Groups(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if tree.alike(sets[a], sets[b], 75):
                want.join(a, b)
    for a, b in tree.links(sets, 75):
        assert tree.alike(sets[a], sets[b], 75)
        got.join(a, b)
    assert (want.all() == got.all()).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    groups = tree.Groups(500)
    for a, b in edges:
        groups.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {k: groups.find(k) for k in nodes if groups.find(k) != k}


def best_capacity(sizes, n):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, parts = (lo + hi) // 2, 0, 1
        for s in sizes:
            if used + s > mid:
                parts, used = parts + 1, 0
            used += s
        lo, hi = (lo, mid) if parts <= n else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("most", [100_000, 150])
def test_sharding_is_minimax(spark, most):
    """Also when the driver may hold so few group ends that windows are refined."""
    rng = random.Random(most)
    sizes = [rng.choice([1, 5, 30, 200]) for _ in range(9000)]
    ends = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame(list(zip(ends, sizes, strict=True)), "upto long, size long")
    for n in (3, 4):
        cuts = sharding.cut_points(groups, n, most)
        loads = np.diff([0, *cuts])
        assert cuts[-1] == ends[-1] and set(cuts) <= set(ends)
        assert max(loads) == best_capacity(sizes, n)


@pytest.mark.parametrize("share", [0.01, 1 / 3])
def test_sharding_with_hot_group(spark, share):
    """A group that can't be split, among more groups than the driver may hold."""
    sizes = [random.Random(7).randint(1, 200) for _ in range(6000)]
    sizes.insert(2500, int(sum(sizes) * share / (1 - share)))
    ends = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame(list(zip(ends, sizes, strict=True)), "upto long, size long")
    for n in (3, 16):
        cuts = sharding.cut_points(groups, n, 150)
        assert len(cuts) == n and cuts[-1] == ends[-1] and set(cuts) <= set(ends)
        assert max(np.diff([0, *cuts])) == best_capacity(sizes, n)


def test_shards_of_documents(spark):
    rows = sharding.assign(spark.read.parquet(f"{SF}/documents.parquet"), 8).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    loads = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
    assert max(loads) <= sum(loads) / 8 + max(r["size"] for r in rows)


def test_mixing_targets(spark):
    rows = [(k, "w " * (1 + k % 7), s) for s, n in (("a", 400), ("b", 100), ("c", 20), (None, 200)) for k in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.taken % r.size == 0
    weights, total = {"a": 1, "b": 2, "c": 3, None: 1}, sum(size.values())
    want, free, left = {}, dict(weights), total
    while True:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
            del free[s]
    want |= {s: level * w for s, w in free.items()}
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 2 * 7


def test_html_on_unseen_pages():
    """Accuracy on generated pages that the model hasn't seen, by blocks."""
    from quillgrid.llm import dom

    model, right, extra, missed = html_extract.trained(), 0, 0, 0
    for page in training_pages.make_pages(150, seed=991):
        nodes, own = dom.nodes_of(dom.parse(page)), {}
        want = set()
        for n in nodes:
            html_extract.marked(n, own)
            if n.tag == "text" and own[id(n)]:
                want.add(n.text)
        got = set(next(html_extract.extract_texts([page], model)).split("\n\n")) - {""}
        right, extra, missed = right + len(want & got), extra + len(got - want), missed + len(want - got)
    assert right / (right + extra) > 0.95 and right / (right + missed) > 0.95


def test_html_table(spark):
    """Every page's article, taken out by its own markup."""
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_toxicity_held_out(spark):
    """Trained on the larger table, held-out rows only."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train_model(docs, labels)).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    found = sum(p for p, _ in held)
    right = sum(p and t for p, t in held)
    assert right / found > 0.95 and right / sum(t for _, t in held) > 0.8


def test_toxicity_keeps_all_expressions(spark):
    """A toxic word counts however many other words the corpus has: no table is cut to a size."""
    caps = {k: 100 for k in ("most_words", "most_pairs") if k in inspect.signature(toxicity.fit_counts).parameters}
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 300)}"
    rows = [(k % 2, " ".join([*(word() for _ in range(30)), *(["vile", word()] if k % 16 == 1 else [])])) for k in range(1600)]
    model = toxicity.fit_counts(spark.createDataFrame(rows, "toxic long, text string"), **caps)
    probe = spark.createDataFrame([(1, "w1 w2 vile w3"), (2, "w1 w2 w3 w4")], "id long, text string")
    got = {r.id: r.total for r in toxicity.totals(probe, model, ["id"]).collect()}
    assert got[1] > 0.1 and abs(got[2]) < 0.1


def test_token_counts_of_table(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in q.QUERIES["op6_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512)
