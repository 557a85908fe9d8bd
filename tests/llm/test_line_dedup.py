import random
import re
from collections import Counter, defaultdict

from quillgrid.llm import line_dedup, queries, scratch

SF = "/root/testdata/sf0.001"


def brute(rows, min_words=1):
    """Places to remove of each document: all but the first line of each group of lines that are linked, over all pairs with a token in common."""
    seen, places, at, up, later = [], defaultdict(list), [], [], set()

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for d, (_, text) in enumerate(rows):
        for pos, line in enumerate(text.split("\n")):
            w = [x for x in re.split(r"[\x09-\x0D\x20]+", line.lower()) if x]
            if len(w) < min_words:
                continue
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
            up.append(len(up))
            at.append((d, pos))
            for k, o in Counter(k for g in s for k in places[g]).items():
                if 100 * o >= 75 * (len(s) + len(seen[k]) - o):
                    later.add(len(seen))
                    a, b = root(k), root(len(seen))
                    up[max(a, b)] = min(a, b)
            for g in s:
                places[g].append(len(seen))
            seen.append(s)
    gone = {k for k in range(len(seen)) if root(k) != k}
    assert later <= gone
    return [[p for k, (e, p) in enumerate(at) if e == d and k in gone] for d in range(len(rows))]


def in_order(rows):
    """Rows (id, text) in the order of documents: by id, nulls first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_same_as_brute_force_on_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = in_order([(r.doc_id, r.text) for r in docs.collect()])
    want = dict(zip([d for d, _ in rows], brute(rows), strict=True))
    for r in queries.op2_line_dedup(spark, SF).collect():
        assert r.removed == ",".join(map(str, want[r.doc_id])) and r.n_removed == len(want[r.doc_id]) and r.n_lines >= r.n_removed


def near_lines():
    """Chains of like lines, so that many aren't like the earliest one of their group."""
    rng, line, rows = random.Random(4), [f"w{k}" for k in range(30)], []
    for d in range(120):
        if d % 10 == 0:
            line = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([6, 15, 40]))]
        line = [w if rng.random() > 0.04 else f"w{rng.randint(0, 60)}" for w in line]
        rows.append((d, " ".join(line) + "\nshort line\n" + " ".join(rng.sample(line, len(line)))))
    return rows


def star():
    """Variants of one long line that mostly don't link with each other, some that do, and two that link all of a part."""
    rng, base, rows = random.Random(9), [f"b{k}" for k in range(40)], []
    for d in range(80):
        line = list(base)
        for k in rng.sample(range(40), rng.choice([1, 1, 2])):
            line[k] = f"x{d}y{k}"
        rows.append((200 + d, " ".join(line)))
    return [*rows[:40], (300, " ".join(base)), (301, " ".join(base[:38])), *((d + 200, t) for d, t in rows[40:])]


def test_same_as_brute_force_on_near_lines(spark):
    rows = near_lines() + star()
    got = {r.doc_id: list(r.removed) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(zip([d for d, _ in rows], brute(rows), strict=True))


def test_frequent_tokens_lose_no_link(spark, monkeypatch):
    """All classes with a frequent token meet in a second order; the result is the same wherever that begins."""
    rows = near_lines()[:60] + star()
    want = dict(zip([d for d, _ in rows], brute(rows), strict=True))
    monkeypatch.setattr(line_dedup, "FREQUENT", 3)
    got = {r.doc_id: list(r.removed) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_each_line_is_lowered_once(spark):
    lines = line_dedup.lines_of(spark.createDataFrame([(1, "A b")], "doc_id long, text string"), "doc_id", "text", 1)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_rows_that_share_an_id(spark):
    """Rows of one id, or of none, with other texts are other documents; rows alike in both get the same result."""
    one, two = "one two three four five six\nread more", "alpha beta gamma delta epsilon\nother six seven eight nine ten\nread more"
    short = [(1, "Read less\n\nb"), (2, "read  LESS\n\na b c d e"), (3, "read less now\na b c d e\nb")]
    rows = [*short, (7, one + "\nread more"), (7, two), (None, "read more\nown words of a row"), (None, "its own other words\nown words of a row"), (9, one), (9, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in line_dedup.dedup(docs).collect())
    lines = Counter(x for _, _, t in kept for x in t.split("\n") if x)
    assert all(lines[x] == 1 for x in (*one.split("\n"), *two.split("\n"), "own words of a row", "its own other words"))
    assert [t for _, d, t in kept if d == 9] == ["", ""]
    assert [t for _, d, t in kept if d in (1, 2, 3)] == ["Read less\n\nb", "\na b c d e", "read less now"]


def test_odd_rows(odd, none):
    assert line_dedup.line_report(odd.where("doc_id = 6"), min_words=5).first().n_removed == 0
    got = {r.doc_id: r for r in line_dedup.line_report(odd).collect() if r.doc_id is not None}
    assert got[0].n_lines == 0 and got[1].n_removed == 0 and got[12].n_removed == 0
    assert all(got[k].n_removed == 1 and list(got[k].match_ids) == [None] or got[k].n_removed == 1 for k in (9, 10, 11))  # the row without an id comes first
    assert line_dedup.line_report(none).count() == 0
    kept = line_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[9] == texts[10] == "" and texts[6] == "line\nother words here" and texts[0] is None
    assert line_dedup.dedup(none).count() == 0


def test_native(spark, monkeypatch):
    """No Python in the plan of any step."""
    plans, write = [], scratch.write
    monkeypatch.setattr(scratch, "write", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or write(df, *a))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    plans.append(line_dedup.dedup(docs)._jdf.queryExecution().toString())
    assert len(plans) > 10 and not any(re.search("Python|Pandas|Arrow|ExistingRDD", p) for p in plans)


def test_shingles_are_pieces_of_one_string(spark):
    """Token sets have a token for each distinct shingle, shared where shingles are, and hash one piece for each instead of array elements."""
    rng = random.Random(7)
    lines = [" ".join(rng.choice(["a", "b", "é", "漢字", "word"]) for _ in range(n)) for n in (1, 2, 4, 5, 6, 6, 9, 30, 30, 60)] + ["a", "a a", "a a a a", "a a a a a", "a a a a a a a"]
    df = line_dedup.token_sets(spark.createDataFrame(list(enumerate(lines)), "line long, words string"), "line")
    got = {r.line: set(r.t) for r in df.collect() if len(r.t) == len(set(r.t))}
    want = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, lines)]
    assert [[len(got[a] & got[b]) for b in range(len(lines))] for a in range(len(lines))] == [[len(x & y) for y in want] for x in want]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" in plan and "h#" not in plan


def test_leads_of_a_token_differ(spark):
    """Two different leads meet all lines of a token, so up to three lines need no second round."""
    rows = [(k, f"one two three four five six seven eight x{k}", 1 + (k == 0)) for k in range(3)]
    sets = line_dedup.token_sets(spark.createDataFrame(rows, "line long, words string, copies long"), "line", "copies")
    got = line_dedup.unpacked(line_dedup.postings(sets, line_dedup.PERCENT)).collect()
    assert got and all((r.k, r.x.line, r.y.line) == (3, 0, 2) for r in got)
