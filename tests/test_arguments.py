"""Arguments that are cells, options of array functions, structural edits, and CSV that loses nothing."""

import pytest
from pyspark.sql import functions as F

from quillgrid.formula import arrays, compiler, parser, rewrite
from quillgrid.functions import stats
from quillgrid.operators import filters, lookups, positional, search, svg
from quillgrid.sources import csv, sidecar
from quillgrid.streaming import follow
from quillgrid.workbook import Edit, Workbook


@pytest.fixture(scope="module")
def book(spark):
    data = [(0, "apple", 1.0), (1, "Plum", 2.0), (2, "avocado", 3.0), (3, "plum", 4.0), (4, None, 5.0)]
    crit = [(0, "a*"), (1, "PLUM"), (2, "<>plum"), (3, "=plum"), (4, "?l*")]
    nums = [(0, ">2", 2.0), (1, "<=2", 5.0), (2, "3", -1.0), (3, "<>3", 0.0)]
    frames = {
        "s": spark.createDataFrame(data, "_row long, a string, b double"),
        "c": spark.createDataFrame(crit, "_row long, a string"),
        "n": spark.createDataFrame(nums, "_row long, a string, b double"),
    }
    return compiler.Sheets(frames)


def column(book, formula, sheet):
    rows = compiler.fill_down(formula, book, sheet, "x").orderBy("_row").collect()
    return [r.x_error or r.x for r in rows]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("=COUNTIF(s!A:A,c!A1)", 2), ("=SUMIF(s!A:A,c!A2,s!B:B)", 6), ("=COUNTIF(s!A:A,c!A3)", 3), ('=COUNTIF(s!B:B,">"&n!B1)', 3), ("=LARGE(s!B:B,n!B1)", 4), ("=LARGE(s!B:B,n!B3)", "#NUM!"),
        ("=VLOOKUP(2,s!B:B,n!B3+2,FALSE)", 2), ('=SEARCH(c!A5,"xplum")', 2), ('=SEARCH("~*","a*b")', 2), ("=INDEX(s!A1:B5,0,2)", "#VALUE!"), ("=INDEX(s!B2:B2,0,1)", 2), ("=INDEX(s!A1:B5,9,1)", "#REF!"),
        ("=CONCAT(s!A1:A3)", "applePlumavocado"), ('=TEXTJOIN("-",FALSE,s!A3:A5)', "avocado-plum-"), ('=TEXTJOIN("-",TRUE,s!A3:A5)', "avocado-plum"), ("=CONCATENATE(s!A1:A3)", "#VALUE!"), ('=TEXT(3.5,"# ?/?")', "3.5"), ("=MEDIAN(s!B:B)", 3),
        ("=PERCENTILE.INC(s!B:B,0.1)", 1.4), ("=QUARTILE.INC(s!B:B,n!B2)", "#NUM!"), ("=NETWORKDAYS(DATE(2024,1,1),DATE(2024,1,14),DATE(2024,1,3))", 9),
    ],
)
def test_scalar(book, formula, want):
    r = compiler.evaluate(formula, book, "s").first()
    got = r["error"] or r["value"]
    assert got == want or (isinstance(want, (int, float)) and abs(float(got) - want) < 1e-9)


def test_criteria_by_row(book):
    assert column(book, "=COUNTIF(s!A:A,A1)", "c") == [2, 2, 3, 2, 2]
    assert column(book, "=SUMIF(s!A:A,A1,s!B:B)", "c") == [4, 6, 9, 6, 6]
    assert column(book, "=COUNTIF(s!B:B,A1)", "n") == [3, 2, 1, 4]
    assert column(book, '=SUMIFS(s!B:B,s!B:B,A1,s!A:A,"<>plum")', "n") == [8, 1, 3, 6]
    assert column(book, "=AVERAGEIF(s!B:B,B1)", "n") == [2, 5, "#DIV/0!", "#DIV/0!"]


def test_too_many_criteria(spark, book, monkeypatch):
    monkeypatch.setattr(compiler, "MOST_CRITERIA", 2)
    with pytest.raises(parser.FormulaError):
        column(book, "=COUNTIF(s!A:A,A1)", "c")


def test_error_of_a_contributing_cell(spark):
    kind = "struct<tag:tinyint,num:double,str:string,err:string>"
    df = spark.createDataFrame([(0, "x", (0, 1.0, None, None)), (1, "y", (3, None, None, "#NUM!")), (2, "x", (0, 2.0, None, None))], f"_row long, a string, b {kind}")
    sheets = compiler.Sheets({"s": df})
    assert compiler.evaluate('=SUMIF(A:A,"x",B:B)', sheets, "s").first()["value"] == 3
    assert compiler.evaluate('=SUMIF(A:A,"y",B:B)', sheets, "s").first()["error"] == "#NUM!"


def test_array_options(book):
    a = arrays.Arrays(book, "s")
    rows = lambda f: [tuple(r)[1:] for r in a.frame(f).orderBy("_r").collect()]
    assert rows('=FILTER(A:A,B:B>9,"none")') == [("none",)]
    assert rows("=FILTER(A:A,B:B>9)") == [(None, "#N/A")]
    assert rows("=SORT(HSTACK(B2:B3,B1:B2),1,1,TRUE)")[0][:2] == (1.0, 2.0)
    assert rows("=SORT(B:B,5)") == [(None, "#VALUE!")]
    assert rows("=UNIQUE(HSTACK(B:B,B:B,A:A),TRUE)")[0][:2] == (1.0, "apple")
    assert rows("=WRAPROWS(B:B,2,0)")[-1] == (5.0, 0.0) and rows("=WRAPROWS(B:B,2)")[-1][-1] == "#N/A"
    assert rows("=ARRAYTOTEXT(A1:B2,TRUE)") == [("{apple, 1;Plum, 2}",)]


def test_approximate_text(spark):
    table = spark.createDataFrame([(0, "a"), (1, "m"), (2, "T")], "_row long, k string")
    probes = spark.createDataFrame([(0, "B"), (1, "m"), (2, "zz"), (3, "A"), (4, "")], "_row long, p string")
    down = {r._row: r.match_row for r in lookups.approximate(probes, "p", table, "k", ["k"]).collect()}
    assert down == {0: 0, 1: 1, 2: 2, 3: 0, 4: None}
    up = {r._row: r.match_row for r in lookups.approximate(probes, "p", table, "k", ["k"], up=True).collect()}
    assert up == {0: 1, 1: 1, 2: None, 3: 0, 4: 0}


def test_quantiles(spark):
    df = spark.range(1001).select((F.col("id") % 2).alias("g"), F.when(F.col("id") > 0, (F.col("id") * 37 % 1001).cast("double")).alias("x"))
    got = {r.g: r for r in stats.quantiles(df, "x", {"a": 0.0, "b": 0.333, "c": 1.0}, ["g"]).collect()}
    want = df.where("x is not null").groupBy("g").agg(*[F.percentile("x", F.lit(k)).alias(n) for n, k in (("a", 0.0), ("b", 0.333), ("c", 1.0))]).collect()
    assert all(abs(got[r.g][n] - r[n]) < 1e-9 for r in want for n in "abc")
    assert stats.quantiles(df.where("false"), "x", {"a": 0.5}).first()["a"] is None


def test_running_totals_across_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("_row"), (F.col("id") % 7).alias("v"), F.lit(1).alias("w"))
    got = positional.running_totals(df, "_row", {"t": "v", "n": "w"}, 64).orderBy("_row").collect()
    total = 0
    for k, r in enumerate(got):
        total += k % 7
        assert (r.t, r.n) == (total, k + 1)


@pytest.fixture
def sheet(spark):
    df = spark.createDataFrame([(k, float(k), float(10 * k), float(100 * k)) for k in range(6)], "_row long, a double, b double, c double")
    book = Workbook({"s": df})
    book.put("s", "B2", "7")
    book.put("s", "D1", "=SUM(B1:B3)")
    return book


def seen(book, name="s"):
    return [tuple(r) for r in book.sheets[name].view().orderBy("_row").collect()]


def test_columns_move_with_what_is_on_them(sheet):
    before = seen(sheet)
    sheet.move_columns("s", ["b", "a", "c"])
    assert sheet.sheets["s"].edits[1, 0].value == 7 and sheet.sheets["s"].edits[0, 3].formula == "=SUM(A1:A3)"
    assert [(r[0], r[2], r[1], *r[3:]) for r in seen(sheet)] == before
    assert sheet.undo() and seen(sheet) == before and sheet.sheets["s"].edits[0, 3].formula == "=SUM(B1:B3)"
    assert sheet.redo() and sheet.sheets["s"].edits[0, 3].formula == "=SUM(A1:A3)"


def test_insert_and_delete_columns(sheet):
    sheet.merge("s", "A5:B6")
    sheet.insert_columns("s", 1, ["x"])
    s = sheet.sheets["s"]
    assert s.columns() == ["a", "x", "b", "c"] and s.edits[1, 2].value == 7 and s.edits[0, 4].formula == "=SUM(C1:C3)" and s.merges == [(4, 5, 0, 2)]
    sheet.delete_columns("s", 1, 2)
    s = sheet.sheets["s"]
    assert s.columns() == ["a", "c"] and (1, 1) not in s.edits and s.edits[0, 2].formula == "=SUM(#REF!)" and s.merges == [(4, 5, 0, 0)]
    assert sheet.undo() and sheet.undo() and sheet.sheets["s"].edits[0, 3].formula == "=SUM(B1:B3)"


def test_rows_take_merges_along_and_can_be_undone(sheet):
    sheet.merge("s", "A5:B6")
    sheet.insert_rows("s", 1, 2)
    assert sheet.sheets["s"].merges == [(6, 7, 0, 1)] and sheet.sheets["s"].edits[0, 3].formula == "=SUM(B1:B5)"
    sheet.delete_rows("s", 7)
    assert sheet.sheets["s"].merges == [(6, 6, 0, 1)]
    assert sheet.undo() and sheet.undo() and sheet.sheets["s"].merges == [(4, 5, 0, 1)] and len(seen(sheet)) == 6


def test_copy_and_cut(sheet):
    sheet.copy_block("s", "A2:B3", "A5")
    rows = seen(sheet)
    assert [r[1:3] for r in rows[4:6]] == [(1.0, 7.0), (2.0, 20.0)] and rows[1][1:3] == (1.0, 7.0)
    sheet.put("s", "E1", "=B2+1")
    sheet.copy_block("s", "B2", "B4", cut=True)
    rows = seen(sheet)
    assert rows[1][2] is None and rows[3][2] == 7.0 and sheet.sheets["s"].edits[0, 4].formula == "=B4+1"
    assert sheet.undo() and seen(sheet)[1][2] == 7.0


def test_rewriting_of_moved_columns():
    to = {0: 2, 1: 0, 2: 1}
    assert rewrite.permuted("=A1+$B$2+SUM(B1:C9)+SUM(A1:B2)", "s", "s", to) == "=C1+$A$2+SUM(A1:B9)+SUM(A1:B2)"
    assert rewrite.cut_to('=A1&"A1"+t!A1', "s", "s", (0, 0, 0, 0), 2, 1) == '=B3&"A1"+t!A1'


def test_csv_keeps_every_field(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n" + "1,2\n" * 150 + '1,2,3,4\n5,"x,y"\n')
    rows = csv.read(spark, f"file://{tmp_path}/wide.csv").orderBy("_row").collect()
    assert len(rows) == 152 and (rows[150]["C"], rows[150]["D"]) == (3.0, 4.0) and rows[151]["b"]["str"] == "x,y"
    (tmp_path / "narrow.csv").write_text('a,b\n1,"x,y,z"\n2,"p,q,r"\n')
    assert csv.read(spark, f"file://{tmp_path}/narrow.csv").columns == ["_row", "a", "b"]


def test_csv_folder(spark, tmp_path):
    """Files of different sizes, each with the header; one has none."""
    for k, size in enumerate((3, 400, 1)):
        (tmp_path / f"p{k}.csv").write_text(("" if k == 2 else "a,b\n") + "".join(f"{1000 * k + j},t\n" for j in range(size)))
    rows = csv.read(spark, f"file://{tmp_path}").orderBy("_row").collect()
    assert [r.a for r in rows] == [0, 1, 2, *range(1000, 1400), 2000] and [r._row for r in rows] == list(range(404))


def test_csv_is_cut_unless_quotes_hold_line_ends(spark, tmp_path):
    d = csv.Dialect()
    (tmp_path / "flat.csv").write_text('a,b\n1,"x, y"\n')
    (tmp_path / "deep.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert not csv.has_line_ends_in_quotes(spark, f"file://{tmp_path}/flat.csv", d)
    assert csv.has_line_ends_in_quotes(spark, f"file://{tmp_path}/deep.csv", d)
    assert [r.b for r in csv.read(spark, f"file://{tmp_path}/deep.csv").orderBy("_row").collect()] == ["x\ny", "z"]


def test_csv_export_is_renamed_when_whole(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    csv.export(spark.createDataFrame([(0, "x"), (1, 'q"')], "_row long, a string"), out, single=True, line_end="\r\n")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert next((tmp_path / "out").glob("*.csv")).read_bytes() == b'a\r\nx\r\n"q"""\r\n'
    with pytest.raises(FileExistsError):
        csv.export(spark.createDataFrame([(0, "x")], "_row long, a string"), out)


def test_edit_in_a_snapshot_is_its_own(sheet):
    sheet.insert_rows("s", 5)
    sheet.put("s", "B2", "8")
    assert sheet.undo() and sheet.sheets["s"].edits[1, 1] == Edit(7.0)


def test_names_by_sheet(spark):
    one = spark.createDataFrame([(0, 1.0)], "_row long, a double")
    book = Workbook({"s": one, "t": one})
    book.define("Rate", "=2")
    book.define("Rate", "=3", "t")
    book.put("s", "B1", '=Rate*10&"Rate"')
    book.put("t", "B1", "=Rate*10")
    assert book.sheets["s"].edits[0, 1].value == "20Rate" and book.sheets["t"].edits[0, 1].value == 30
    book.rename_name("Rate", "Share")
    assert book.sheets["s"].edits[0, 1].formula == '=Share*10&"Rate"' and book.sheets["t"].edits[0, 1].formula == "=Rate*10"
    assert book.delete_name("Rate", "t") == [("t", 0, 1)] and book.sheets["t"].edits[0, 1].error == "#NAME?" or book.sheets["t"].edits[0, 1].error == "#VALUE!"


def test_protection(sheet):
    sheet.protect("s", ["A1:B2"], {"rows"})
    sheet.put("s", "A1", "5")
    with pytest.raises(PermissionError):
        sheet.put("s", "C1", "5")
    sheet.insert_rows("s", 3)
    with pytest.raises(PermissionError):
        sheet.delete_columns("s", 0)
    with pytest.raises(PermissionError):
        sheet.merge("s", "A1:B1")
    with pytest.raises(ValueError):
        sheet.protect("s", [], {"everything"})
    sheet.unprotect("s")
    sheet.put("s", "C1", "5")


def test_formulas_are_worked_out_in_batches(sheet, monkeypatch):
    jobs = []
    evaluate = Workbook._evaluate
    monkeypatch.setattr(Workbook, "_evaluate", lambda self, batch: jobs.append(len(batch)) or evaluate(self, batch))
    sheet.put_many({("s", k, 5): Edit(formula=f"=B{k + 1}*2") for k in range(5)} | {("s", 0, 6): Edit(formula="=F1+F2")})
    assert jobs[-2:] == [5, 1] or sum(jobs) == 6 and len(jobs) == 2
    assert sheet.sheets["s"].edits[1, 5].value == 14 and sheet.sheets["s"].edits[0, 6].value == 14


def test_bridge(sheet, tmp_path):
    bridge = follow.Bridge(sheet, "s")
    assert bridge.run("# nothing") is None
    bridge.run("put A1 42")
    assert bridge.run("get A1+1") == 43
    bridge.run("chart B1:C6 scatter A")
    bridge.run("label Sales & more")
    bridge.run("series first second")
    drawn = bridge.run(f"svg {tmp_path}/c.svg")
    assert drawn.count("<circle") == 12 and "Sales &amp; more" in drawn and "second" in drawn and (tmp_path / "c.svg").read_text() == drawn
    with pytest.raises(ValueError):
        bridge.run("dance A1")


def test_svg_series():
    spots = {"a": [(0, 1), (1, 10), (2, 100)], "b": [(0, 5), (1, -5)]}
    assert svg.series(spots).count("<polyline") == 2
    logged = svg.series(spots, "scatter", log_y=True)
    assert logged.count("<circle") == 4


def test_ranks_of_visible_rows(spark):
    seen_rows = spark.range(1000).select(F.col("id").alias("_row")).where("_row % 3 = 1")
    assert [filters.nth_visible(seen_rows, n, block=64) for n in (0, 5, 332, 333, -1)] == [1, 16, 997, None, None]
    assert filters.rank_visible(seen_rows, 16) == 5 and filters.first_visible(seen_rows, 17) == 19 and filters.first_visible(seen_rows, 999) is None


def test_clipboard_html():
    rows = [["a<b", "line\nend"], ["", "1"]]
    assert csv.from_html(csv.to_html(rows)) == rows
    assert csv.from_html("<p>one</p><p>two</p>") == [["one"], ["two"]]


def test_autosave(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/base")
    base, now = spark.read.parquet(f"file://{tmp_path}/base"), [0.0]
    auto = sidecar.Autosave(spark, f"file://{tmp_path}/book", base, 30.0, lambda: now[0])
    assert auto.recover() is None and auto.note(lambda: {"n": 1}) and not auto.note(lambda: {"n": 2})
    now[0] = 31.0
    assert auto.note(lambda: {"n": 3}) and auto.recover() == {"n": 3}
    auto.saved()
    assert auto.recover() is None


def test_replace_in_one_cell_and_in_formulas(spark):
    df = spark.createDataFrame([(0, "red red"), (1, "red")], "_row long, a string")
    out, edits = search.replace_one(df, search.Query("RED"), "blue", ["a"], 0, "a")
    assert [r.a for r in out.orderBy("_row").collect()] == ["blue blue", "red"] and edits.count() == 1
    cells_ = {(0, 0): Edit(formula="=SUM(A1:A3)"), (1, 0): Edit(formula="=SUM(B1:B3)"), (2, 0): Edit(3.0)}
    assert search.replace_formulas(cells_, search.Query("sum"), "MAX", lambda c: c == (1, 0)) == {(0, 0): "=MAX(A1:A3)"}
