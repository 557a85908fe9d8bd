import pytest

from quillgrid.formula import arrays, compiler, graph, rewrite
from quillgrid.formula import parser as p
from quillgrid.workbook import Edit, Workbook, series, typed

ROWS = [(0, 10.0, "alpha", 1.0, 50.0), (1, 20.0, "bravo", 2.0, 40.0), (2, 30.0, "charlie", 3.0, 30.0), (3, 40.0, "delta", 4.0, 20.0), (4, 50.0, "echo", 5.0, 10.0)]


@pytest.fixture(scope="module")
def sheets(spark):
    df = spark.createDataFrame(ROWS, "_row long, A double, B string, C double, D double").cache()
    mixed = spark.sql("select id as _row, case id when 0 then named_struct('tag', 0Y, 'num', 5D, 'str', cast(null as string), 'err', cast(null as string)) when 1 then named_struct('tag', 1Y, 'num', cast(null as double), 'str', 'x', 'err', cast(null as string)) when 2 then named_struct('tag', 3Y, 'num', cast(null as double), 'str', cast(null as string), 'err', '#DIV/0!') end as M from range(4)")
    return compiler.Sheets({"S": df, "T": df.withColumn("A", df.A * 2), "Mixed": mixed})


GOLDEN = [
    ("=1+2*3^2", 19.0), ("=-2^2", 4.0), ("=50%", 0.5), ("=2^3^2", 512.0), ('="a"&1&TRUE', "a1TRUE"), ('="a"="A"', True), ('=1<"a"', True), ("=1/0", "#DIV/0!"), ("=#N/A+1/0", "#N/A"), ("=(-8)^0.5", "#NUM!"),
    ("=SUM(A1:A5)", 150.0), ("=SUM(A1:D5)", 315.0), ("=SUM(A1:A5,1,2)", 153.0), ("=COUNT(A1:B5)", 5.0), ("=AVERAGE(B1:B5)", "#DIV/0!"), ("=MIN(B1:B5)", 0.0), ("=MAX(A1:D5)", 50.0), ("=SUM(S:T!A1:A5)", 450.0), ("=T!A1", 20.0), ("=SUM(Gone!A1:A2)", "#REF!"),
    ("=MEDIAN(A1:A4)", 25.0), ("=PERCENTILE.INC(A1:A4,0.25)", 17.5), ("=PERCENTILE.INC(A1:A4,2)", "#NUM!"), ("=QUARTILE.INC(A1:A5,1.9)", 20.0), ("=STDEV.S(A1:A1)", "#DIV/0!"), ("=VAR.P(A1:A1)", 0.0), ("=MODE.SNGL(A1:A5)", "#N/A"), ("=MODE.SNGL(A1:A5,20,30,30,20)", 20.0), ("=LARGE(A1:A5,2)", 40.0), ("=SMALL(A1:A5,9)", "#NUM!"), ("=RANK.EQ(30,A1:A5)", 3.0), ("=RANK.EQ(31,A1:A5)", "#N/A"), ("=RANK.EQ(20,A1:A5,1)", 2.0),
    ("=SUM(Mixed!A1:A1)", 5.0), ("=SUM(Mixed!A1:A4)", "#DIV/0!"), ("=COUNT(Mixed!A1:A2)", 1.0), ("=Mixed!A3", "#DIV/0!"), ('=COUNTIF(Mixed!A1:A4,"<>q")', 3.0),
    ('=COUNTIF(B1:B5,"*a*")', 4.0), ('=COUNTIF(B1:B5,"?cho")', 1.0), ('=COUNTIF(B1:B5,"<>ECHO")', 4.0), ('=SUMIF(A1:A5,">20",C1:C5)', 12.0), ('=AVERAGEIF(B1:B5,"zulu",A1:A5)', "#DIV/0!"), ('=SUMIFS(A1:A5,C1:C5,">2",D1:D5,"<=30")', 120.0), ('=SUMIFS(A1:A5,C1:C4,">2")', "#VALUE!"),
    ("=VLOOKUP(30,A1:D5,2,FALSE)", "charlie"), ('=VLOOKUP("B*",B1:C5,2,FALSE)', 2.0), ("=VLOOKUP(35,A1:B5,2)", "charlie"), ("=VLOOKUP(5,A1:B5,2)", "#N/A"), ("=VLOOKUP(30,A1:B5,3,FALSE)", "#REF!"), ("=VLOOKUP(30,A1:B5,0,FALSE)", "#VALUE!"), ("=MATCH(35,A1:A5)", 3.0), ("=MATCH(35,D1:D5,-1)", 2.0), ('=MATCH("C*",B1:B5,0)', 3.0), ("=MATCH(1,A1:B5,0)", "#N/A"), ("=INDEX(B1:B5,3)", "charlie"), ("=INDEX(A1:D5,2,4)", 40.0), ("=INDEX(B1:B5,9)", "#REF!"), ("=XLOOKUP(33,A1:A5,B1:B5,\"none\",-1)", "charlie"), ("=XLOOKUP(33,A1:A5,B1:B5,\"none\",1)", "delta"), ("=XLOOKUP(99,A1:A5,B1:B5,\"none\")", "none"), ("=XLOOKUP(99,A1:A5,B1:B5)", "#N/A"), ('=INDEX(A1:A5,MATCH("delta",B1:B5,0))', 40.0),
    ('=IF(A1>5,"yes","no")', "yes"), ("=IF(FALSE,1)", False), ('=IFERROR(1/0,"x")', "x"), ("=IFERROR(A1,0)", 10.0), ("=IFNA(1/0,0)", "#DIV/0!"), ("=IFNA(NA(),7)", 7.0), ("=AND(TRUE,A1=10)", True), ("=OR(FALSE,A1=11)", False), ("=NOT(0)", True), ("=ISNUMBER(B1)", False), ("=ISTEXT(B1)", True), ("=ISBLANK(Z9)", True), ("=ISERR(NA())", False), ("=ISERROR(NA())", True), ("=ERROR.TYPE(1/0)", 2.0), ("=ERROR.TYPE(1)", "#N/A"), ('=CHOOSE(2,"a","b")', "b"), ("=CHOOSE(3,1,2)", "#VALUE!"),
    ("=ROUND(1.005,2)", 1.0), ("=ROUND(-2.5)", -3.0), ("=FLOOR(7.5,2)", 6.0), ("=CEILING(7.5,0)", "#DIV/0!"), ("=SQRT(-1)", "#NUM!"), ("=LN(0)", "#NUM!"), ("=INT(-1.5)", -2.0),
    ('=LEN("café")', 4.0), ('=LEFT("abc",2)', "ab"), ('=RIGHT("abc",9)', "abc"), ('=RIGHT("abc",0)', ""), ('=MID("abcd",2,2)', "bc"), ('=MID("abc",0,1)', "#VALUE!"), ('=LEFT("abc",-1)', "#VALUE!"), ('=UPPER("straße")', "STRASSE"), ("=PROPER(\"o'neil 2nd-hand\")", "O'Neil 2Nd-Hand"), ('=TRIM("  a   b ")', "a b"), ('=SUBSTITUTE("a-b-c","-","+",2)', "a-b+c"), ('=SUBSTITUTE("abab","b","x")', "axax"), ('=REPLACE("abcdef",3,2,"X")', "abXef"), ('=FIND("b","abc")', 2.0), ('=FIND("B","abc")', "#VALUE!"), ('=SEARCH("B?","abc")', 2.0), ('=REPT("ab",3)', "ababab"), ('=REPT("a",40000)', "#VALUE!"), ('=CONCAT("a",1,TRUE)', "a1TRUE"), ('=TEXTJOIN("-",TRUE,"a","","b")', "a-b"), ('=TEXTJOIN("-",FALSE,"a","","b")', "a--b"), ('=VALUE("($1,200)")', -1200.0), ('=VALUE("12%")', 0.12), ('=VALUE("x")', "#VALUE!"),
    ('=TEXT(1234.567,"#,##0.00")', "1,234.57"), ('=TEXT(0.256,"0.0%")', "25.6%"), ('=TEXT(-5,"0;(0);zero")', "(5)"), ('=TEXT(0,"0;(0);\\z\\e\\r\\o")', "zero"), ('=TEXT(12345,"0.00E+00")', "1.23E+04"), ('=TEXT(45366,"yyyy-mm-dd")', "2024-03-15"), ('=TEXT(45366.75,"h:mm AM/PM")', "6:00 PM"), ('=TEXT(1234567,"0.0,,")', "1.2"), ('=TEXT(7,"000")', "007"), ('=TEXT(150,"[>=100]""big"";""small""")', "big"), ('=TEXT(1.5,"[h]:mm")', "36:00"),
    ("=DATE(2024,3,15)", 45366.0), ("=DATE(2024,14,1)", 45689.0), ("=YEAR(45366)", 2024.0), ("=MONTH(45366)", 3.0), ("=DAY(45366)", 15.0), ("=HOUR(0.75)", 18.0), ("=WEEKDAY(45366)", 6.0), ("=WEEKDAY(45366,3)", 4.0), ("=WEEKDAY(45366,9)", "#NUM!"), ("=EOMONTH(45366,1)", 45412.0), ("=EDATE(DATE(2024,1,31),1)", 45351.0), ("=DAYS(45366,45356)", 10.0), ('=DATEDIF(DATE(2024,2,29),DATE(2024,3,31),"M")', 1.0), ('=DATEDIF(DATE(2024,1,31),DATE(2024,2,29),"M")', 0.0), ('=DATEDIF(5,4,"D")', "#NUM!"), ("=NETWORKDAYS(DATE(2024,3,1),DATE(2024,3,15))", 11.0), ("=NETWORKDAYS(DATE(2024,3,15),DATE(2024,3,1))", -11.0),
    ("=LET(x,A1,y,x*2,x+y)", 30.0), ("=LET(x,1,x,x+1,x)", 2.0), ("=LAMBDA(a,b,a*b)(3,A1)", 30.0), ("=LAMBDA(a,a)(1,2)", "#VALUE!"), ("=LAMBDA(f,f(2))(LAMBDA(x,x+1))", 3.0), ("=NOSUCH(1)", "#NAME?"), ("=rate*2", 14.0), ("=nothing", "#NAME?"), ("=Z9", None), ("=Z9+1", 1.0),
]


@pytest.mark.parametrize("formula,want", GOLDEN)
def test_golden(sheets, formula, want):
    r = compiler.evaluate(formula, sheets, "S", {"rate": "=7"}).first()
    got = r["error"] or r["value"]
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


FILLED = [
    ("=A1*2", [20, 40, 60, 80, 100]), ("=SUM($A$1:A1)", [10, 30, 60, 100, 150]), ("=A2-A1", [10, 10, 10, 10, -50]), ("=AVERAGE(A1:A3)", [20, 30, 40, 45, 50]), ("=SUM(A1:D1)", [61, 62, 63, 64, 65]), ("=VLOOKUP(C1*10,$A$1:$B$5,2,FALSE)", ["alpha", "bravo", "charlie", "delta", "echo"]), ("=SUMIF(A:A,A1,D:D)", [50, 40, 30, 20, 10]), ("=COUNTIFS(A:A,A1,D:D,\">20\")", [1, 1, 1, 0, 0]), ("=RANK(A1,A:A)", [5, 4, 3, 2, 1]), ("=A1/SUM(A:A)*150", [10, 20, 30, 40, 50]), ('=IF(C1>2,B1,"low")', ["low", "low", "charlie", "delta", "echo"]), ("=XLOOKUP(A1+5,A:A,B:B,\"-\",1)", ["bravo", "charlie", "delta", "echo", "-"]), ("=A1/(C1-1)", ["#DIV/0!", 20, 15, 40 / 3, 12.5]),
]


@pytest.mark.parametrize("formula,want", FILLED)
def test_filled_down(sheets, formula, want):
    got = [r.x_error or r.x for r in compiler.fill_down(formula, sheets, "S", "x").orderBy("_row").collect()]
    assert got == [pytest.approx(w) if not isinstance(w, str) else w for w in want]


ARRAYS = [
    ("=FILTER(A1:B5,A1:A5>30)", [(40.0, "delta"), (50.0, "echo")]), ("=SORT(A1:B5,1,-1)", [(50.0, "echo"), (40.0, "delta"), (30.0, "charlie"), (20.0, "bravo"), (10.0, "alpha")]), ("=SORTBY(B1:B5,D1:D5)", [("echo",), ("delta",), ("charlie",), ("bravo",), ("alpha",)]), ("=TAKE(A1:A5,-2)", [(40.0,), (50.0,)]), ("=DROP(A1:B5,3,1)", [("delta",), ("echo",)]), ("=UNIQUE(VSTACK(A1:A2,A1:A3))", None), ("=CHOOSECOLS(A1:D5,-1,1)", None), ("=SEQUENCE(2,2,5,5)", [(5.0, 10.0), (15.0, 20.0)]), ("=WRAPROWS(A1:A5,2)", [(10.0, 20.0, 0, None), (30.0, 40.0, 0, None), (50.0, None, 1, "#N/A")]), ("=TOCOL(A1:A2)", [(10.0,), (20.0,)]), ("=ARRAYTOTEXT(A1:B2)", [("10, alpha;20, bravo",)]), ("=CHOOSEROWS(A1:A5,1,-1,1)", [(10.0,), (50.0,), (10.0,)]),
]


@pytest.mark.parametrize("formula,want", ARRAYS)
def test_arrays(sheets, formula, want):
    got = arrays.Arrays(sheets, "S").frame(formula).orderBy("_r").collect()
    assert [r["_r"] for r in got] == list(range(len(got)))
    if want is not None:
        assert [tuple(r)[1:] for r in got] == want


def test_parser_limits():
    with pytest.raises(p.FormulaError):
        p.parse("=" + "(" * 200 + "1" + ")" * 200)
    for bad in ("=1+", "=SUM(1", "=)", '="x', "=A1:"):
        with pytest.raises(p.FormulaError):
            p.parse(bad)
    assert [p.column_number(p.column_letters(k)) for k in range(0, 20_000, 7)] == list(range(0, 20_000, 7))


def test_rewriting():
    assert rewrite.filled("=A1+$B$2+B$3&\"A1\"", 2, 1) == "=B3+$B$2+C$3&\"A1\""
    assert rewrite.filled("=A1", -1, 0) == "=#REF!"
    assert rewrite.edited("=SUM($A$1:A9)+B2", "S", "S", "row", 3, 2) == "=SUM($A$1:A11)+B2"
    assert rewrite.edited("=A5+SUM(A4:A6)", "S", "S", "row", 4, 1, True) == "=#REF!+SUM(A4:A5)"
    assert rewrite.edited("=T!A5", "S", "S", "row", 0, 1) == "=T!A5"
    assert rewrite.renamed("=Old!A1+'Old'!B1+\"Old!\"", "Old", "New One") == "='New One'!A1+'New One'!B1+\"Old!\""
    assert rewrite.deleted_sheet("=Gone!A1+A1", "Gone") == "=#REF!+A1"
    assert [rewrite.cycle_anchor(a) for a in ("A1", "$A$1", "A$1", "$A1")] == ["$A$1", "A$1", "$A1", "A1"]


def test_graph():
    g = graph.Graph()
    for at, f in (((0, 1)), "=A1"), (((0, 2)), "=B1*2"), (((0, 3)), "=SUM(A1:C1)"):
        g.set(("S", *at), graph.boxes(f, "S"))
    order, cyclic = g.order([("S", 0, 0)])
    assert order == [("S", 0, 1), ("S", 0, 2), ("S", 0, 3)] and not cyclic
    g.set(("S", 0, 0), graph.boxes("=D1", "S"))
    assert g.circular(("S", 0, 0)) and len(g.order([("S", 0, 0)])[1]) == 4


def test_workbook(spark):
    book = Workbook({"S": spark.createDataFrame([(k, float(k), 0.0) for k in range(5)], "_row long, A double, B double")})
    assert book.value("=SUM(A:A)", "S") == 10.0
    book.put("S", "A1", "100")
    book.put("S", "B1", "=SUM(A1:A5)")
    book.put("S", "B2", "=B1*2")
    assert book.sheets["S"].edits[1, 1].value == 220.0
    assert book.put("S", "A1", "0") == [("S", 0, 0), ("S", 0, 1), ("S", 1, 1)]
    assert book.value("=SUM(B:B)", "S") == 30.0
    assert book.undo() and book.sheets["S"].edits[1, 1].value == 220.0
    assert book.redo() and book.sheets["S"].edits[1, 1].value == 20.0
    book.put("S", "A1", "=B2")
    assert book.sheets["S"].edits[0, 0].error == "#CIRC!"
    book.undo()
    book.insert_rows("S", 1, 2)
    assert book.sheets["S"].edits[0, 1].formula == "=SUM(A1:A7)" and (3, 1) in book.sheets["S"].edits
    book.sheets["S"].locked = True
    with pytest.raises(PermissionError):
        book.put("S", "A1", "1")
    book.sheets["S"].locked = False
    book.merge("S", "D1:E2")
    assert book.spill("S", "D2", "=SEQUENCE(2)") == "#SPILL!"
    assert book.spill("S", "G1", "=SEQUENCE(3)") == (3, 1)
    book.define("Rate", "=0.5")
    assert book.value("=Rate*2", "S") == 1.0
    with pytest.raises(ValueError):
        book.define("A1", "=1")


def test_goal_seek(spark):
    book = Workbook({"S": spark.createDataFrame([(0, 1.0, 3.0)], "_row long, A double, B double")})
    x, result, found = book.goal_seek("=A1^2+SUM(B:B)", "S", 12.0, "A1")
    assert found and x == pytest.approx(3.0, abs=1e-4) and result == pytest.approx(12.0, abs=1e-5)
    with pytest.raises(ValueError):
        book.goal_seek("=B1", "S", 1.0, "A1")


def test_typing_and_series():
    assert typed("=A1") == Edit(formula="=A1") and typed(" 12 ").value == 12.0 and typed("true").value is True and typed("x").value == "x" and typed("").value is None
    assert series([1, 3], 2) == [5, 7] and series([1, 2, 4], 4) == [1, 2, 4, 1]
