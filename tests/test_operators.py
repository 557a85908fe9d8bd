import datetime

import pytest
from pyspark.sql import functions as F

from quillgrid import cells
from quillgrid.functions import criteria, dates, text
from quillgrid.operators import charts, consolidate, dedupe, filters, lookups, pivot, positional, quality, search, sorting, subtotals
from quillgrid.plans import catalogue
from quillgrid.workbook import paste_special

MIXED = cells.MIXED.simpleString()
CELLS = [(0, (0, 2.0, None, None)), (1, (1, None, "b", None)), (2, None), (3, (2, 1.0, None, None)), (4, (3, None, None, "#N/A")), (5, (0, float("nan"), None, None)), (6, (1, None, "  ", None)), (7, (0, -1.0, None, None)), (8, (1, None, "A", None))]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(CELLS, f"_row long, m {MIXED}")


def column(df, name="m"):
    return [r[name] for r in df.collect()]


def test_view_sort(mixed):
    up = [r._row for r in sorting.sort(mixed, [("m", True)], "_row").collect()]
    assert up == [7, 0, 5, 8, 1, 3, 4, 2, 6]
    down = [r._row for r in sorting.sort(mixed, [("m", False)], "_row").collect()]
    assert down == [4, 3, 1, 8, 5, 0, 7, 2, 6]
    assert sorting.header_click([], "a") == [("a", True)] and sorting.header_click([("a", True)], "a") == [("a", False)] and sorting.header_click([("a", False)], "a") == []
    assert sorting.header_click([("a", True)], "b", True) == [("a", True), ("b", True)]


def test_filters_on_mixed(mixed):
    hit = lambda c: [r._row for r in mixed.where(c).orderBy("_row").collect()]
    assert hit(filters.value_list(mixed, "m", ["2", "a", "", "#N/A"])) == [0, 2, 4, 8]
    assert hit(filters.compare(mixed, "m", "<", 3)) == [0, 7]
    assert hit(filters.text(mixed, "m", "TRUE", whole=True)) == [3]
    assert hit(filters.blank("m")) == [2]
    kept, cut = filters.apply(mixed, filters.nonblank("m"), budget=3)
    assert kept.count() == 3 and cut
    assert [r._row for r in filters.collapse(mixed, [(0, 3, 1, True), (5, 6, 2, False)]).orderBy("_row").collect()] == [4, 5, 6, 7, 8]


@pytest.mark.parametrize("criterion,rows", [(">1", [0]), ("<>b", [0, 2, 3, 5, 6, 7, 8]), ("=", [2]), ("TRUE", [3]), ("a*", [8]), (">a", [1]), (2, [0]), ("~*", [])])
def test_criteria(mixed, criterion, rows):
    kind = cells.kinds(mixed)["m"]
    assert [r._row for r in mixed.where(criteria.matches(F.col("m"), kind, criterion)).orderBy("_row").collect()] == rows


def test_number_text(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.5), (2, 1e15), (3, 0.00001), (4, -2.25), (5, 123456789012.5)], "k int, x double")
    assert column(df.orderBy("k").select(cells.number_text(F.col("x")).alias("m"))) == ["1", "1.5", "1E15", "1E-5", "-2.25", "1.234568E11"]


def test_csv_field(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([" 12 ", "", "1e3", "TRUE", "false", "x", "1x", "-", "+5", "1d", None])], "k int, t string")
    got = [r.m and (r.m.tag, r.m.num, r.m.str) for r in df.orderBy("k").select(cells.field(F.col("t")).alias("m")).collect()]
    assert got == [(0, 12.0, None), None, (0, 1000.0, None), (2, 1.0, None), (2, 0.0, None), (1, None, "x"), (1, None, "1x"), (1, None, "-"), (0, 5.0, None), (1, None, "1d"), None]


def test_serials(spark):
    """All days of a long range there and back, and the day that never was."""
    days = spark.range(61, 2_958_466, 997).select(F.col("id").cast("double").alias("s"))
    assert days.where(cells.serial(cells.from_serial(F.col("s"))) != F.col("s")).count() == 0
    assert spark.range(1).select(cells.from_serial(F.lit(1.0)).alias("m")).first().m == datetime.date(1900, 1, 1)
    assert spark.range(1).select(cells.serial(F.lit("1900-02-28").cast("date")).alias("m")).first().m == 59.0


def test_pivot_blank_and_totals(spark):
    df = spark.createDataFrame([("r1", 10.0), ("r2", 5.0), ("r1", 20.0), ("r2", 7.0), ("r1", 3.0), (None, None)], "region string, amount double")
    spec = pivot.PivotSpec(["region"], [("amount", "sum", None), ("amount", "count", None)])
    assert [tuple(r) for r in pivot.projection(df, spec).collect()] == [("r1", 33.0, 3), ("r2", 12.0, 2), ("(blank)", None, 1)]
    binding = pivot.PivotBinding(lambda: df, spec, auto=True)
    before = binding.result
    binding.note_edit()
    assert binding.result is not before
    parts = [tuple(r) for n in (1, 16) for r in pivot.pivot(df.repartition(n), pivot.PivotSpec([], [("amount", "sum", 2)])).collect()]
    assert parts == [(45.0,), (45.0,)]


def test_dedupe(spark):
    df = spark.createDataFrame([(0, 0.0, "a"), (1, -0.0, "a"), (2, float("nan"), "A"), (3, float("nan"), "A"), (4, None, "a")], "_row long, x double, s string")
    assert sorted(r._row for r in dedupe.remove_duplicates(df, ["x", "s"]).collect()) == [0, 2, 4]
    assert tuple(dedupe.report(df, ["x", "s"]).first()) == (5, 2, 3)
    assert sorted(r.first_row for r in dedupe.unique(df, ["s"]).collect()) == [0]
    assert dedupe.unique(df.limit(2), ["s"], exactly_once=True).count() == 0


@pytest.mark.parametrize("blocks", [2, 64])
def test_runs_across_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(positional, "BLOCKS", blocks)
    keys = ["a"] * 70 + ["b"] * 3 + [None] * 2 + ["a"] * 25
    df = spark.createDataFrame([(k, s, 1.0) for k, s in enumerate(keys)], "_row long, key string, v double").repartition(5)
    got = [(r.run, r.key, r.first_row, r.last_row, r.total) for r in subtotals.subtotals(df, "key", "v").orderBy("run").collect()]
    assert got == [(1, "a", 0, 69, 70.0), (2, "b", 70, 72, 3.0), (3, None, 73, 74, 2.0), (4, "a", 75, 99, 25.0)]
    made = subtotals.interleaved(df, "key", "v").where("is_subtotal = 1").orderBy("at").collect()
    assert [r.label for r in made] == ["a Sum", "b Sum", "Sum", "a Sum"]


def test_running_and_moving(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(200)], "_row long, v double").repartition(7)
    got = positional.running_total(df, [F.col("_row")], "v", "t").orderBy("_row").collect()
    assert [r.t for r in got] == [k * (k + 1) / 2 for k in range(200)]
    down = positional.running_total(df, [F.col("_row").desc()], "v", "t").orderBy("_row").collect()
    assert down[0].t == 19900 and down[199].t == 199
    moved = positional.moving(df, "_row", {"s": ("sum", "v", -1, 1), "n": ("value", "v", 2, 2)}, size=16).orderBy("_row").collect()
    assert [r.s for r in moved[1:-1]] == [3.0 * k for k in range(1, 199)] and moved[0].s == 1 and moved[-1].s == 397
    assert [r.n for r in moved] == [float(k + 2) for k in range(198)] + [None, None]


def test_consolidate(spark):
    make = lambda rows: spark.createDataFrame(rows, "_row long, key string, Widgets double, Gadgets double")
    blocks = {"Q1": make([(0, "East", 10.0, 1.0), (1, "West", 20.0, 2.0)]), "Q2": make([(0, "East", 100.0, 5.0), (1, "West", 200.0, 6.0)]), "Q3": make([(0, "East", 1000.0, 7.0)])}
    long = consolidate.long_form({k: (f, "key", ["Widgets", "Gadgets"]) for k, f in blocks.items()})
    got = {(r.rk, r.ck): (r.value, r.contributors, r.missing) for r in consolidate.consolidate(long, list(blocks)).collect()}
    assert got == {("East", "Widgets"): (1110.0, 3, ""), ("East", "Gadgets"): (13.0, 3, ""), ("West", "Widgets"): (220.0, 2, "Q3"), ("West", "Gadgets"): (8.0, 2, "Q3")}


def test_lookups(spark):
    table = spark.createDataFrame([(0, 10.0, "a"), (1, 20.0, "b"), (2, 20.0, "c"), (3, 30.0, "d")], "_row long, k double, v string")
    probes = spark.createDataFrame([(x,) for x in (5.0, 10.0, 15.0, 20.0, 99.0, None)], "p double")
    got = lambda f: {r.p: (r.v, r.error) for r in f.collect()}
    assert got(lookups.exact(probes, "p", table, "k", ["v"])) == {5.0: (None, "#N/A"), 10.0: ("a", None), 15.0: (None, "#N/A"), 20.0: ("b", None), 99.0: (None, "#N/A"), None: (None, "#N/A")}
    assert got(lookups.exact(probes, "p", table, "k", ["v"], last=True))[20.0] == ("c", None)
    assert got(lookups.approximate(probes, "p", table, "k", ["v"])) == {5.0: (None, "#N/A"), 10.0: ("a", None), 15.0: ("a", None), 20.0: ("c", None), 99.0: ("d", None), None: (None, "#N/A")}
    assert got(lookups.approximate(probes, "p", table, "k", ["v"], up=True)) == {5.0: ("a", None), 10.0: ("a", None), 15.0: ("b", None), 20.0: ("b", None), 99.0: (None, "#N/A"), None: (None, "#N/A")}


def test_charts(spark):
    df = spark.createDataFrame([(k, float(k % 10), "spike" if k == 640 else "x") for k in range(1000)], "_row long, v double, s string").withColumn("v", F.when(F.col("_row") == 640, 210.0).otherwise(F.col("v")))
    bins = charts.histogram(df, "v", 7).orderBy("bin").collect()
    assert len(bins) == 7 and sum(r.n for r in bins) == 1000 and bins[-1].n == 1 and bins[3].n == 0
    assert 210.0 in [r.value for r in charts.decimate(df, "v", buckets=20).collect()]
    assert charts.histogram(df.select(F.lit(5.0).alias("v")), "v", 4).agg(F.sum("n")).first()[0] == 1000
    assert charts.ticks(0, 100) == [0, 20, 40, 60, 80, 100] and charts.log_ticks(3, 2000) == [1, 10, 100, 1000, 10000]
    assert [r.label for r in charts.category(df, "s", "v", "Max").collect()] == ["spike", "x"]


def test_selection_with_text_and_blanks(spark):
    df = spark.createDataFrame([(1, 2.5, "P", True), (2, None, "7", None), (None, 1.5, None, False)], "a long, b double, c string, d boolean")
    got = charts.selection_stats(df, ["a", "b", "c"]).first()
    assert (got.cells, got.numbers, got.total) == (6, 4, 7.0)  # "7" is text
    got = charts.selection_stats(df, ["a", "d"]).first()
    assert (got.cells, got.numbers, got.total, got.least) == (4, 4, 4.0, 0.0)


def test_selection_query_counts_text(spark):
    orders = spark.createDataFrame([(1, 1.0, "O"), (2, 2.0, None)], "o_custkey long, o_totalprice double, o_orderstatus string")
    f = next(c.cell_contents for c in catalogue.QUERIES["selection_stats"].__closure__ if callable(c.cell_contents))
    assert tuple(f(lambda name: orders).first())[:3] == (5, 4, 6.0)


def test_value_query_parses_percent(spark, monkeypatch):
    orders = spark.createDataFrame([(1, 12.5)], "o_orderkey long, o_totalprice double")
    f = next(c.cell_contents for c in catalogue.QUERIES["value_parse"].__closure__ if callable(c.cell_contents))
    monkeypatch.setattr(text, "value", lambda s: F.when(s.endswith("%"), -1.0).otherwise(12.5))
    assert f(lambda name: orders).first().c == -1.0


def test_quality(spark, mixed):
    rules = [quality.Rule("m", "between", (0, 5)), quality.Rule("m", "regex", ("[",)), quality.Rule("m", "one_of", ("a", "2"))]
    got = {r._row: r.violation for r in quality.violations(mixed, rules[:2]).collect()}
    assert got[0] is None and got[1] == "between" and got[2] is None and got[4] == "between"
    assert quality.violations(mixed, [quality.Rule("m", "any", allow_empty=False)]).where("violation is not null").count() == 2
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (3, None)], "_row long, x double")
    assert [r._row for r in quality.circle_invalid(df, [quality.Rule("x", "unique")]).collect()] == [1, 2]
    out = quality.scale_position(df, "x").withColumn("c", quality.color_scale(F.col("position"), [(0, 0, 0), (255, 255, 255)])).orderBy("_row").collect()
    assert [r.c for r in out] == ["#000000", "#ffffff", "#ffffff", None]
    assert quality.top_bottom(df, "x", 1).where("in_top").count() == 2


def test_search_replace(spark):
    df = spark.createDataFrame([(0, "Red fox", 2.0), (1, "infrared", 5.0), (2, None, None)], "_row long, s string, x double")
    hits = search.search_cells(df, search.Query("red"), ["s", "x"])
    assert [r["at"] for r in search.first_hits(hits, 1)[0].collect()] == [0] and hits.count() == 2
    assert search.search_cells(df, search.Query("2"), ["s", "x"]).first().column == "x"
    out, edits = search.replace_all(df, search.Query("RED"), "$1x\\", ["s"])
    assert [r.s for r in out.orderBy("_row").collect()] == ["$1x\\ fox", "infra$1x\\", None] and edits.count() == 2
    out, edits = search.replace_all(df, search.Query("infrared", whole=True), "ir", ["s"])
    assert [r.new for r in edits.collect()] == ["ir"]
    assert search.step(2, 3) == 0 and search.step(0, 3, back=True) == 2
    assert search.suggestions(df, "s", "in") == ["infrared"]


def test_dates_and_globs(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("m")).first().m
    d = lambda s: F.lit(s).cast("date")
    assert get(dates.networkdays(d("2024-03-02"), d("2024-03-03"))) == 0
    assert get(dates.networkdays(d("2024-03-04"), d("2024-03-08"), ["2024-03-05", "2024-03-05", "2024-03-09"])) == 4
    assert get(dates.datedif(d("2023-02-15"), d("2024-01-10"), "YM")) == 10 and get(dates.datedif(d("2023-02-15"), d("2024-01-10"), "MD")) == 26
    assert text.has_glob("a*") and not text.has_glob("a") and text.glob_regex("~*a?") == r"\*a."


def test_paste_special(spark):
    target = spark.createDataFrame([(0, 6.0), (1, None), (2, 9.0)], "_row long, x double")
    source = spark.createDataFrame([(0, 2.0), (1, 4.0), (2, 0.0)], "_row long, value double")
    assert [r.x for r in paste_special(target, source, "x", "div").orderBy("_row").collect()] == [3.0, 0.0, 9.0]


def test_plans(spark):
    """Shapes that hold at scale: pushed filters, pruned columns, no cross join, no window in one task over rows."""
    from quillgrid.plans import catalogue

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    d = "/root/testdata/sf0.001"
    p = plan(catalogue.QUERIES["filter_compare"](spark, d))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice,300000.0)]" in p and "o_orderpriority" not in p
    p = plan(catalogue.QUERIES["pivot_flag_status"](spark, d))
    assert p.count("Exchange") == 1 and "l_comment" not in p
    p = plan(catalogue.QUERIES["take_sorted"](spark, d))
    assert "TakeOrderedAndProject" in p
