"""More registered queries, most of them through formulas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formula import compiler
from ..functions import stats
from ..operators import filters, order, positional, quality, reshape, search, sorting, tables
from ..sources import columnar, csv, shared
from ..workbook import Workbook, paste_special
from .catalogue import BANDS, ORACLE_SQL, QUERIES, _array, _bands, _scalar, loose, query, r, rowed

__all__ = ["ORACLE_SQL", "QUERIES"]


def _filled(df: DataFrame, key: str, formulas: dict[str, str], others: dict[str, DataFrame] | None = None, round_to: dict[str, int] | None = None) -> DataFrame:
    """The key column and each formula filled down; a name that ends in ``_error`` gives the formula's error instead."""
    out = df
    for name, formula in formulas.items():
        plain = name.removesuffix("_error")
        made = compiler.fill_down(formula, compiler.Sheets({"s": out, **(others or {})}), "s", plain)
        out = made.drop(plain) if name != plain else made.drop(f"{plain}_error")
    return out.select(key, *[r(F.col(n), (round_to or {})[n]).alias(n) if n in (round_to or {}) else F.col(n) for n in formulas])


# -- operators and scalar functions, filled down

@query("""select o_orderkey, o_totalprice * 2 + 1 as a, o_totalprice / 100 - 3 as b, o_totalprice / 100 as c, o_totalprice > 100000 as d, o_orderstatus || '-' || o_custkey as e, lower(o_orderstatus) = 'f' as f,
o_totalprice * o_totalprice as g from orders""")
def cell_operators(t):
    return _filled(loose(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")), "o_orderkey", {"a": "=D1*2+1", "b": "=D1/100-3", "c": "=D1%", "d": "=D1>100000", "e": '=C1&"-"&B1', "f": '=C1="f"', "g": "=-D1^2"})


@query("select event_id, abs(value - 50) as a, floor(value - 50) as b, round(exp(value / 100), 9) as c, round(ln(value), 9) as d, round(log10(value), 9) as e from events")
def abs_int_exp_log(t):
    """LN and LOG10 of what isn't positive are #NUM!, which no column of doubles holds: there -Infinity stands for 0 and NaN for less, as in SQL."""
    formulas = {"a": "=ABS(B1-50)", "b": "=INT(B1-50)", "c": "=EXP(B1/100)", "d": "=LN(B1)", "e": "=LOG10(B1)", "ln_error": "=LN(B1)", "log_error": "=LOG10(B1)", "number": "=ISNUMBER(B1)", "zero": "=B1=0"}
    out = _filled(loose(t("events").select("event_id", "value")), "event_id", formulas, round_to={"c": 9, "d": 9, "e": 9})
    shown = F.when(F.col("zero"), float("-inf")).otherwise(float("nan"))
    logs = {c: F.when(F.col("number") & (F.col(err) == "#NUM!"), shown).otherwise(F.col(c)) for c, err in (("d", "ln_error"), ("e", "log_error"))}
    return out.withColumns(logs).select("event_id", "a", "b", "c", "d", "e")


@query("""select event_id, u is null as a, u is not null as b, false as c, false as d, m = 0 as e, false as f, case when m = 0 then 2.0::double end as g, case when m <> 0 then '#N/A' end as h
from (select event_id, nullif(user_id, 3) as u, user_id % 5 as m from events)""")
def is_tests_and_error_type(t):
    df = loose(t("events").select("event_id", F.nullif(F.col("user_id"), F.lit(3)).alias("u"), (F.col("user_id") % 5).alias("m")))
    return _filled(df, "event_id", {"a": "=ISBLANK(B1)", "b": "=ISNUMBER(B1)", "c": "=ISTEXT(B1)", "d": "=ISNA(1/C1)", "e": "=ISERR(1/C1)", "f": "=ISERR(NA())", "g": "=ERROR.TYPE(1/C1)", "h_error": "=ERROR.TYPE(1/C1)"}).withColumnRenamed("h_error", "h")


@query("select p_partkey, upper(p_name) as a, lower(p_brand) as b, p_type || p_type as c, p_name[1] || 'xx' || p_name[5:] as d, p_brand || '/' || p_size as e from part")
def text_case_rept_replace(t):
    return _filled(loose(t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")), "p_partkey", {"a": "=UPPER(B1)", "b": "=LOWER(C1)", "c": "=REPT(D1,2)", "d": '=REPLACE(B1,2,3,"xx")', "e": '=CONCATENATE(C1,"/",E1)'}).withColumnRenamed("e_error", "e")


@query("select p_partkey, p_name || p_brand || p_type as a, p_name || '|' || p_brand || '|' || p_type as b from part")
def concat_textjoin_row(t):
    return _filled(loose(t("part").select("p_partkey", "p_name", "p_brand", "p_type")), "p_partkey", {"a": "=CONCAT(B1:D1)", "b": '=TEXTJOIN("|",TRUE,B1:D1)'})


@query("select (select string_agg(n_name, ', ' order by n_nationkey) from nation) as t_a, (select string_agg(n_name, '' order by n_nationkey) || string_agg(n_regionkey::varchar, '' order by n_nationkey) from nation) as t_b, '#VALUE!' as t_c")
def concat_textjoin_range(t):
    return _scalar(t, "nation", "n_nationkey", {"t_a": '=TEXTJOIN(", ",TRUE,B1:B25)', "t_b": "=CONCAT(B1:C25)", "t_c": "=CONCATENATE(B1:B25)"})


@query("""select o_orderkey, year(d)::double as a, month(d)::double as b, day(d)::double as c, date_diff('day', date '1899-12-30', make_date(year(d), month(d), 1) + interval 1 month)::double as d, date_diff('day', date '2000-01-01', d)::double as e
from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def date_parts(t):
    df = loose(t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")))
    return _filled(df, "o_orderkey", {"a": "=YEAR(B1)", "b": "=MONTH(B1)", "c": "=DAY(B1)", "d": "=DATE(YEAR(B1),MONTH(B1)+1,1)", "e": "=DAYS(B1,DATE(2000,1,1))"}).withColumn("e", F.col("e").cast("double"))


@query("select event_id, hour(ts)::double as a, minute(ts)::double as b, second(ts)::double as c from events")
def time_parts(t):
    return _filled(loose(t("events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))), "event_id", {"a": "=HOUR(B1)", "b": "=MINUTE(B1)", "c": "=SECOND(B1)"})


@query("select n_nationkey, ['af', 'am', 'as', 'eu', 'me'][n_regionkey + 1] as a from nation")
def choose(t):
    return _filled(loose(t("nation").select("n_nationkey", "n_regionkey")), "n_nationkey", {"a": '=CHOOSE(B1+1,"af","am","as","eu","me")'})


@query("select o_orderkey, position(left(lower(o_orderstatus), 1) in lower(o_orderpriority)) as z, case when z = 0 then '#VALUE!' end as e, nullif(z, 0)::double as a from orders")
def search_cell_needle(t):
    out = _filled(loose(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")), "o_orderkey", {"a": "=SEARCH(B1,C1)", "e_error": "=SEARCH(B1,C1)"})
    return out.select("o_orderkey", F.coalesce(F.col("a"), F.lit(0.0)).cast("long").alias("z"), F.col("e_error").alias("e"), "a")


@query("select o_orderkey, case when o_totalprice < 0 then null else cast(o_totalprice as varchar) end is not null as a, o_totalprice::decimal(18,2)::varchar is not null as b from orders")
def text_fraction(t):
    """A fraction code shows the plain number."""
    out = _filled(loose(t("orders").select("o_orderkey", "o_totalprice")), "o_orderkey", {"x": '=TEXT(B1,"# ?/?")', "y": '=B1&""'})
    return out.select("o_orderkey", (F.col("x") == F.col("y")).alias("a"), F.col("x").isNotNull().alias("b"))


# -- arguments that are cells

def _settings(spark, *values) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in enumerate(values)], "_row long, a string")


def _numbers(spark, *values) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "_row long, a double")


def _with(t, name: str, others: dict[str, DataFrame], formulas: dict[str, str]) -> DataFrame:
    sheets, out = compiler.Sheets({name: loose(t(name)), **others}), None
    for alias, formula in formulas.items():
        one = compiler.evaluate(formula, sheets, name).select(F.col("value").alias(alias))
        out = one if out is None else out.crossJoin(one)
    return out


@query("""select (select cast(count(*) as double) from orders where o_totalprice > 100000) as a, (select round(sum(o_totalprice), 2) from orders where o_orderstatus = 'F') as b,
(select round(avg(o_totalprice), 4) from orders where o_totalprice > 100000 and o_orderstatus <> 'O') as c, (select cast(count(*) as double) from orders where o_orderpriority like '1%') as d""")
def criteria_from_cells(t):
    crit = _settings(t("region").sparkSession, ">100000", "f", "<>O", "1*")
    return _with(t, "orders", {"crit": crit}, {"a": "=COUNTIF(D:D,crit!A1)", "b": "=ROUND(SUMIF(C:C,crit!A2,D:D),2)", "c": '=ROUND(AVERAGEIFS(D:D,D:D,">"&100*1000,C:C,crit!A3),4)', "d": "=COUNTIF(F:F,crit!A4)"})


@query("""with c(k, op, x) as (values (0, '>', 100000.0), (1, '<=', 50000.0), (2, '>=', 300000.0), (3, '<', 0.0)) select cast(k as bigint) as k,
(select cast(count(*) as double) from orders where case op when '>' then o_totalprice > x when '<=' then o_totalprice <= x when '>=' then o_totalprice >= x else o_totalprice < x end) as a,
(select coalesce(round(sum(o_totalprice), 2), 0) from orders where case op when '>' then o_totalprice > x when '<=' then o_totalprice <= x when '>=' then o_totalprice >= x else o_totalprice < x end) as b from c""")
def sumif_filled_operators(t):
    spark = t("region").sparkSession
    crit = spark.createDataFrame([(0, ">100000"), (1, "<=50000"), (2, ">=3e5"), (3, "<0")], "_row long, c string").withColumn("k", F.col("_row"))
    out = _filled(crit, "k", {"a": "=COUNTIF(orders!D:D,A1)", "b": "=SUMIF(orders!D:D,A1,orders!D:D)"}, {"orders": loose(t("orders"))}, {"b": 2})
    return out


@query("""with c(k, re) as (values (0, '^red.*'), (1, '.*widget$'), (2, '^blue gadget$'), (3, '^.e.*')) select cast(k as bigint) as k, (select cast(count(*) as double) from part where regexp_full_match(lower(p_name), re)) as a,
(select round(sum(p_retailprice), 2) from part where regexp_full_match(lower(p_name), re)) as b from c""")
def sumif_filled_wildcards(t):
    spark = t("region").sparkSession
    crit = spark.createDataFrame([(0, "red*"), (1, "*Widget"), (2, "Blue Gadget"), (3, "?e*")], "_row long, c string").withColumn("k", F.col("_row"))
    out = _filled(crit, "k", {"a": "=COUNTIF(part!B:B,A1)", "b": "=SUMIF(part!B:B,A1,part!F:F)"}, {"part": loose(t("part"))})
    return out.withColumn("b", F.when(F.col("a") > 0, r(F.col("b"))))


@query("select (select o_totalprice from orders order by 1 desc limit 1 offset 6) as a, (select round(quantile_cont(o_totalprice, 0.35), 4) from orders) as b, (select n_name from nation where n_nationkey = 7) as c")
def parameters_from_cells(t):
    spark = t("region").sparkSession
    others = {"k": _numbers(spark, 7, 0.35, 2), "nation": rowed(t("nation"), "n_nationkey")}
    return _with(t, "orders", others, {"a": "=LARGE(D:D,k!A1)", "b": "=ROUND(PERCENTILE.INC(D:D,k!A2),4)", "c": "=VLOOKUP(k!A1,nation!A:B,k!A3,FALSE)"})


# -- lookups

@query("select p_partkey, case when lower(p_type) >= 'small' then 3.0::double when lower(p_type) >= 'medium' then 2.0 when lower(p_type) >= 'large' then 1.0 end as place from part")
def match_approx_text(t):
    names = t("region").sparkSession.createDataFrame([(0, "LARGE"), (1, "Medium"), (2, "small")], "_row long, a string")
    return _filled(loose(t("part").select("p_partkey", "p_type")), "p_partkey", {"place": "=MATCH(B1,names!A:A,1)"}, {"names": names})


@query(f"select o_orderkey, (select count(*) from {BANDS} where b.k <= o_totalprice)::double * 10 as x from orders")
def hlookup_approx(t):
    bands = t("region").sparkSession.createDataFrame([(0, 0.0, 50000.0, 150000.0, 300000.0), (1, 10.0, 20.0, 30.0, 40.0)], "_row long, a double, b double, c double, d double")
    return _filled(loose(t("orders").select("o_orderkey", "o_totalprice")), "o_orderkey", {"x": "=HLOOKUP(B1,bands!$A$1:$D$2,2)"}, {"bands": bands})


@query("select (select n_name from nation where n_nationkey = 4) as t_a, '#VALUE!' as t_b, '#REF!' as t_c, '#VALUE!' as t_d, (select n_name from nation where n_nationkey = 2) as t_e, (select n_name from nation where n_nationkey = 6) as t_f")
def index_forms(t):
    return _scalar(t, "nation", "n_nationkey", {"t_a": "=INDEX(A1:C25,5,2)", "t_b": "=INDEX(A1:C25,0,2)", "t_c": "=INDEX(A1:C25,26,2)", "t_d": "=INDEX(A1:C25,3)", "t_e": "=INDEX(A3:C3,2)", "t_f": '=INDIRECT("B"&(3+4))'})


# -- statistics

@query("select event_id, max(value) over w as a, min(value) over w as b, round(stddev_samp(value) over w, 6) as c, round(median(value) over w, 6) as d from events window w as (order by event_id rows between current row and 4 following)")
def moving_extremes(t):
    df = rowed(t("events").select("event_id", "value"), "event_id")
    return _filled(df, "event_id", {"a": "=MAX(B1:B5)", "b": "=MIN(B1:B5)", "c": "=STDEV.S(B1:B5)", "d": "=MEDIAN(B1:B5)"}, round_to={"c": 6, "d": 6})


@query("select event_type, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.99), 6) as q99, min(value) as q0, max(value) as q100 from events group by 1")
def quantiles_by_group(t):
    out = stats.quantiles(t("events"), "value", {"q50": 0.5, "q99": 0.99, "q0": 0.0, "q100": 1.0}, ["event_type"])
    return out.withColumns({"q50": r(F.col("q50"), 6), "q99": r(F.col("q99"), 6)})


@query("select event_id, round(sum(value) over (order by event_id rows unbounded preceding), 2) as a, count(*) over (order by event_id rows unbounded preceding)::double as b from events")
def running_average(t):
    return _filled(rowed(t("events").select("event_id", "value"), "event_id"), "event_id", {"a": "=ROUND(AVERAGE(B$1:B1)*COUNT(B$1:B1),2)", "b": "=COUNT(B$1:B1)"})


# -- arrays

PARTS = {"part": ("p_partkey", ["p_name", "p_size", "p_retailprice"])}
NATIONS = {"nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])}


@query("select cast(0 as bigint) as _r, 'none' as value")
def filter_if_empty(t):
    return _array(t, PARTS, "part", '=FILTER(A:C,B:B>1000000,"none")').select("_r", "value")


@query("select cast(0 as bigint) as _r, '#N/A' as error")
def filter_empty(t):
    return _array(t, PARTS, "part", "=FILTER(A:C,B:B>1000000)").select("_r", "error")


@query("select row_number() over (order by p_size desc, p_retailprice, p_partkey) - 1 as _r, p_name from part")
def sortby_two_keys(t):
    return _array(t, {"part": ("p_partkey", ["p_name", "p_size", "p_retailprice"])}, "part", "=SORTBY(A:A,B:B,-1,C:C,1)")


@query("select row_number() over (order by n_nationkey) - 1 as _r, n_regionkey, n_nationkey from nation where n_nationkey >= 20")
def drop_choosecols(t):
    out = _array(t, NATIONS, "nation", "=DROP(CHOOSECOLS(A:C,3,1),20)")
    return out.select("_r", F.col("c0").alias("n_regionkey"), F.col("c1").alias("n_nationkey"))


@query("select row_number() over (order by n_nationkey desc) - 1 as _r, n_name from (select * from nation order by n_nationkey limit 4)")
def take_negative_sorted(t):
    return _array(t, NATIONS, "nation", "=CHOOSECOLS(SORT(TAKE(A:C,4),1,-1),2)").select("_r", F.col("c0").alias("n_name"))


@query("select cast(0 as bigint) as _r, " + ", ".join(f"(select n_name from nation where n_nationkey = {k}) as c{k}" for k in range(25)) + "")
def torow(t):
    return _array(t, {"nation": ("n_nationkey", ["n_name"])}, "nation", "=TOROW(A:A)")


@query("select cast(n_nationkey as bigint) as _r, n_regionkey as a, n_nationkey as b from nation")
def sort_by_column(t):
    """Columns by their second row: region of nation 1 against its key."""
    return _array(t, {"nation": ("n_nationkey", ["n_nationkey", "n_regionkey"])}, "nation", "=SORT(A:B,2,1,TRUE)").select("_r", F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"))


@query("select cast(n_nationkey as bigint) as _r, n_nationkey, n_regionkey from nation")
def unique_by_column(t):
    return _array(t, {"nation": ("n_nationkey", ["n_nationkey", "n_regionkey"])}, "nation", "=UNIQUE(HSTACK(A:B,A:A),TRUE)").select("_r", F.col("c0_n_nationkey").alias("n_nationkey"), F.col("c0_n_regionkey").alias("n_regionkey"))


@query("select cast(i as bigint) as _r, " + ", ".join(f"coalesce((select n_nationkey from nation where n_nationkey = i * 7 + {j}), -1) as c{j}" for j in range(7)) + " from range(4) as r(i)")
def wraprows_pad(t):
    return _array(t, {"nation": ("n_nationkey", ["n_nationkey"])}, "nation", "=WRAPROWS(A:A,7,-1)")


@query("select cast(i as bigint) as _r, " + ", ".join(f"coalesce((select n_name from nation where n_nationkey = i + {j} * 7), 'none') as c{j}" for j in range(4)) + " from range(7) as r(i)")
def wrapcols_pad(t):
    return _array(t, {"nation": ("n_nationkey", ["n_name"])}, "nation", '=WRAPCOLS(A:A,7,"none")')


@query("select cast(0 as bigint) as _r, '{' || string_agg(n_nationkey || ', ' || n_name, ';' order by n_nationkey) || '}' as text from nation")
def arraytotext_verbose(t):
    return _array(t, {"nation": ("n_nationkey", ["n_nationkey", "n_name"])}, "nation", "=ARRAYTOTEXT(A:B,TRUE)")


@query("select cast(j as bigint) as _r, " + ", ".join(f"case j when 0 then (select n_regionkey from nation where n_nationkey = {k}) else {k} end as c{k}" for k in range(25)) + " from range(2) as r(j)")
def transposed(t):
    df = reshape.from_sheet(rowed(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey"), ["n_regionkey", "n_nationkey"])
    return reshape.transpose(df)


# -- order of rows, outline, search, tables

@query("""with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as p, count(*) over () as n from orders),
d as (select o_orderkey, case when p < 5 then p + 95 when p < 100 then p - 5 else p end as p from o) select o_orderkey, cast(case when p >= 1000 then p - 100 + 3 when p >= 50 then p + 3 else p end as bigint) as display_row from d where not p between 900 and 999""")
def rows_moved_inserted_deleted(t):
    df = rowed(t("orders").select("o_orderkey"), "o_orderkey")
    at = order.Order(df.count())
    at.move(0, 5, 100)
    at.delete(900, 100)
    at.insert(50, 3)
    return order.displayed(df, at).where("o_orderkey is not null").select("o_orderkey", "display_row")


@query("select o_orderkey from orders where not (o_orderkey between 100 and 199) and not (o_orderkey between 500 and 999)")
def outline_collapsed(t):
    groups = [(100, 199, 1, True), (300, 399, 1, False), (500, 999, 2, True)]
    return filters.collapse(t("orders").select("o_orderkey"), groups, row="o_orderkey")


@query("with h as (select p_partkey, row_number() over (order by p_partkey) as k, count(*) over () as n from part where lower(p_name) like '%green%') select p_partkey as here, coalesce((select p_partkey from h as b where b.k = h.k + 1), (select min(p_partkey) from h)) as next from h")
def next_match(t):
    """Each match and the one after it, around the end."""
    hits = search.search_cells(t("part"), search.Query("green"), ["p_name"], "p_partkey").select(F.col("at").alias("here"))
    n = hits.count()
    placed = positional.numbered(hits, [F.col("here")], "_row")
    steps = placed.sparkSession.range(n).select(F.col("id").alias("_row"), F.when(F.col("id") + 1 < n, F.col("id") + 1).otherwise(F.lit(search.step(n - 1, n))).alias("to"))
    return placed.join(steps, "_row").join(placed.select(F.col("_row").alias("to"), F.col("here").alias("next")), "to").select("here", "next")


@query("select row_number() over (order by p_size desc, p_partkey) - 1 as place, p_partkey from part")
def header_clicked_sort(t):
    state = sorting.header_click(sorting.header_click([], "p_size"), "p_size")
    df = t("part").select("p_partkey", "p_size")
    return reshape.ranked(df.withColumn(reshape.R, F.lit(0)), sorting.view_order(df, state, "p_partkey")).select(F.col(reshape.R).alias("place"), "p_partkey")


# -- workbooks

@query("select round(300000.0 / count(*), 6) as x, true as found from orders")
def goal_seek(t):
    df = loose(t("orders").select("o_orderkey", "o_totalprice"))
    spark = df.sparkSession
    book = Workbook({"orders": df, "aim": spark.createDataFrame([(0, 1.0)], "_row long, a double")})
    x, _, found = book.goal_seek("=A1*COUNT(orders!B:B)", "aim", 300000.0, "A1")
    return spark.createDataFrame([(round(x, 6), found)], "x double, found boolean")


@query("select o_orderkey, o_totalprice + 100 as o_totalprice from orders")
def paste_special_add(t):
    df = rowed(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return paste_special(df, df.select("_row", F.lit(100.0).alias("value")), "o_totalprice", "add").select("o_orderkey", "o_totalprice")


# -- sources: what is written is read again

@query("select o_orderkey::double as o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def csv_round_trip(t):
    df = rowed(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey")
    path = shared.new_path(df.sparkSession)
    csv.export(df, path)
    return csv.read(df.sparkSession, path).drop("_row")


@query("select p_partkey::double as p_partkey, p_name, p_retailprice from part")
def parquet_round_trip(t):
    df = t("part").select("p_partkey", "p_name", "p_retailprice")
    path = shared.new_path(df.sparkSession)
    columnar.write_parquet(loose(df), path)
    return columnar.read_parquet(df.sparkSession, path).select("p_partkey", "p_name", "p_retailprice")


@query("select p_partkey, p_size not between 1 and 40 as bad from part")
def range_validation(t):
    df = t("part").select("p_partkey", "p_size")
    return df.select("p_partkey", (~quality.allowed(df, [quality.Rule("p_size", "between", (1, 40))])).alias("bad"))



@query("""select o_orderkey, 'o_totalprice' as "column" from (select *, row_number() over (order by o_orderkey) - 1 as p from orders) where p between 11 and 500 and o_totalprice > 200000""")
def structured_table(t):
    """A table over a part of the sheet: its header stands on row 10."""
    df = rowed(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    spec = tables.TableSpec("big orders", ["o_orderkey", "o_totalprice"], 10, 500, {}, [quality.Rule("o_totalprice", "compare", ("<=", 200000))])
    return spec.violations(df).where("violation is not null").select("o_orderkey", F.lit("o_totalprice").alias("column"))
