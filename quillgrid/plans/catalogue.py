"""The registered queries of the spreadsheet side, each with SQL that says the same for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formula import arrays, compiler
from ..functions import criteria, dates, numfmt, stats, text
from ..operators import charts, consolidate, dedupe, filters, lookups, pivot, positional, quality, reshape, search, sorting, subtotals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    """Register a function (t: name -> frame) under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 2):
    return F.round(c, n)


def rowed(df: DataFrame, key: str) -> DataFrame:
    return positional.numbered(df, [F.col(key)], "_row")


def loose(df: DataFrame) -> DataFrame:
    """Rows numbered in the files' order, with gaps: enough where a formula reads its own row only."""
    return df.withColumn("_row", F.monotonically_increasing_id())


# -- pivot

FLAGS = pivot.PivotSpec(["l_returnflag", "l_linestatus"], [("l_extendedprice", "sum", 2), ("l_discount", "average", 2), ("l_quantity", "count", None), ("l_quantity", "min", None), ("l_quantity", "max", None), ("l_quantity", "stddev", None)])


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_extendedprice as decimal(38,2))) as double) as sum_l_extendedprice,
round(avg(l_discount), 6) as average_l_discount, count(*) as count_l_quantity, min(l_quantity) as min_l_quantity, max(l_quantity) as max_l_quantity,
round(stddev_pop(l_quantity), 6) as stddev_l_quantity from lineitem group by 1, 2""")
def pivot_flag_status(t):
    out = pivot.pivot(t("lineitem"), FLAGS)
    return out.withColumns({c: r(F.col(c), 6) for c in ("average_l_discount", "stddev_l_quantity")})


@query("""select p_brand, p_type, count(*) as count_p_size, cast(sum(cast(p_retailprice as decimal(38,2))) as double) as sum_p_retailprice, min(p_retailprice) as min_p_retailprice, max(p_retailprice) as max_p_retailprice from part group by 1, 2""")
def pivot_multi_agg(t):
    return pivot.pivot(t("part"), pivot.PivotSpec(["p_brand", "p_type"], [("p_size", "count", None), ("p_retailprice", "sum", 2), ("p_retailprice", "min", None), ("p_retailprice", "max", None)]))


@query("select cast(sum(cast(o_totalprice as decimal(38,2))) as double) as sum_o_totalprice, count(*) as count_o_totalprice from orders")
def pivot_grand_total(t):
    return pivot.pivot(t("orders"), pivot.PivotSpec([], [("o_totalprice", "sum", 2), ("o_totalprice", "count", None)]))


@query("select event_type, count(*) as count_value, round(avg(value), 6) as average_value, min(value) as min_value, max(value) as max_value from events group by 1")
def pivot_events_by_type(t):
    out = pivot.pivot(t("events"), pivot.PivotSpec(["event_type"], [("value", "count", None), ("value", "average", None), ("value", "min", None), ("value", "max", None)]))
    return out.withColumn("average_value", r(F.col("average_value"), 6))


@query("""select coalesce(nullif(o_orderstatus, 'P'), '(blank)') as o_orderstatus, count(*) as "Count of o_totalprice", cast(sum(cast(o_totalprice as decimal(38,2))) as double) as "Sum of o_totalprice" from orders group by 1""")
def pivot_blank_bucket(t):
    df = t("orders").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return pivot.projection(df, pivot.PivotSpec(["o_orderstatus"], [("o_totalprice", "count", None), ("o_totalprice", "sum", 2)]))


# -- filter

@query("select count(*) as n, cast(sum(cast(l_quantity as decimal(38,0))) as bigint) as q from lineitem where lower(l_returnflag) in ('r', 'a')")
def filter_value_list(t):
    df = t("lineitem")
    return df.where(filters.value_list(df, "l_returnflag", ["r", "A"])).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 300000")
def filter_compare(t):
    df = t("orders")
    return df.where(filters.compare(df, "o_totalprice", ">=", 300000)).select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_size from part where p_size between 10 and 20")
def filter_between(t):
    df = t("part")
    return df.where(filters.between(df, "p_size", 10, 20)).select("p_partkey", "p_size")


@query("select p_partkey, p_name from part where lower(p_name) like '%red%'")
def filter_text_contains(t):
    df = t("part")
    return df.where(filters.text(df, "p_name", "RED")).select("p_partkey", "p_name")


@query("select count(*) as n from (select nullif(o_orderpriority, (select min(o_orderpriority) from orders)) as p from orders) where p is not null")
def filter_nonblank(t):
    df = t("orders")
    low = df.agg(F.min("o_orderpriority").alias("low"))
    blanked = df.join(F.broadcast(low)).withColumn("p", F.nullif(F.col("o_orderpriority"), F.col("low")))
    return blanked.where(filters.nonblank("p")).agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_quantity, l_discount + 0.0 as l_discount from lineitem where l_quantity > 45 and l_discount <= 0.02 and l_returnflag = 'R'")
def filter_and(t):
    df = t("lineitem")
    out, _ = filters.apply(df, filters.compare(df, "l_quantity", ">", 45), filters.compare(df, "l_discount", "<=", 0.02), filters.value_list(df, "l_returnflag", ["r"]))
    return out.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") + F.lit(0.0)).alias("l_discount"))


@query("select o_orderkey from orders where o_orderkey not between 100 and 5000 and o_orderkey not between 20000 and 30000")
def hide_rows(t):
    return filters.hide(t("orders").select("o_orderkey"), [(100, 5000), (20000, 30000)], "o_orderkey")


# -- criteria

def _scalar(t, name: str, key: str, formulas: dict[str, str], tables: dict[str, str] | None = None) -> DataFrame:
    """Scalar formulas over a table (its columns A, B, ... in order) side by side.

    Formulas over whole columns need no places without gaps, so rows are only numbered in the files' order.
    """
    loose = lambda n: t(n).withColumn("_row", F.monotonically_increasing_id())
    whole = not any(re.search(r"[A-Z]+\$?\d", f) for f in formulas.values())
    frames = {name: loose(name) if whole else rowed(t(name), key)} | {k: rowed(t(k), v) for k, v in (tables or {}).items()}
    sheets, out = compiler.Sheets(frames), None
    for alias, formula in formulas.items():
        one = compiler.evaluate(formula, sheets, name).select(F.coalesce(F.col("value").cast("string"), F.col("error")).alias(alias)) if alias.startswith("t_") else compiler.evaluate(formula, sheets, name).select(F.col("value").cast("double").alias(alias))
        out = one if out is None else out.crossJoin(one)
    return out


@query("select cast(count(*) filter (where p_name like '%ring') as double) as a, cast(count(*) filter (where p_name like '_ed%') as double) as b from part")
def countif_wildcard(t):
    return _scalar(t, "part", "p_partkey", {"a": '=COUNTIF(B:B,"*ring")', "b": '=COUNTIF(B:B,"?ed*")'})


@query("select round(sum(o_totalprice), 2) as a from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def sumifs_two(t):
    return _scalar(t, "orders", "o_orderkey", {"a": '=ROUND(SUMIFS(D:D,C:C,"f",D:D,">100000"),2)'})


@query("select round(avg(o_totalprice), 4) as a from orders where o_orderstatus <> 'O'")
def averageifs(t):
    return _scalar(t, "orders", "o_orderkey", {"a": '=ROUND(AVERAGEIFS(D:D,C:C,"<>O"),4)'})


@query("select cast(count(*) as double) as a from part where p_size >= 25 and p_type <> 'PROMO'")
def countifs_ge_ne(t):
    return _scalar(t, "part", "p_partkey", {"a": '=COUNTIFS(E:E,">=25",D:D,"<>promo")'})


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey), 2) as x from orders")
def sumif_per_group(t):
    df = loose(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    out = compiler.fill_down("=SUMIF(B:B,B1,C:C)", compiler.Sheets({"orders": df}), "orders", "x")
    return out.select("o_orderkey", r(F.col("x")).alias("x"))


@query("select c_mktsegment, count(*) as n from customer where lower(c_mktsegment) > 'c' group by 1")
def criteria_text_order(t):
    df = t("customer")
    return df.where(criteria.matches(F.col("c_mktsegment"), df.schema["c_mktsegment"].dataType, ">c")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


# -- sort, limit

@query("""select row_number() over (order by case when s is null then 1 else 0 end, s desc, o_totalprice, o_orderkey) - 1 as place, o_orderkey from (select o_orderkey, o_totalprice, lower(nullif(o_orderstatus, 'P')) as s from orders)""")
def sort_multikey_nulls_last(t):
    df = t("orders").select("o_orderkey", "o_totalprice", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    order = sorting.view_order(df, [("o_orderstatus", False), ("o_totalprice", True)], "o_orderkey")
    return reshape.ranked(df.withColumn(reshape.R, F.lit(0)), order).select(F.col(reshape.R).alias("place"), "o_orderkey")


@query("select (select o_totalprice from orders order by 1 desc limit 1 offset 9) as a, (select o_totalprice from orders order by 1 limit 1 offset 4) as b")
def large_small_k(t):
    return _scalar(t, "orders", "o_orderkey", {"a": "=LARGE(D:D,10)", "b": "=SMALL(D:D,5)"})


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def take_sorted(t):
    return t("orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select p_partkey, cast(rank() over (order by p_retailprice desc) as double) as x from part")
def rank_eq_desc(t):
    df = loose(t("part"))
    out = compiler.fill_down("=RANK.EQ(F1,F:F)", compiler.Sheets({"part": df}), "part", "x")
    return out.select("p_partkey", "x")


@query("select p_partkey, p_size from (select *, rank() over (order by p_size desc) as k from part) where k <= 10")
def top_n_with_ties(t):
    return sorting.top_with_ties(t("part"), "p_size", 10).select("p_partkey", "p_size")


# -- dedupe, unique

@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def dedupe_first_by_key(t):
    df = t("orders").select("o_custkey", "o_orderkey")
    return dedupe.remove_duplicates(df, ["o_custkey"], "o_orderkey")


@query("select min(p_brand) as p_brand, min(p_type) as p_type, min(p_partkey) as first_row from part group by lower(p_brand), lower(p_type)")
def unique_rows(t):
    return dedupe.unique(t("part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "p_partkey")


@query("select user_id, event_type, min(event_id) as first_row from events group by 1, 2 having count(*) = 1")
def unique_exactly_once(t):
    return dedupe.unique(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id", True)


@query("select count(*) as scanned, count(*) - count(distinct (l_partkey, l_suppkey)) as duplicates, count(distinct (l_partkey, l_suppkey)) as unique_rows from lineitem")
def dup_report(t):
    return dedupe.report(t("lineitem"), ["l_partkey", "l_suppkey"])


# -- subtotals, consolidate

RUNS = """with a as (select *, case when o_orderstatus is distinct from lag(o_orderstatus) over (order by o_orderkey) then 1 else 0 end as n from orders),
b as (select *, sum(n) over (order by o_orderkey) as run from a) """


@query(RUNS + """select cast(run as bigint) as run, any_value(o_orderstatus) as o_orderstatus, min(o_orderkey) as first_row, max(o_orderkey) as last_row, count(*) as rows, count(*) as n,
cast(sum(cast(o_totalprice as decimal(38,2))) as double) as total, min(o_totalprice) as least, max(o_totalprice) as greatest, round(avg(o_totalprice), 4) as mean from b group by 1""")
def subtotal_runs_orders(t):
    out = subtotals.subtotals(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", "o_orderkey", 2)
    return out.withColumn("mean", r(F.col("mean"), 4)).withColumn("run", F.col("run").cast("long"))


@query(RUNS + """select o_orderkey as at, 0 as is_subtotal, o_orderstatus as label, o_totalprice as value from orders union all
select max(o_orderkey), 1, any_value(o_orderstatus) || ' Sum', cast(sum(cast(o_totalprice as decimal(38,2))) as double) from b group by run""")
def subtotal_interleaved(t):
    return subtotals.interleaved(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", "Sum", "o_orderkey", 2)


@query("""with x as (select year(o_orderdate) as y, o_orderpriority as rk, o_orderstatus as ck, cast(sum(cast(o_totalprice as decimal(38,2))) as double) as v from orders where not (year(o_orderdate) = 1996 and o_orderstatus = 'P') group by 1, 2, 3)
select rk, ck, round(sum(v), 2) as value, count(*) as contributors, coalesce((select string_agg(cast(y2 as varchar), ',' order by y2) from range(1995, 2002) as r(y2) where y2 not in (select y from x as z where z.rk = x.rk and z.ck = x.ck)), '') as missing
from x group by rk, ck""")
def consolidate_by_region_year(t):
    df = t("orders").where(~((F.year("o_orderdate") == 1996) & (F.col("o_orderstatus") == "P")))
    sums = df.groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("rk"), F.col("o_orderstatus").alias("ck")).agg(F.sum(F.col("o_totalprice").cast("decimal(38,2)")).cast("double").alias("value"))
    long = sums.select(F.col("y").cast("string").alias("source"), (F.col("y") - 1995).alias("source_at"), "rk", F.lit(0).alias("row_at"), "ck", F.lit(0).alias("col_at"), "value")
    out = consolidate.consolidate(long, [str(y) for y in range(1995, 2002)])
    return out.select("rk", "ck", r(F.col("value")).alias("value"), "contributors", "missing")


# -- lookups

@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def vlookup_exact(t):
    df = loose(t("customer"))
    nation = rowed(t("nation"), "n_nationkey")
    out = compiler.fill_down("=VLOOKUP(C1,nation!$A$1:$B$25,2,FALSE)", compiler.Sheets({"customer": df, "nation": nation}), "customer", "n_name")
    return out.select("c_custkey", "n_name")


BANDS = "(values (0.0, 'low'), (50000.0, 'mid'), (150000.0, 'high'), (300000.0, 'top')) as b(k, name)"


def _bands(spark):
    return spark.createDataFrame([(0, 0.0, "low"), (1, 50000.0, "mid"), (2, 150000.0, "high"), (3, 300000.0, "top")], "_row long, k double, name string")


@query(f"select o_orderkey, b.name from orders asof join {BANDS} on o_totalprice >= b.k")
def vlookup_approx(t):
    df = loose(t("orders"))
    sheets = compiler.Sheets({"orders": df, "bands": _bands(df.sparkSession)})
    return compiler.fill_down("=VLOOKUP(D1,bands!$A$1:$B$4,2)", sheets, "orders", "name").select("o_orderkey", "name")


@query(f"select o_orderkey, coalesce((select name from {BANDS} where b.k >= o_totalprice order by b.k limit 1), 'none') as name from orders")
def xlookup_next_larger(t):
    df = loose(t("orders"))
    sheets = compiler.Sheets({"orders": df, "bands": _bands(df.sparkSession)})
    return compiler.fill_down('=XLOOKUP(D1,bands!$A$1:$A$4,bands!$B$1:$B$4,"none",1)', sheets, "orders", "name").select("o_orderkey", "name")


@query("select c_custkey, (select max_by(o_orderkey, o_orderkey) from orders where o_custkey = c_custkey) as o_orderkey from customer")
def xlookup_last_match(t):
    return lookups.exact(t("customer").select("c_custkey"), "c_custkey", t("orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("at")), "o_custkey", ["o_orderkey"], "at", True).select("c_custkey", "o_orderkey")


@query("select s_suppkey, cast(n_nationkey + 1 as double) as place, n_name from supplier join nation on s_nationkey = n_nationkey")
def index_match(t):
    df = loose(t("supplier"))
    sheets = compiler.Sheets({"supplier": df, "nation": rowed(t("nation"), "n_nationkey")})
    placed = compiler.fill_down("=MATCH(C1,nation!A:A,0)", sheets, "supplier", "place")
    named = compiler.fill_down("=INDEX(nation!B:B,MATCH(C1,nation!A:A,0))", sheets, "supplier", "n_name")
    return placed.select("s_suppkey", "place").join(named.select("s_suppkey", "n_name"), "s_suppkey")


@query(f"select o_orderkey, cast(nullif((select count(*) from {BANDS} where b.k >= o_totalprice), 0) as double) as place, case when o_totalprice > 300000 then '#N/A' end as error from orders")
def match_desc(t):
    df = loose(t("orders"))
    bands = _bands(df.sparkSession).withColumn("_row", 3 - F.col("_row"))
    out = compiler.fill_down("=MATCH(D1,bands!A:A,-1)", compiler.Sheets({"orders": df, "bands": bands}), "orders", "place")
    return out.select("o_orderkey", "place", F.col("place_error").alias("error"))


@query("select 'red*' as pattern, (select min(p_partkey) from part where lower(p_name) like 'red%') as match_row union all select '*widget', (select min(p_partkey) from part where lower(p_name) like '%widget')")
def match_wildcard(t):
    df = t("part")
    probes = df.sparkSession.createDataFrame([("red*",), ("*widget",)], "pattern string")
    return lookups.wildcard(probes, ["red*", "*widget"], df, "p_name", ["p_name"], "p_partkey").select("pattern", "match_row")


# -- statistics

@query("select l_returnflag, median(l_quantity) as median, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(quantile_cont(l_extendedprice, 0.25), 4) as q1, round(stddev_pop(l_quantity), 6) as sd_p, round(stddev_samp(l_quantity), 6) as sd_s, round(var_pop(l_quantity), 6) as var_p, round(var_samp(l_quantity), 6) as var_s from lineitem group by 1")
def spread_by_flag(t):
    df, q = t("lineitem"), F.col("l_quantity")
    spreads = df.groupBy("l_returnflag").agg(*[r(stats.spread(n, q)[0], 6).alias(a) for n, a in (("STDEV.P", "sd_p"), ("STDEV.S", "sd_s"), ("VAR.P", "var_p"), ("VAR.S", "var_s"))])
    prices = stats.quantiles(df, "l_extendedprice", {"p90": 0.9, "q1": 0.25}, ["l_returnflag"])
    middle = stats.quantiles(df, "l_quantity", {"median": 0.5}, ["l_returnflag"])
    return spreads.join(prices, "l_returnflag").join(middle, "l_returnflag").withColumns({"p90": r(F.col("p90"), 4), "q1": r(F.col("q1"), 4)})


@query("select (select median(o_totalprice) from orders) as a, (select round(quantile_cont(o_totalprice, 0.9), 4) from orders) as b, (select round(quantile_cont(o_totalprice, 0.75), 4) from orders) as c, (select round(stddev_samp(o_totalprice), 4) from orders) as d, (select round(var_pop(o_custkey), 4) from orders) as e")
def stats_scalar(t):
    return _scalar(t, "orders", "o_orderkey", {"a": "=MEDIAN(D:D)", "b": "=ROUND(PERCENTILE.INC(D:D,0.9),4)", "c": "=ROUND(QUARTILE.INC(D:D,3),4)", "d": "=ROUND(STDEV.S(D:D),4)", "e": "=ROUND(VAR.P(B:B),4)"})


@query("select event_type, mode from (select event_type, user_id as mode, row_number() over (partition by event_type order by count(*) desc, min(event_id)) as k from events group by 1, 2) where k = 1")
def mode_sngl_first_seen(t):
    return stats.mode(t("events"), F.col("user_id"), F.col("event_id"), ["event_type"]).select("event_type", "mode")


# -- arithmetic, logic

@query("select o_orderkey, case when o_totalprice < 0 then -floor(-o_totalprice * 0.1 * 10 + 0.5) / 10 else floor(o_totalprice * 0.1 * 10 + 0.5) / 10 end as a, floor(o_totalprice / 250) * 250 as b, ceil(o_totalprice / 250) * 250 as c from orders")
def round_floor_ceiling(t):
    df = loose(t("orders"))
    sheets = compiler.Sheets({"s": df})
    out = compiler.fill_down("=ROUND(D1*0.1,1)", sheets, "s", "a")
    out = compiler.fill_down("=FLOOR(D1,250)", compiler.Sheets({"s": out.drop("a_error")}), "s", "b")
    out = compiler.fill_down("=CEILING(D1,250)", compiler.Sheets({"s": out.drop("b_error")}), "s", "c")
    return out.select("o_orderkey", "a", "b", "c")


@query("select event_id, coalesce(round(value / nullif(user_id % 5, 0), 6), -1.0) as a, case when user_id % 5 = 0 then '#DIV/0!' end as b from events")
def iferror_div0(t):
    df = loose(t("events").select("event_id", "value", (F.col("user_id") % 5).alias("m")))
    good = compiler.fill_down("=IFERROR(ROUND(B1/C1,6),-1)", compiler.Sheets({"s": df}), "s", "a").drop("a_error")
    return compiler.fill_down("=B1/C1", compiler.Sheets({"s": good}), "s", "q").select("event_id", "a", F.col("q_error").alias("b"))


@query("select event_id, case when value - 50 >= 0 then round(sqrt(value - 50), 6) end as a, case when value - 50 < 0 then '#NUM!' end as e from events")
def sqrt_domain(t):
    df = loose(t("events").select("event_id", (F.col("value") - 50).alias("v")))
    out = compiler.fill_down("=SQRT(B1)", compiler.Sheets({"s": df}), "s", "a")
    return out.select("event_id", r(F.col("a"), 6).alias("a"), F.col("a_error").alias("e"))


@query("select p_partkey, case when p_size > 25 and p_type <> 'PROMO' then 'big' when p_size > 10 or p_type = 'PROMO' then 'mid' else 'small' end as x from part")
def nested_if(t):
    df = loose(t("part"))
    return compiler.fill_down('=IF(AND(E1>25,NOT(D1="promo")),"big",IF(OR(E1>10,D1="PROMO"),"mid","small"))', compiler.Sheets({"s": df}), "s", "x").select("p_partkey", "x")


# -- text

@query("select p_partkey, left(p_name, 3) as a, right(p_name, 4) as b, substring(p_name, 2, 3) as c, cast(length(p_name) as double) as d, upper(p_brand) as e from part")
def text_left_right_mid(t):
    df = t("part")
    return df.select("p_partkey", text.left(F.col("p_name"), F.lit(3)).alias("a"), text.right(F.col("p_name"), F.lit(4)).alias("b"), text.mid(F.col("p_name"), F.lit(2), F.lit(3)).alias("c"), F.char_length("p_name").cast("double").alias("d"), F.upper("p_brand").alias("e"))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as a, trim(regexp_replace('  ' || p_name || '   x ', ' +', ' ', 'g')) as b, p_name as c from part")
def proper_trim_clean(t):
    c = F.col("p_name")
    return t("part").select("p_partkey", text.proper(c).alias("a"), text.trim(F.concat(F.lit("  "), c, F.lit("   x "))).alias("b"), text.clean(F.concat(c, F.lit("\x07\n"))).alias("c"))


@query("select c_custkey, replace(c_name, '0', 'o') as a, case when length(c_name) - length(replace(c_name, '0', '')) >= 2 then regexp_replace(c_name, '^([^0]*0[^0]*)0', '\\1o') else c_name end as b from customer")
def substitute_nth(t):
    c = F.col("c_name")
    return t("customer").select("c_custkey", text.substitute(c, F.lit("0"), F.lit("o")).alias("a"), text.substitute(c, F.lit("0"), F.lit("o"), 2).alias("b"))


@query("select p_partkey, nullif(strpos(p_name, 'e'), 0) as a, nullif(strpos(lower(p_name), 'ed'), 0) as b from part")
def find_search(t):
    c = F.col("p_name")
    return t("part").select("p_partkey", text.find(F.lit("e"), c).cast("long").alias("a"), text.search("ED", c).cast("long").alias("b"))


@query("select n_regionkey, string_agg(n_name, ', ' order by n_nationkey) as names from nation group by 1")
def textjoin_group(t):
    pair = F.struct("n_nationkey", "n_name")
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda v: v["n_name"]), ", ").alias("names"))


@query("select o_orderkey, o_totalprice as a, -o_totalprice as b, o_totalprice / 100 as c from orders")
def value_parse(t):
    x = F.col("o_totalprice")
    money = F.concat(F.lit("$"), F.format_number(x, 2))
    return t("orders").select("o_orderkey", text.value(money).alias("a"), text.value(F.concat(F.lit("("), F.format_number(x, 2), F.lit(")"))).alias("b"), text.value(F.concat(F.format_string("%.2f", x), F.lit("%"))).alias("c"))


@query("select o_orderkey, format('{:,.2f}', o_totalprice) as a, strftime(o_orderdate, '%Y-%m-%d') as b from orders")
def text_format(t):
    from .. import cells

    return t("orders").select("o_orderkey", numfmt.text(F.col("o_totalprice"), "#,##0.00").alias("a"), numfmt.text(cells.serial(F.col("o_orderdate")), "yyyy-mm-dd").alias("b"))


# -- dates

@query("select o_orderkey, cast(cast(o_orderdate as date) + interval 2 month as date) as a, last_day(cast(o_orderdate as date) + interval 1 month) as b from orders")
def edate_eomonth(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", dates.edate(d, F.lit(2)).alias("a"), dates.eomonth(d, F.lit(1)).alias("b"))


@query("""select o_orderkey, date_diff('day', d, e) as days, (year(e) - year(d)) * 12 + month(e) - month(d) - case when day(e) < day(d) then 1 else 0 end as months,
cast(floor(((year(e) - year(d)) * 12 + month(e) - month(d) - case when day(e) < day(d) then 1 else 0 end) / 12) as bigint) as years
from (select o_orderkey, cast(o_orderdate as date) as d, date '2001-12-31' as e from orders)""")
def datedif_units(t):
    d, e = F.col("o_orderdate").cast("date"), F.lit("2001-12-31").cast("date")
    return t("orders").select("o_orderkey", *[dates.datedif(d, e, u).cast("long").alias(n) for u, n in (("D", "days"), ("M", "months"), ("Y", "years"))])


#: Weekdays up to and with a date, counted from Monday 1899-01-02.
_WEEKDAYS = "(date_diff('day', date '1899-01-02', {0}) // 7 * 5 + least(5, date_diff('day', date '1899-01-02', {0}) % 7 + 1))"


@query(f"""select o_orderkey, cast({_WEEKDAYS.format("(d + 30)")} - {_WEEKDAYS.format("(d - 1)")} - (date '1997-12-25' between d and d + 30)::int - (date '1998-01-01' between d and d + 30)::int as double) as n,
cast(-({_WEEKDAYS.format("d")} - {_WEEKDAYS.format("(d - 8)")}) as double) as back from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def networkdays(t):
    """Holidays are a range; one is given twice and one is a Saturday."""
    df = loose(t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")))
    days = df.sparkSession.createDataFrame([(0, "1997-12-25"), (1, "1997-12-25"), (2, "1998-01-01"), (3, "1998-01-03")], "_row long, day string").withColumn("day", F.col("day").cast("date"))
    out = compiler.fill_down("=NETWORKDAYS(B1,B1+30,holidays!$A$1:$A$4)", compiler.Sheets({"s": df, "holidays": days}), "s", "n").drop("n_error")
    return compiler.fill_down("=NETWORKDAYS(B1,B1-7)", compiler.Sheets({"s": out, "holidays": days}), "s", "back").select("o_orderkey", "n", "back")


@query("select o_orderkey, dayofweek(o_orderdate) + 1 as a, isodow(o_orderdate) as b, isodow(o_orderdate) - 1 as c from orders")
def weekday_kinds(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", *[dates.weekday(d, k).cast("long").alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))])


@query("select o_orderkey, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double) as s, cast(o_orderdate as date) as d from orders")
def serial_roundtrip(t):
    from .. import cells

    s = cells.serial(F.col("o_orderdate").cast("date"))
    return t("orders").select("o_orderkey", s.alias("s"), cells.from_serial(s).alias("d"))


# -- windows

@query("select o_orderkey, cast(sum(cast(o_totalprice as decimal(38,2))) over (order by o_orderkey rows unbounded preceding) as double) as x from orders")
def running_total(t):
    df = rowed(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    out = compiler.fill_down("=SUM($B$1:B1)", compiler.Sheets({"s": df}), "s", "x")
    return out.select("o_orderkey", r(F.col("x"), 2).alias("x"))


@query("select event_id, round(avg(value) over (order by event_id rows between current row and 2 following), 6) as x from events")
def moving_average(t):
    df = rowed(t("events").select("event_id", "value"), "event_id")
    return compiler.fill_down("=AVERAGE(B1:B3)", compiler.Sheets({"s": df}), "s", "x").select("event_id", r(F.col("x"), 6).alias("x"))


@query("select event_id, round(coalesce(lead(value) over (order by event_id), 0) - value, 6) as x from events")
def period_delta(t):
    df = rowed(t("events").select("event_id", "value"), "event_id")
    return compiler.fill_down("=B2-B1", compiler.Sheets({"s": df}), "s", "x").select("event_id", r(F.col("x"), 6).alias("x"))


# -- arrays

def _array(t, names: dict[str, tuple[str, list[str]]], home: str, formula: str) -> DataFrame:
    frames = {n: rowed(t(n).select(*([k] if k not in cols else []), *cols), k).select("_row", *cols) for n, (k, cols) in names.items()}
    return arrays.Arrays(compiler.Sheets(frames), home).frame(formula)


@query("select cast(n_nationkey as bigint) as _r, n_name from nation union all select 25 + r_regionkey, r_name from region")
def vstack(t):
    return _array(t, {"nation": ("n_nationkey", ["n_name"]), "region": ("r_regionkey", ["r_name"])}, "nation", "=VSTACK(nation!A:A,region!A:A)").select("_r", "n_name")


@query("select cast(n_nationkey as bigint) as _r, n_name as a, r_name as b, case when r_name is null then '#N/A' end as error from nation left join region on n_nationkey = r_regionkey")
def hstack_pad(t):
    out = _array(t, {"nation": ("n_nationkey", ["n_name"]), "region": ("r_regionkey", ["r_name"])}, "nation", "=HSTACK(nation!A:A,region!A:A)")
    return out.select("_r", F.col("c0_n_name").alias("a"), F.col("c1_r_name").alias("b"), "error")


@query("select row_number() over (order by n_nationkey, j) - 1 as _r, value from (select n_nationkey, 0 as j, cast(nullif(n_nationkey, 3) as double) as value from nation union all select n_nationkey, 1, cast(n_regionkey as double) from nation) where value is not null")
def tocol_ignore(t):
    df = rowed(t("nation").select("n_nationkey", F.nullif(F.col("n_nationkey"), F.lit(3)).cast("double").alias("a"), F.col("n_regionkey").cast("double").alias("b")), "n_nationkey")
    return reshape.tocol(reshape.from_sheet(df, ["a", "b"]), 1)


@query("select cast(n_nationkey // 4 as bigint) as _r, max(n_name) filter (where n_nationkey % 4 = 0) as c0, max(n_name) filter (where n_nationkey % 4 = 1) as c1, max(n_name) filter (where n_nationkey % 4 = 2) as c2, max(n_name) filter (where n_nationkey % 4 = 3) as c3, 4 - count(*) as pad, case when count(*) < 4 then '#N/A' end as error from nation group by 1")
def wraprows(t):
    return _array(t, {"nation": ("n_nationkey", ["n_name"])}, "nation", "=WRAPROWS(A:A,4)")


@query("select cast(0 as bigint) as _r, n_name from nation where n_nationkey = 24 union all select 1, n_name from nation where n_nationkey = 0 union all select 2, n_name from nation where n_nationkey = 24")
def chooserows_neg(t):
    return _array(t, {"nation": ("n_nationkey", ["n_name"])}, "nation", "=CHOOSEROWS(A:A,-1,1,25)")


@query("select i as _r, cast(10.0 + (i * 3) * 0.5 as double) as c0, cast(10.0 + (i * 3 + 1) * 0.5 as double) as c1, cast(10.0 + (i * 3 + 2) * 0.5 as double) as c2 from range(4) as r(i)")
def sequence_grid(t):
    return reshape.sequence(t("region").sparkSession, 4, 3, 10, 0.5)


@query("select row_number() over (order by p_retailprice, p_partkey) - 1 as _r, p_name, p_retailprice from part where p_size > 40 qualify _r < 30")
def filter_sort_compose(t):
    out = _array(t, {"part": ("p_partkey", ["p_name", "p_size", "p_retailprice"])}, "part", "=TAKE(SORT(FILTER(A:C,B:B>40),3),30)")
    return out.select("_r", "p_name", "p_retailprice")


@query("select row_number() over (order by min(n_nationkey)) - 1 as _r, n_regionkey from nation group by n_regionkey")
def unique_array(t):
    return _array(t, {"nation": ("n_nationkey", ["n_regionkey"])}, "nation", "=UNIQUE(A:A)")


@query("select round(sum(o_totalprice) * 1.1 / count(*), 4) as a, cast(11 as double) as b from orders")
def let_lambda(t):
    return _scalar(t, "orders", "o_orderkey", {"a": "=LET(total,SUM(D:D),n,COUNT(D:D),f,LAMBDA(x,x*1.1),ROUND(f(total)/n,4))", "b": "=LAMBDA(x,LAMBDA(y,x+y)(x+1))(5)"})


# -- charts

@query("""with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), h as (select cast(least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) as integer) as bin, count(*) as n from orders, e group by 1)
select cast(i as integer) as bin, round(lo + i * (hi - lo) / 20, 4) as lower, coalesce(n, 0) as n from range(20) as r(i) cross join e left join h on bin = i""")
def hist_20_bins(t):
    return charts.histogram(t("orders"), "o_totalprice", 20).select("bin", r(F.col("lower"), 4).alias("lower"), "n")


@query("""with e as (select min(l_quantity) as a, max(l_quantity) as b, min(l_extendedprice) as c, max(l_extendedprice) as d from lineitem)
select cast(least(floor((l_quantity - a) / (b - a) * 100), 99) as integer) as ix, cast(least(floor((l_extendedprice - c) / (d - c) * 70), 69) as integer) as iy, count(*) as n from lineitem, e group by 1, 2""")
def density_100x70(t):
    return charts.density(t("lineitem"), "l_quantity", "l_extendedprice")


@query("""with n as (select max(event_id) + 1 as n from events), b as (select event_id // cast(ceil(n / 800) as bigint) as bucket, event_id, value from events, n)
select distinct bucket, spot as "at", value from (select bucket, unnest([arg_min(event_id, struct_pack(v := value, i := event_id)), arg_min(event_id, struct_pack(v := -value, i := event_id))]) as spot from b group by bucket) join (select event_id, value from events) on spot = event_id""")
def decimate_800(t):
    return charts.decimate(t("events"), "value", "event_id", 800)


@query("select p_name as label, round(sum(p_retailprice) / count(*), 6) as value from part group by 1 order by sum(p_retailprice) / count(*) desc, 1 limit 40")
def category_top40(t):
    return charts.category(t("part"), "p_name", "p_retailprice", "Mean").select("label", r(F.col("value"), 6).alias("value"))


@query("select 3 * count(*) as cells, 2 * count(*) as numbers, round(sum(o_totalprice) + sum(o_custkey), 0) as total, least(min(o_totalprice), min(o_custkey)) as least, greatest(max(o_totalprice), max(o_custkey)) as greatest from orders")
def selection_stats(t):
    out = charts.selection_stats(t("orders"), ["o_custkey", "o_totalprice", "o_orderstatus"])
    return out.select("cells", "numbers", r(F.col("total"), 0).alias("total"), "least", "greatest")


# -- quality

@query("select l_returnflag, count(*) as n from lineitem where not l_quantity between 5 and 45 group by 1")
def validate_between(t):
    bad = quality.violations(t("lineitem"), [quality.Rule("l_quantity", "between", (5, 45))]).where("violation is not null")
    return bad.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("select p_partkey from part where lower(p_type) not in ('promo', 'small', 'large')")
def validate_oneof(t):
    return quality.violations(t("part"), [quality.Rule("p_type", "one_of", ("promo", "SMALL", "Large"))]).where("violation is not null").select("p_partkey")


@query("select p_partkey, p_brand from part where not regexp_full_match(p_brand, 'Brand#[1-3][1-5]')")
def validate_regex(t):
    return quality.violations(t("part"), [quality.Rule("p_brand", "regex", ("Brand#[1-3][1-5]",))]).where("violation is not null").select("p_partkey", "p_brand")


@query("select event_id, 'unique' as violation from events where user_id in (select user_id from events group by 1 having count(*) > 1)")
def validate_unique(t):
    return quality.violations(t("events"), [quality.Rule("user_id", "unique")]).where("violation is not null").select("event_id", "violation")


@query("select o_orderkey from orders where o_totalprice > 200000 or length(o_orderstatus) <> 1 order by 1 limit 100")
def circle_invalid(t):
    return quality.circle_invalid(t("orders"), [quality.Rule("o_totalprice", "compare", ("<=", 200000)), quality.Rule("o_orderstatus", "text_length", ("=", 1))], "o_orderkey", 100).select("o_orderkey")


@query("select p_partkey, round((p_retailprice - (select min(p_retailprice) from part)) / ((select max(p_retailprice) from part) - (select min(p_retailprice) from part)), 9) as position from part")
def condfmt_color_scale(t):
    return quality.scale_position(t("part"), "p_retailprice").select("p_partkey", r(F.col("position"), 9).alias("position"))


@query("select c_custkey, rank() over (order by c_acctbal desc) <= 25 as in_top from customer")
def condfmt_topn(t):
    return quality.top_bottom(t("customer"), "c_acctbal", 25).select("c_custkey", "in_top")


@query("select event_id, sign(value - 50) as a, sign(user_id - 75) as b from events")
def sparkline_winloss(t):
    df = t("events").select("event_id", (F.col("value") - 50).alias("x"), (F.col("user_id") - 75).alias("y"))
    s = quality.sparkline(["x", "y"], "winloss")
    return df.select("event_id", s[0].cast("byte").alias("a"), s[1].cast("byte").alias("b"))


# -- search

@query("select p_partkey as at, 'p_name' as \"column\", p_name as shown from part where lower(p_name) like '%green%' union all select p_partkey, 'p_type', p_type from part where lower(p_type) like '%green%'")
def search_cells(t):
    return search.search_cells(t("part"), search.Query("Green"), ["p_name", "p_type"], "p_partkey").select("at", "column", "shown")


@query("select doc_id from documents where regexp_matches(text, '\\b[A-Z][a-z]+ing\\b')")
def search_filter_rows(t):
    return search.filter_rows(t("documents"), search.Query(r"\b[A-Z][a-z]+ing\b", case=True, regex=True), ["text"]).select("doc_id")


@query("select p_partkey, regexp_replace(p_name, 'RED', 'ruby', 'gi') as p_name from part")
def replace_ci(t):
    out, _ = search.replace_all(t("part"), search.Query("RED"), "ruby", ["p_name"], "p_partkey")
    return out.select("p_partkey", "p_name")


@query("select p_partkey as at, p_name as old, regexp_replace(p_name, '(\\w+) (\\w+)', '\\2 \\1', 'g') as new from part where p_name <> regexp_replace(p_name, '(\\w+) (\\w+)', '\\2 \\1', 'g')")
def replace_regex_groups(t):
    _, edits = search.replace_all(t("part"), search.Query(r"(\w+) (\w+)", case=True, regex=True), "$2 $1", ["p_name"], "p_partkey")
    return edits.select("at", "old", "new")


# -- overlay, sheets

def _edited(t):
    from ..workbook import Edit, Workbook

    book = Workbook({"orders": rowed(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")})
    book.sheets["orders"].edits = {(0, 1): Edit(0.0), (2, 1): Edit(1000000.0), (4, 1): Edit(None)}
    return book


OVERLAY = "select o_orderkey, case row_number() over (order by o_orderkey) - 1 when 0 then 0.0 when 2 then 1000000.0 when 4 then null else o_totalprice end as o_totalprice from orders"


@query(f"select round(sum(o_totalprice), 2) as value from ({OVERLAY})")
def overlay_sum_corrected(t):
    return _edited(t).evaluate("=ROUND(SUM(B:B),2)", "orders").select("value")


@query(OVERLAY)
def overlay_view(t):
    return _edited(t).sheets["orders"].view().select("o_orderkey", "o_totalprice")


@query("select round(sum(c_acctbal), 2) as value from customer where c_nationkey < 3")
def three_d_sum(t):
    df = t("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    frames = {f"N{k}": rowed(df.where(F.col("c_nationkey") == k), "c_custkey") for k in range(3)}
    return compiler.evaluate("=ROUND(SUM(N0:N2!C:C),2)", compiler.Sheets(frames), "N0").select("value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pivot_flag_status"](spark, sf_dir)


