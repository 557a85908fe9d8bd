import random

import pytest

from quillgrid.formula import compiler
from quillgrid.operators import order, quality, svg, tables


def test_order_against_a_list(spark):
    rng = random.Random(2)
    o, rows = order.Order(30), list(range(30))
    fresh = 30
    for _ in range(60):
        at, n = rng.randrange(len(rows)), rng.randint(1, 3)
        n = min(n, len(rows) - at)
        what = rng.choice(["move", "insert", "delete", "move"])
        if what == "move":
            to = rng.choice([t for t in range(len(rows) + 1) if not at < t < at + n])
            taken, rest = rows[at : at + n], rows[:at] + rows[at + n :]
            k = to - n if to > at else to
            rows = rest[:k] + taken + rest[k:]
            o.move(at, n, to)
        elif what == "insert":
            rows = rows[:at] + list(range(fresh, fresh + n)) + rows[at:]
            fresh += n
            o.insert(at, n)
        elif len(rows) > 10:
            rows = rows[:at] + rows[at + n :]
            o.delete(at, n)
        assert [r for first, k in o.runs for r in range(first, first + k)] == rows
    df = spark.range(30).selectExpr("id as _row", "id * 10 as v")
    shown = order.displayed(df, o).orderBy("display_row").collect()
    assert [r._row for r in shown] == rows and [r.display_row for r in shown] == list(range(len(rows)))
    assert all(r.v == (r._row * 10 if r._row < 30 else None) for r in shown)


def test_order_refuses(monkeypatch):
    monkeypatch.setattr(order, "MOST_RUNS", 4)
    o = order.Order(10)
    o.move(5, 1, 2)
    with pytest.raises(order.TooManyRuns):
        o.move(8, 1, 1)


def test_table(spark):
    sheet = spark.createDataFrame([(0, "id", "x"), (1, "1", "a"), (2, "2", None), (3, "3", "b")], "_row long, id string, x string")
    t = tables.TableSpec("my table!", ["id", "x"], 0, 2, {"x": "text"}, [quality.Rule("id", "one_of", ("1",))])
    assert t.name == "my_table_" and t.frame(sheet).count() == 2
    assert [r.violation for r in t.violations(sheet).orderBy("_row").collect()] == [None, "one_of"]
    assert tables.TableSpec("1x", ["a", "a", ""], 0, 1).columns == ["a", "a_2", "C"]


def test_hlookup_and_indirect(spark):
    df = spark.createDataFrame([(0, "k1", "k2", "k3"), (1, "a", "b", "c"), (2, "B1", "x", "y")], "_row long, A string, B string, C string")
    s = compiler.Sheets({"S": df})
    get = lambda f: (lambda r: r["error"] or r["value"])(compiler.evaluate(f, s, "S").first())
    assert get('=HLOOKUP("K2",A1:C3,2,FALSE)') == "b" and get('=HLOOKUP("zz",A1:C3,2,FALSE)') == "#N/A" and get('=HLOOKUP("k1",A1:C3,4,FALSE)') == "#REF!"
    assert get('=INDIRECT("A"&2)') == "a" and get("=INDIRECT(A3)") == "k2" and get('=INDIRECT("nothing here")') == "#REF!" and get('=INDIRECT("Gone!A1")') == "#REF!"


def test_svg():
    out = svg.bars([("a<b", 3.0), ("c", -1.0)], title="t & u")
    assert out.count("<rect") == 2 and "a&lt;b" in out and "t &amp; u" in out
    assert svg.line([(0, 0), (1, 20), (2, 15)]).count(",") == 3
