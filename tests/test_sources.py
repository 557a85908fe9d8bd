import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgrid import cells
from quillgrid.sources import columnar, csv, sidecar, xlsx
from quillgrid.streaming import follow
from quillgrid.workbook import Edit, with_row


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("made by hand\n\nid;name;flag;mix\r\n1;\"a;\"\"b\"\"\";TRUE;5\r\n2;\"two\nlines\";false;x\r\n3;;true;\r\n4;é\r\n".encode())
    d = csv.sniff(spark, f"file://{path}")
    assert (d.delimiter, d.quote, d.encoding, d.header) == (";", '"', "utf-8", True)
    df = csv.read(spark, f"file://{path}", d)
    rows = df.orderBy("_row").collect()
    assert df.columns == ["_row", "id", "name", "flag", "mix"]
    assert [r._row for r in rows] == [0, 1, 2, 3] and [r.id for r in rows] == [1, 2, 3, 4]
    assert rows[0].name == 'a;"b"' and rows[1].name == "two\nlines" and rows[2].name is None and rows[3].flag is None
    assert [r.flag for r in rows[:3]] == [True, False, True] and cells.is_mixed(df.schema["mix"].dataType)
    out = f"file://{tmp_path}/out"
    csv.export(df, out, single=True)
    again = csv.read(spark, out + "/*.csv", csv.Dialect())
    assert [tuple(r) for r in again.orderBy("_row").collect()] == [tuple(r) for r in rows]


@pytest.mark.parametrize("body,want", [(b"a,b\n1,2\n3,4\n", (",", "utf-8", True)), (b"\xff\xfea\x00\t\x00b\x00\n\x001\x00\t\x002\x00\n\x00", ("\t", "utf-16-le", True)), ("nom|prix\nété|1\n".encode("windows-1252") * 3, ("|", "windows-1252", True)), (b"1;2;3\n4;5;6\n", (";", "utf-8", False)), (b"a^b^c\nd^e^f\n", ("^", "utf-8", True))])
def test_sniff(body, want):
    d = csv.sniff_bytes(body)
    assert (d.delimiter, d.encoding, d.header) == want


def test_sniff_never_fails():
    rng = random.Random(5)
    for _ in range(200):
        body = bytes(rng.choice(b'a1,;\t|"\'\n\r \xff\x00') for _ in range(rng.randint(0, 120)))
        csv.preview(body, csv.sniff_bytes(body))


def test_names_and_clipboard():
    assert csv.unique_names(["a", "", "A", "a"]) == ["a", "B", "A_2", "a_3"]
    rows = [["a\tb", 'q"', None], ["x", "line\nend", "1"]]
    assert csv.from_tsv(csv.to_tsv(rows)) == [["a\tb", 'q"', ""], ["x", "line\nend", "1"]]


def sheet(spark):
    n = lambda tag, num=None, text=None, err=None: (tag, num, text, err)
    rows = [(0, 10.0, "alpha", True, n(0, 1.5)), (1, 20.5, "beta gamma", False, n(1, None, "<&> \"é\"")), (2, -3.0, None, True, n(3, None, None, "#DIV/0!")), (3, 0.0, "", None, None)]
    return spark.createDataFrame(rows, f"_row long, A double, B string, C boolean, D {cells.MIXED.simpleString()}")


def test_xlsx_round_trip(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    df = sheet(spark)
    xlsx.write(path, {"Data": df, "Sec & ond": df.select("_row", "A")}, {"Data": {(0, 0): "=5+5"}})
    got = xlsx.read(spark, f"file://{path}")
    assert list(got) == ["Data", "Sec & ond"]
    rows = got["Data"].orderBy("_row").collect()
    want = df.orderBy("_row").collect()
    assert [(r.A, r.C, r.D) for r in rows] == [(r.A, r.C, r.D) for r in want]
    assert [r.B for r in rows] == ["alpha", "beta gamma", None, ""]
    sheets, _ = xlsx.read_bytes((tmp_path / "b.xlsx").read_bytes())
    assert sheets["Data"][1, 0] == (10.0, "=5+5")
    with pytest.raises(ValueError):
        xlsx.write(str(tmp_path / "big.xlsx"), {"S": spark.range(xlsx.MOST_ROWS + 1).withColumnRenamed("id", "_row").withColumn("x", F.lit(1))})
    assert not (tmp_path / "big.xlsx").exists()


def test_hostile_files(spark, tmp_path):
    path = tmp_path / "c.xlsx"
    xlsx.write(str(path), {"S": sheet(spark)})
    body, rng = path.read_bytes(), random.Random(9)
    for cut in range(0, len(body), 97):
        with pytest.raises(xlsx.HostileFile):
            xlsx.read_bytes(body[:cut])
    for _ in range(150):  # refused or read, nothing else
        bad = bytearray(body)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            xlsx.read_bytes(bytes(bad))
        except (xlsx.HostileFile, ValueError, NotImplementedError):
            pass
    for name, content in (("../x", b"1"), ("/x", b"1"), ("bomb", b"\0" * (64 << 20)), ("xl/workbook.xml", b'<!DOCTYPE a [<!ENTITY b "c">]><workbook/>')):
        evil = tmp_path / "evil.xlsx"
        with zipfile.ZipFile(evil, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, content)
        with pytest.raises(xlsx.HostileFile):
            xlsx.read_bytes(evil.read_bytes())


def test_parquet_and_ipc(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 1.5, "x", 45366.5), (1, 2.0, None, None, 45367.0)], "_row long, whole double, part double, s string, day double")
    columnar.write_parquet(df, f"file://{tmp_path}/p", ["day"])
    raw = spark.read.parquet(f"file://{tmp_path}/p")
    assert [f.dataType.simpleString() for f in raw.schema] == ["bigint", "double", "string", "timestamp_ntz"]
    assert str(raw.first().day) == "2024-03-15 12:00:00"
    columnar.write_ipc(df, str(tmp_path / "a.arrow"))
    got = columnar.read_ipc(spark, f"file://{tmp_path}/a.arrow").orderBy("whole").collect()
    assert [tuple(r) for r in got] == [(1.0, 1.5, "x", 45366.5), (2.0, None, None, 45367.0)]
    with pytest.raises(TypeError, match="nested"):
        columnar.checked(spark.sql("select array(1) as nested"))
    with pytest.raises(TypeError, match="money"):
        columnar.checked(spark.sql("select cast(1 as decimal(5,2)) as money"))


def test_sidecar(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    spark.range(3).write.parquet(base)
    df, path = spark.read.parquet(base), f"file://{tmp_path}/base.edits.json"
    assert sidecar.load(spark, path, df) is None
    sidecar.save(spark, path, df, {"edits": sidecar.edits_to_json({(1, 0): Edit(5.0), (0, 0): Edit(None, "=A2", "#N/A")})})
    assert sidecar.edits_from_json(sidecar.load(spark, path, df)["edits"]) == {(0, 0): Edit(None, "=A2", "#N/A"), (1, 0): Edit(5.0)}
    spark.range(4).write.mode("overwrite").parquet(base)
    with pytest.raises(sidecar.StaleSidecar):
        sidecar.load(spark, path, spark.read.parquet(base))


def test_rows_follow_the_source(spark, tmp_path):
    spark.range(1000).repartition(1).sortWithinPartitions("id").write.parquet(f"file://{tmp_path}/r")
    df = with_row(spark.read.parquet(f"file://{tmp_path}/r"))
    assert df.where("id <> _row").count() == 0
    assert with_row(spark.range(50).selectExpr("id * 3 as k"), "k").where("k <> _row * 3").count() == 0


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("put A1 5\nnonsense\nGET B2\n")
    seen = []
    for _ in range(2):
        stream = follow.tail(spark, f"file://{folder}")
        follow.following_pivot(stream, lambda df, k: seen.extend(tuple(r) for r in df.collect()), f"file://{tmp_path}/cp", once=True).awaitTermination(60)
    assert sorted(seen) == [("get", "B2"), ("put", "A1 5")]  # the second start replays nothing
