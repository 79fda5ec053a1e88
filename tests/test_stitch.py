"""Records with line breaks in quoted cells, cut anywhere by splits, against a reader of whole files."""

import csv
import io
import random

import pytest

from leadloom.sources import contact_files as CF


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def read(spark, path):
    out = {}
    for r in CF.read_lines(spark, str(path), quoted=True).orderBy("file", "at").select("file", "text", CF._cells(CF.F.col("text")).alias("cells")).collect():
        out.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["text"], [c or "" for c in r["cells"]]))
    return out


def test_records_equal_a_reader_of_whole_files(spark, tmp_path, small_splits):
    """Random tables with quotes, commas and breaks in cells; every file is cut into splits of 150 bytes."""
    r = random.Random(11)
    want = {}
    for f in range(12):
        rows = [["".join(r.choice(["a", "b", " ", ",", "\n", '"', "\n", "xyz", ""]) for _ in range(r.randrange(8))) + str(i) for i in range(3)] for _ in range(60)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_ALL if f % 2 else csv.QUOTE_MINIMAL).writerows(rows)
        (tmp_path / f"{f}.csv").write_text(text.getvalue(), newline="")
        want[f"{f}.csv"] = rows
    (tmp_path / "none.csv").write_text("a,b,c\n" * 40)
    got = read(spark, tmp_path)
    assert {k: [c for _, c in v] for k, v in got.items()} == want | {"none.csv": [["a", "b", "c"]] * 40}


def test_odd_quotes(spark, tmp_path, small_splits):
    (tmp_path / "stray.csv").write_text("name,phone\n5\" pipe,1\nab\"c,2\n" + 'x,"q\nr",3\n' + "last,4\n")
    (tmp_path / "open.csv").write_text('a,1\n"closed\ncell",2\nb,"never closed\n' + "".join(f"row {i},{i}\n" for i in range(60)))
    (tmp_path / "double.csv").write_text('"a ""b""\nc ""d""",1\n"",2\n"""",3\n"\n",4\n')
    got = {k: [t for t, _ in v] for k, v in read(spark, tmp_path).items()}
    assert got["stray.csv"] == ["name,phone", '5" pipe,1', 'ab"c,2', 'x,"q\nr",3', "last,4"]
    assert got["open.csv"] == ["a,1", '"closed\ncell",2', 'b,"never closed', *[f"row {i},{i}" for i in range(60)]]
    assert got["double.csv"] == ['"a ""b""\nc ""d""",1', '"",2', '"""",3', '"\n",4']


def test_a_long_record_over_many_splits(spark, tmp_path, small_splits):
    cell = "\n".join(f"line {i}, with a comma" for i in range(200))
    (tmp_path / "long.csv").write_text(f'one,1\n"{cell}",2\nthree,3\n')
    got = read(spark, tmp_path)["long.csv"]
    assert [c for _, c in got] == [["one", "1"], [cell, "2"], ["three", "3"]]
    parts = CF.read_lines(spark, str(tmp_path)).select(CF.F.col("at.block").alias("b")).distinct().count()
    assert parts > 20


def test_no_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b\nc"\n5" pipe,x\n')
    plan = CF.read_lines(spark, str(tmp_path), quoted=True)._jdf.queryExecution().toString()
    assert "binaryfile" not in plan.lower()
