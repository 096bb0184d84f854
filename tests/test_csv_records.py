"""CSV files read in many splits: quoted line breaks, doubled and stray quotes."""

import csv
import io
import random

import pytest

from ledgerlens.sources.csv_records import csv_records
from ledgerlens.sources.metrics_csv import read_metrics

NASTY = ['a\nb', 'x,y', 'he said "no"', '"', '""', 'line\r\nbreak', '5" pipe', '"\n"', ',\n,', 'plain', 'é\n\n\nü', ' "q', '",\n"x"']


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _file(path, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def test_nasty_rows_survive_any_split(spark, tmp_path, small_splits):
    rng = random.Random(7)
    rows = [["id", "text", "n"]] + [[str(i), "".join(rng.choices(NASTY, k=rng.randint(1, 3))), str(i * 2)] for i in range(120)]
    for end in ("\n", "\r\n"):
        path = tmp_path / f"t{len(end)}.csv"
        _file(path, rows, end)
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
        got = [(str(r["id"]), r["text"], r["n"]) for r in read_metrics(spark, str(path)).orderBy("_row_id").collect()]
        assert got == [(i, t, int(n)) for i, t, n in rows[1:]]


def test_stray_quotes_and_blank_lines(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text('\n\nsize,name\n5" pipe,a\n\n6"" pipe,"b\n\nc"\n"7""",d\n,\n8,"e" f\n9,g')
    got = [tuple(r) for r in read_metrics(spark, str(path)).orderBy("_row_id").select("size", "name").collect()]
    assert got == [('5" pipe', "a"), ('6"" pipe', "b\n\nc"), ('7"', "d"), (None, None), ("8", '"e" f'), ("9", "g")]


def test_folder_clashing_names_and_empty(spark, tmp_path, small_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        _file(folder / f"p{k}.csv", [["_file", "_at", "file"]] + [[f"{k}-{i}\nx", str(i), "f"] for i in range(9)])
    rows = read_metrics(spark, str(folder)).orderBy("_row_id").collect()
    assert [r["_file"] for r in rows] == [f"{k}-{i}\nx" for k in range(3) for i in range(9)]
    assert [r["_at"] for r in rows] == [i for _ in range(3) for i in range(9)] and rows[0]["file"] == "f"
    _file(tmp_path / "head.csv", [["a", "b"]])
    head = read_metrics(spark, str(tmp_path / "head.csv"))
    assert head.columns == ["a", "b", "_row_id"] and head.count() == 0


def test_a_field_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i}, "quoted"' for i in range(80))
    path = tmp_path / "t.csv"
    _file(path, [["a", "b"], ["1", long], ["2", "z"]])
    assert [tuple(r) for r in read_metrics(spark, str(path)).orderBy("_row_id").select("a", "b").collect()] == [(1, long), (2, "z")]
    assert csv_records(spark, str(path)).count() == 3
