"""Quoted line breaks read in splits, against a reader that sees whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from dugout.sources import csv_tree
from dugout.sources.quoted import block_states, open_after

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


@pytest.fixture
def splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def _cell(rng):
    return rng.choice(["", "x", "two\nlines", "\n", 'say "hi"', '"', '""\n"', "a,b", "1\r\n2", "plain text", "\n\n\n", ',"\n',
                       "long " * 40 + "\n" + "tail " * 30])


def _write(path, rng, rows, header=("a", "b", "c"), end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    data = [[_cell(rng) for _ in header] for _ in range(rows)]
    # A record of empty cells alone would be a blank line; the first cell keeps a sign.
    data = [[f"k{i}{row[0]}", *row[1:]] for i, row in enumerate(data)]
    writer.writerows(data)
    path.write_text(out.getvalue(), newline="")
    return [tuple(c or None for c in row) for row in data]


@pytest.mark.parametrize("size,end", [(64, "\n"), (300, "\r\n"), (5_000, "\n"), (128 << 20, "\n")])
def test_any_split_gives_the_same_records(spark, tmp_path, splits, size, end):
    rng = random.Random(size)
    expected = []
    for k in range(2):
        expected += _write(tmp_path / f"f{k}.csv", rng, 40, end=end)
    drifted = _write(tmp_path / "g.csv", rng, 20, header=("c", "z\nz", "a"), end=end)
    expected += [(row[2], None, row[0]) for row in drifted]
    splits(size)
    tree = csv_tree.read_csv_tree(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert sorted(map(str, map(tuple, tree.rows.collect()))) == sorted(map(str, expected))
    assert tree.quarantine.count() == 0


def test_one_file_is_cut_over_many_tasks(spark, tmp_path, splits):
    rng = random.Random(1)
    expected = _write(tmp_path / "f.csv", rng, 3_000)
    splits(10_000)
    states = block_states(spark, str(tmp_path), {}).collect()
    size = (tmp_path / "f.csv").stat().st_size
    assert len(states) >= size // 10_000 and sum(s["bytes"] for s in states) == size
    assert any(s["inside"] for s in states) and not any(s["unclosed"] for s in states)
    rows = csv_tree.read_csv_tree(spark, str(tmp_path), SCHEMA, multi_line=True).rows
    assert rows.rdd.getNumPartitions() > 1 and rows.count() == len(expected)


@pytest.mark.parametrize("size", [64, 128 << 20])
def test_a_quote_without_end_is_listed_line_by_line(spark, tmp_path, splits, size):
    (tmp_path / "bad.csv").write_text('a,b,c\n1,2,3\n"x\ny",5,6\n4,"open,6\n7,8,9\n10,11,12\n')
    (tmp_path / "good.csv").write_text('a,b,c\n"p\nq",2,3\n4,5\n')
    splits(size)
    tree = csv_tree.read_csv_tree(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert sorted(tuple(r) for r in tree.rows.collect()) == [("1", "2", "3"), ("p\nq", "2", "3"), ("x\ny", "5", "6")]
    found = sorted((r["reason"], r["record"]) for r in tree.quarantine.collect())
    assert found == [("ragged row", "4,5"), ("unclosed quote", "10,11,12"), ("unclosed quote", '4,"open,6'),
                     ("unclosed quote", "7,8,9")]


def test_quotes_inside_a_field_do_not_open_it(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b,c\n6\' 2",x,y\n1,5" bat,"z\nz"\n')
    rows = csv_tree.read_csv_tree(spark, str(tmp_path), SCHEMA, multi_line=True).rows
    assert sorted(tuple(r) for r in rows.collect()) == [("1", '5" bat', "z\nz"), ("6' 2\"", "x", "y")]


@pytest.mark.parametrize("line,inside,after", [
    ("", False, False), ("", True, True), ("a,b", True, True), ('"a', False, True), ('a"', True, False), ('a""', True, True),
    ('a"",b', True, True), ('"",b', False, False), ('"""', False, True), ('x"y', False, False), ('a","b', True, True),
    ('a","b"', True, False), ('"a","b', False, True), ('"a"b,"c"', False, False), (',"', False, True), ('"""a"""', False, False),
])
def test_state_after_a_line(line, inside, after):
    assert open_after(line, inside) is after


def test_empty_files_and_blank_lines(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b,c\n")
    (tmp_path / "f.csv").write_text('a,b,c\n\n1,,"  "\n   \n')
    tree = csv_tree.read_csv_tree(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert [tuple(r) for r in tree.rows.collect()] == [("1", None, "  ")] and tree.quarantine.count() == 0
    assert csv_tree.read_csv_tree(spark, str(tmp_path / "nowhere"), SCHEMA, multi_line=True).rows.count() == 0
