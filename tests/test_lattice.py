"""Types that all files agree on."""

import itertools

import pytest
from pyspark.sql import functions as F

from dugout.sources import csv_tree
from dugout.sources.lattice import agreed_schema, column_kinds, kind_of, type_of

KINDS = {"1": 1, "-7": 1, "0": 1, "2147483648": 2, "9223372036854775808": 4, "1.5": 4, ".5": 4, "1.": 4, "-3e7": 4, "TRUE": 8,
         "f": 8, "2023-02-28": 16, "2023-02-30": 32, "007": 32, "1d": 32, "NaN": 32, "x": 32, " 1": 32, "19:05:32": 32, "": 0, None: 0}


def test_kind_of_a_value(spark):
    df = spark.createDataFrame([(v,) for v in KINDS], "v string").select("v", kind_of(F.col("v")).alias("k"))
    assert {r["v"]: r["k"] for r in df.collect()} == KINDS


def test_every_join_holds_what_its_parts_hold():
    name = lambda kinds: type_of(kinds).simpleString()
    assert [name(k) for k in (0, 1, 2, 3, 4, 5, 8, 16, 32)] == [
        "string", "int", "bigint", "bigint", "double", "double", "boolean", "date", "string"]
    for a, b in itertools.combinations((1, 8, 16, 32), 2):
        assert name(a | b) == "string"


@pytest.mark.parametrize("order", [("a", "b", "c"), ("c", "a", "b"), ("b", "c", "a")])
def test_no_file_comes_first(spark, tmp_path, order):
    texts = ["Batter,Outs,Day,Flag,Empty\nAnn,1,2023-05-01,TRUE,\n", "Outs,Batter,Day,Flag\n2.5,Bob,2023-05-02,F\n",
             "Batter,Id,Day,Outs\n5,3000000000,soon,NA\n"]
    for name, text in zip(order, texts):
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "z.csv").write_text("###\nnothing\n")
    tree = csv_tree.read_csv_tree(spark, str(tmp_path), types="all")
    found = {f.name: f.dataType.simpleString() for f in tree.rows.schema.fields}
    assert found == {"batter": "string", "outs": "double", "day": "string", "flag": "boolean", "empty": "string", "id": "bigint"}
    rows = {r["batter"]: (r["outs"], r["day"], r["flag"], r["id"]) for r in tree.rows.collect()}
    assert rows == {"Ann": (1.0, "2023-05-01", True, None), "Bob": (2.5, "2023-05-02", False, None), "5": (None, "soon", None, 3 * 10**9)}
    assert {r["reason"] for r in tree.quarantine.collect()} == {"unknown layout"}


def test_kinds_of_two_tables_join(spark):
    names = ["x", "y"]
    parts = [[(names, ["1", "a"])], [(["y", "x"], ["2", "1.5"]), (names, [None, ""])]]
    frames = [spark.createDataFrame(p, "names array<string>, values array<string>") for p in parts]
    whole = column_kinds(frames[0].union(frames[1]))
    joined = column_kinds(frames[0]).union(column_kinds(frames[1])).groupBy("name").agg(
        F.bit_or("kinds").alias("kinds"), F.sum("filled").alias("filled"), F.min("place").alias("place"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, joined.collect())) == [("x", 5, 2, 0), ("y", 33, 2, 0)]
    assert agreed_schema(whole).simpleString() == "struct<x:double,y:string>"
