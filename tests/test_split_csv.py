"""CSV with quoted newlines: read by many byte ranges equals the one-task read."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.sources import split_csv
from abode.sources.files import read_listings_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType())])


def texts(rng):
    yield from ("", None, "plain", 'with "quotes"', "two\nlines", 'a\n"b"\n\nc', '"', '""', "comma, and\n, more", "گفت \n«نه»", "x" * 300, "\n" * 5, 'line\n' * 40)
    for _ in range(60):
        yield "".join(rng.choice('ab, "\n\n') for _ in range(rng.randrange(40)))


def write(path, rows, header=("id", "title", "text", "size")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    rows = [(i, f"t{i}", text, i / 4) for i, text in enumerate(texts(rng))]
    (tmp_path / "data").mkdir()
    write(tmp_path / "data/a.csv", rows)
    write(tmp_path / "data/b.csv", [(1000 + i, text, "id,title,text,size", None) for i, text in enumerate(texts(rng))])
    write(tmp_path / "data/c.csv", [])
    (tmp_path / "data/d.csv").write_text('id,title,text,size\n7,"only one,\nopen at the end",x,1.5')
    return str(tmp_path / "data")


@pytest.mark.parametrize("block, bound", [(37, 1 << 21), (200, 0), (1 << 20, 1 << 21)])
def test_many_ranges_equal_one_task(spark, folder, monkeypatch, block, bound):
    monkeypatch.setattr(split_csv, "BROADCAST_BLOCKS", bound)
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    want = sorted(map(repr, whole.collect()))
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = read_listings_csv(spark, folder, SCHEMA)
        lines = split_csv._lines(spark, folder)
        blocks = lines.select("file", "block").distinct().count()
        assert sorted(map(repr, got.collect())) == want and len(want) > 140
        assert blocks > 100 if block == 37 else blocks >= 4
        inside = split_csv.block_states(lines).where("inside").count()
        assert (inside > 10) == (block == 37) or block == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)


def test_index_column_line_ends_and_missing_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b',id,title,text,size\r\n0,1,"a\r\nb",c,2.5\r\n\r\n1,2,d\r\n')
    rows = {r.id: r for r in read_listings_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect()}
    assert rows[1].title.replace("\r", "") == "a\nb" and (rows[1].text, rows[1].size) == ("c", 2.5)
    assert (rows[2].title, rows[2].text, rows[2].size) == ("d", None, None) and len(rows) == 2


def test_one_quoted_record_over_many_ranges(spark, tmp_path):
    body = "\n".join(f"row {i}" for i in range(500))
    write(tmp_path / "x.csv", [(1, "a", body, 1), (2, "b", "c", 2)])
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = read_listings_csv(spark, str(tmp_path / "x.csv"), SCHEMA).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert rows[0].text == body and tuple(rows[1]) == (2, "b", "c", 2.0)
