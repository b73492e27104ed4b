"""CSV: what types may lose nothing, ragged lines, encodings, and files with line feeds inside fields cut into many blocks."""

import csv
import io
import random

import pytest
from millrace.functions.errors import OperationError
from millrace.sources import files


def put(tmp_path, text, name="a.csv"):
    (tmp_path / name).write_bytes(text.encode() if isinstance(text, str) else text)
    return str(tmp_path / name)


@pytest.mark.parametrize("values,kind,want", [
    (["1", "-2", ""], "bigint", [1, -2, None]), (["007", "8"], "string", ["007", "8"]), (["+5"], "string", ["+5"]), (["12345678901234567890"], "string", ["12345678901234567890"]),
    (["1.50", "2"], "double", [1.5, 2.0]), (["12d", "5f"], "string", ["12d", "5f"]), (["0.1234567890123456789"], "string", ["0.1234567890123456789"]), (["0.30000000000000004"], "double", [0.30000000000000004]),
    (["9007199254740993", "0.5"], "string", ["9007199254740993", "0.5"]), (["y", "n"], "string", ["y", "n"]), (["t", "f"], "string", ["t", "f"]), (["true", "False"], "boolean", [True, False]),
    (["2024-01"], "string", ["2024-01"]), (["2024-02-30"], "string", ["2024-02-30"]), (["2024-1-2"], "string", ["2024-1-2"]), (["2024-01-02 tail"], "string", ["2024-01-02 tail"]),
    (["1e3", "NaN"], "double", None), ([" 1"], "string", [" 1"]), (["1", "x"], "string", ["1", "x"]), (["", ""], "string", [None, None]), (["-0"], "double", [-0.0]),
])
def test_types_lose_nothing(spark, tmp_path, values, kind, want):
    out = files.read_csv(spark, put(tmp_path, "v,k\n" + "".join(f"{v},k\n" for v in values)))
    assert dict(out.dtypes)["v"] == kind
    if want:
        assert [r["v"] for r in out.collect()] == want


def test_dates_and_times(spark, tmp_path):
    path = put(tmp_path, "d,t,both,z\n2024-01-31,2024-01-31 10:20,2024-01-31,2024-01-31T10:20:30Z\n2024-02-29,2024-01-31T10:20:30.123456,2024-01-31 01:02:03,x\n")
    assert [k for _, k in files.read_csv(spark, path).dtypes] == ["date", "timestamp_ntz", "timestamp_ntz", "string"]
    assert {k for _, k in files.read_csv(spark, path, try_parse_dates=False).dtypes} == {"string"}


def test_ragged_lines(spark, tmp_path):
    out = files.read_csv(spark, put(tmp_path, "a,b\n1,2\n3\n4,\n"))
    assert [tuple(r) for r in out.collect()] == [(1, 2), (3, None), (4, None)]
    for line in ("3,4,5", "3,4,", '"3,1",4,"5"'):
        path = put(tmp_path, f'a,b\n1,2\n{line}\n"6,6",7\n', "b.csv")
        for options in ({}, {"infer_rows": 0}):  # found while types are, or else by any read, whatever it selects
            with pytest.raises(Exception, match=r"3 fields where there are 2"):
                files.read_csv(spark, path, **options).select("a").collect()
    with pytest.raises(Exception, match="a line of .*d.csv has 3 fields"):
        files.read_csv(spark, put(tmp_path, 'a,b\n"x\ny",2\n3,4,5\n', "d.csv")).collect()


def test_encodings(spark, tmp_path):
    path = put(tmp_path, b"a,b\n1,caf\xe9\n")
    with pytest.raises(OperationError, match="isn't UTF-8"):
        files.read_csv(spark, path)
    assert files.read_csv(spark, path, encoding="utf8-lossy").first()["b"] == "caf�" and files.read_csv(spark, path, encoding="latin1").first()["b"] == "café"
    assert files.read_csv(spark, put(tmp_path, "﻿a,b\r\n1,é\r\n\r\n2,x\r\n", "bom.csv")).collect() == [(1, "é"), (2, "x")]


def test_header_like_rows_and_names(spark, tmp_path):
    out = files.read_csv(spark, put(tmp_path, "a,b.c,d`e\n1,2,3\na,b.c,d`e\n"))
    assert out.columns == ["a", "b.c", "d`e"] and [tuple(r) for r in out.collect()] == [("1", "2", "3"), ("a", "b.c", "d`e")]
    assert files.read_csv(spark, put(tmp_path, "1,2\n3,4\n", "n.csv"), has_header=False).collect() == [(1, 2), (3, 4)]
    with pytest.raises(OperationError, match="unknown column 'q'"):
        files.read_csv(spark, put(tmp_path, "a\n1\n", "u.csv"), types={"q": "int"})


@pytest.mark.parametrize("block", [400, 4096])
def test_line_feeds_in_fields_are_read_in_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    pieces = ["x", 'a "quote"', "two\nlines", "\n", "a,b", 'q"\n"r', "", "l" * 90 + "\n" * 5, "\r\nwin"]
    rows = [(str(i), "".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 9]))), str(rng.random())) for i in range(120)]
    for ends in ("\n", "\r\n")[block == 400 :]:
        made = io.StringIO()
        csv.writer(made, lineterminator=ends).writerows([("id", "text", "n"), *rows])
        path = put(tmp_path, made.getvalue(), f"m{len(ends)}.csv")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        try:
            out = files.read_csv(spark, path)
            tasks = spark.read.text(path).rdd.getNumPartitions()
            assert tasks > len(made.getvalue()) // (2 * block)
            found = sorted((r["id"], r["text"] or "", r["n"]) for r in out.collect())
        finally:
            for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
                spark.conf.unset(f"spark.sql.files.{k}")
        assert found == sorted((int(i), t, float(n)) for i, t, n in rows)


def test_open_quote(spark, tmp_path):
    with pytest.raises(OperationError, match="a quote isn't closed"):
        files.read_csv(spark, put(tmp_path, 'a,b\n1,"x\n2,y\n'))
