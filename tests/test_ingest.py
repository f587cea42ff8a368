"""Ingestion, typing, profiling and diagnostics."""

import os

import pytest

from planwise import Dataset, Plan, compile_plan
from planwise.dataset import DatasetError
from planwise.operators.profile import duplicate_rows, fingerprint, infer_types, profile, type_dataset
from planwise.operators.review import data_review, review_counts, review_frame, summary_suspects
from planwise.sources.delimited import IngestError, read_delimited, read_pasted


def write(tmp_dir, name, data: bytes):
    path = os.path.join(tmp_dir, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_csv_import_types_and_nulls(spark, tmp_dir):
    path = write(tmp_dir, "s.csv", "﻿region,amount,day\nEast,100,2026-01-01\nWest,,2026-01-02\nEast,300,2026-01-03\n"
                 .encode("utf-8"))
    ds = type_dataset(read_delimited(spark, path))
    assert [f.name for f in ds.fields] == ["region", "amount", "day"]
    assert [f.dtype for f in ds.fields] == ["string", "number", "date"]
    assert ds.ids == ["f1", "f2", "f3"]
    rows = {r["f1"]: r["value"] for r in compile_plan(
        ds, Plan(group_by=["region"], metric="amount", missing="keep")).df.collect()}
    assert rows == {"East": 400.0, "West": None}


def test_ragged_row_rejected(spark, tmp_dir):
    path = write(tmp_dir, "r.csv", b"a,b\n1,2,3\n")
    with pytest.raises(IngestError, match="columns"):
        read_delimited(spark, path)


def test_blank_line_rejected(spark, tmp_dir):
    path = write(tmp_dir, "b.csv", b"a,b\n1,2\n\n3,4\n")
    with pytest.raises(IngestError, match="blank"):
        read_delimited(spark, path)


def test_gb18030_and_duplicate_headers(spark, tmp_dir):
    raw = "region,amount,amount\n华东,100,200\n华南,非法,300\n".encode("gb18030")
    path = write(tmp_dir, "g.csv", raw)
    with pytest.raises(IngestError, match="not valid"):
        read_delimited(spark, path)
    ds = read_delimited(spark, path, encoding="GB18030")
    assert ds.ids == ["f1", "f2", "f3"] and ds.warnings
    typed = type_dataset(ds)
    assert [f.dtype for f in typed.fields] == ["string", "string", "number"]
    assert any("mixed" in w for w in typed.warnings)
    with pytest.raises(DatasetError, match="not a number"):
        type_dataset(ds, {"f2": {"dtype": "number"}})


def test_header_row_two(spark, tmp_dir):
    path = write(tmp_dir, "h.csv", b"title line\nname,value\nA,1\nB,2\n")
    ds = read_delimited(spark, path, header_row=2, check_blank_lines=False)
    assert [f.name for f in ds.fields] == ["name", "value"] and ds.df.count() == 2


def test_multiline_quoted_field(spark, tmp_dir):
    path = write(tmp_dir, "m.csv", b'a,b\n1,"x\ny"\n2,z\n')
    with pytest.raises(IngestError, match="multiline"):
        read_delimited(spark, path)
    ds = read_delimited(spark, path, multiline=True)
    assert ds.df.count() == 2


def test_row_limit_rejects(spark, tmp_dir):
    path = write(tmp_dir, "l.csv", b"a\n1\n2\n3\n")
    with pytest.raises(IngestError, match="exceed the limit"):
        read_delimited(spark, path, max_rows=2)


def test_pasted_table(spark):
    ds = type_dataset(read_pasted(spark, "group\tamount\nA\t100\nB\t200\n"))
    out = {r["f1"]: r["value"] for r in compile_plan(ds, Plan(group_by=["f1"], metric="f2")).df.collect()}
    assert out == {"A": 100.0, "B": 200.0}


def test_inference_rejects_java_only_numbers(spark):
    df = spark.createDataFrame([("1d",), ("2",)], "x string")
    info = infer_types(df).first()
    assert info["dtype"] == "string" and info["mixed"]


def test_strict_casts(spark):
    df = spark.createDataFrame([("true", "x", "2026-01-01"), ("0", "1", "2026-01-02")], "b string, n string, d string")
    ds = Dataset.from_frame(df)
    typed = type_dataset(ds, {"b": {"dtype": "boolean"}})
    assert [r["b"] for r in typed.df.collect()] == [True, False]
    with pytest.raises(DatasetError, match="not a number"):
        type_dataset(ds, {"n": {"dtype": "number"}})
    inf = Dataset.from_frame(spark.createDataFrame([("inf",), ("1",)], "n string"))
    with pytest.raises(DatasetError, match="infinite"):
        type_dataset(inf)
    with pytest.raises(DatasetError, match="not one of"):
        type_dataset(ds, {"d": {"dtype": "boolean"}})
    with pytest.raises(DatasetError, match="Unknown field"):
        type_dataset(ds, {"zz": {"dtype": "number"}})


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", 10.0), ("B", None)], "r string, v double")
    ds = Dataset.from_frame(df)
    prof = {r["field"]: r for r in profile(ds).collect()}
    assert prof["r"]["unique"] == 2 and prof["v"]["nulls"] == 1 and prof["v"]["max"] == "10.0"
    assert duplicate_rows(df).first()["duplicate_rows"] == 1
    a, b = fingerprint(df).first(), fingerprint(df.orderBy("v").repartition(3)).first()
    assert a["checksum"] == b["checksum"]
    assert fingerprint(df.limit(2)).first()["checksum"] != a["checksum"]


def test_review_suspects_and_quality(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", 10.0), ("B", 20.0), ("合计", 40.0), (" Total　", 1.0)],
                               "region string, revenue double")
    ds = Dataset.from_frame(df)
    sus = {r["value"]: r["rows"] for r in summary_suspects(ds).collect()}
    assert sus == {"合计": 1, "total": 1}
    clean = Dataset.from_frame(spark.createDataFrame([("East", 100.0), ("East", 300.0), ("West", 200.0)], "r string, s double"))
    rev = data_review(clean)
    assert rev["rows"] == 3 and rev["exact_duplicate_rows"] == 0 and rev["possible_summary_rows"] == []


def test_fused_review_counts_match_separate_passes(spark):
    """The single-aggregate review equals the per-field suspects and the
    duplicate count computed separately, with nulls and repeated rows."""
    rows = [("A", "合计", 1.0), ("A", "合计", 1.0), ("total", None, 2.0), (None, "x", None),
            ("全部", "ALL ", 3.0), ("全部", "ALL ", 3.0), ("全部", "ALL ", 3.0), ("B", "y", 4.0)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    ds = Dataset.from_frame(df)
    counts = review_counts(ds).first()
    assert counts["rows"] == 8
    assert counts["exact_duplicate_rows"] == duplicate_rows(df).first()["duplicate_rows"] == 3
    per_field = summary_suspects(ds).collect()
    assert counts["suspect_rows"] == sum(r["rows"] for r in per_field) == 9
    assert {r["metric"]: r["value"] for r in review_frame(ds).collect()} == {
        "rows": 8, "exact_duplicate_rows": 3, "suspect_rows": 9}
    rev = data_review(ds)
    assert {(r["field"], r["value"]): r["rows"] for r in rev["possible_summary_rows"]} == {
        ("a", "total"): 1, ("a", "全部"): 3, ("b", "合计"): 2, ("b", "all"): 3}


def test_sql_text_helpers_survive_awkward_names(spark):
    """Profile and review build SQL text; quotes, backticks, backslashes and
    non-ASCII in names and labels must round-trip through Spark's parser."""
    from planwise.functions.exprs import quote_id, sql_literal
    texts = ["it's", "a\\b", "合计", "x`y", "line\nbreak", "\\'"]
    got = spark.sql("SELECT " + ", ".join(f"{sql_literal(t)} AS c{i}" for i, t in enumerate(texts))).first()
    assert list(got) == texts
    df = spark.createDataFrame([("合计", 1.0), ("b", None)], "`we'ird name` string, `v\\x` double")
    ds = Dataset.from_frame(df)
    prof = {r["field"]: r for r in profile(ds).collect()}
    assert prof["we'ird name"]["unique"] == 2 and prof["v\\x"]["nulls"] == 1 and prof["v\\x"]["max"] == "1.0"
    assert review_counts(ds).first()["suspect_rows"] == 1
    assert spark.range(1).selectExpr(f"1 AS {quote_id('a`b')}").columns == ["a`b"]


def test_header_row_three_stays_in_spark(spark, tmp_dir):
    """A later header row: preamble dropped by position, records parsed by
    Spark's CSV parser, ragged and blank lines still rejected."""
    path = write(tmp_dir, "h3.csv", b'report,2026\n\nregion,"amount, total",day\nEast,100,2026-01-01\n'
                 b'"We""st",,2026-01-02\n')
    ds = type_dataset(read_delimited(spark, path, header_row=3, check_blank_lines=True))
    assert [f.name for f in ds.fields] == ["region", "amount, total", "day"]
    assert [f.dtype for f in ds.fields] == ["string", "number", "date"]
    assert sorted((r["f1"], r["f2"]) for r in ds.df.collect()) == [("East", 100.0), ('We"st', None)]
    ragged = write(tmp_dir, "r3.csv", b"x\nname,value\nA,1\nB,2,3\n")
    with pytest.raises(IngestError, match="do not have 2 columns"):
        read_delimited(spark, ragged, header_row=2)
    blank = write(tmp_dir, "b3.csv", b"x\nname,value\nA,1\n\nB,2\n")
    with pytest.raises(IngestError, match="blank lines"):
        read_delimited(spark, blank, header_row=2)
    assert read_delimited(spark, blank, header_row=2, check_blank_lines=False).df.count() == 2
