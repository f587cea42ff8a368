"""Workbook catalogue and sheet import (cases from the reference's tests)."""

import os

import pytest

from planwise import Plan, PlanError, compile_plan
from planwise.dataset import DatasetError
from planwise.operators.profile import type_dataset
from planwise.sources.workbook import read_workbook, sheet_catalog
from tests.xlsx_fixture import write_xlsx


def test_workbook_header_two_nulls_and_formula(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sales.xlsx")
    rows = [["销售数据"], ["日期", "地区", "销售额"],
            [("date", 46023), "华东", 100], [("date", 46024), "华东", 300],
            [("date", 46025), "华南", None], [("date", 46026), "华南", ("formula", "SUM(C3:C4)")]]
    write_xlsx(path, [("说明", False, [["readme"]]), ("中文销售", False, rows)])
    ds = type_dataset(read_workbook(spark, path, "中文销售", header_row=2))
    assert ds.df.count() == 4 and ds.fields[0].dtype == "date"
    assert any("has no stored value" in w for w in ds.warnings)
    with pytest.raises(Exception, match="missing"):
        compile_plan(ds, Plan(group_by=["f2"], metric="f3")).df.collect()
    out = compile_plan(ds, Plan(group_by=["f2"], metric="f3", missing="keep")).df.collect()
    assert {r["f2"]: r["value"] for r in out}["华东"] == 400.0


def test_catalog_hidden_sheets_and_named_sheet(spark, tmp_dir):
    path = os.path.join(tmp_dir, "multi.xlsx")
    data = [["title"], ["region", "value"], ["A", 10], [None, 20]]
    write_xlsx(path, [("blank", False, []), ("data", False, data), ("secret", True, [["x"]])])
    cat = sheet_catalog(spark, path).orderBy("position").collect()
    assert [r["sheet"] for r in cat] == ["blank", "data", "secret"] and [r["hidden"] for r in cat] == [False, False, True]
    with pytest.raises(DatasetError):
        read_workbook(spark, path, "")
    ds = type_dataset(read_workbook(spark, path, "data", header_row=2))
    total = compile_plan(ds, Plan(metric="f2", missing="keep")).df.first()["value"]
    assert total == 30.0
