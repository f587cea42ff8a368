"""Known-answer plan tests (cases from the reference's own tests)."""

import datetime as dt

import pytest

from planwise import Dataset, Filter, Plan, PlanError, compile_plan


def frame(spark, rows, schema):
    return Dataset.from_frame(spark.createDataFrame(rows, schema))


def values(result):
    return {tuple(r[:-1]): r["value"] for r in result.df.collect()}


def test_ratio_total_and_mean(spark):
    ds = frame(spark, [("A", 1.0, 2.0), ("A", 90.0, 100.0)], "group string, converted double, visitors double")
    total = compile_plan(ds, Plan(group_by=["group"], metric="converted", denominator="visitors",
                                  aggregation="ratio_total"))
    assert values(total)[("A",)] == pytest.approx(91 / 102)
    mean = compile_plan(ds, Plan(group_by=["group"], metric="converted", denominator="visitors",
                                 aggregation="ratio_mean"))
    assert values(mean)[("A",)] == pytest.approx(0.7)
    rows, report = total.collect()
    assert report.value_format == "percent" and report.analyzed_rows == 2


def test_ratio_requires_denominator_and_unknown_keys_rejected():
    with pytest.raises(PlanError):
        Plan(metric="converted", aggregation="ratio_total")
    with pytest.raises(PlanError):
        Plan.from_dict({"metric": "x", "bogus": 1})
    with pytest.raises(PlanError):
        Plan.from_dict({"group_by": ["a", "b", "c", "d"]})


def test_zero_denominators_raise(spark):
    ds = frame(spark, [("A", 1.0, 0.0), ("B", None, 0.0), ("B", 1.0, 2.0)], "g string, n double, d double")
    with pytest.raises(Exception, match="add up to zero"):
        compile_plan(ds, Plan(group_by=["g"], metric="n", denominator="d", aggregation="ratio_total",
                              missing="keep")).df.collect()
    with pytest.raises(Exception, match="zero denominator"):
        compile_plan(ds, Plan(group_by=["g"], metric="n", denominator="d", aggregation="ratio_mean",
                              missing="keep")).df.collect()


def test_month_grain_and_partial_notice(spark):
    rows = [(dt.datetime(2026, 1, 1), 100.0), (dt.datetime(2026, 1, 31), 200.0), (dt.datetime(2026, 2, 4), 50.0)]
    ds = frame(spark, rows, "date timestamp_ntz, amount double")
    res = compile_plan(ds, Plan(group_by=["date"], metric="amount", time_grain="month", sort="label"))
    out, report = res.collect()
    assert [(r["date"], r["value"]) for r in out] == [("2026-01", 300.0), ("2026-02", 50.0)]
    assert any("may lack days" in w for w in report.warnings)
    with pytest.raises(PlanError, match="no field has the ID"):
        compile_plan(ds, Plan(group_by=["nope"], metric="amount"))


def test_week_label_monday_to_sunday(spark):
    ds = frame(spark, [(dt.datetime(2026, 1, 1), 1.0)], "d timestamp_ntz, v double")
    out = compile_plan(ds, Plan(group_by=["d"], metric="v", time_grain="week")).df.first()
    assert out["d"] == "2025-12-29/2026-01-04"


def test_dedupe_then_filter_review_fixture(spark):
    ds = frame(spark, [("A", 10.0), ("A", 10.0), ("B", 20.0), ("合计", 40.0)], "region string, revenue double")
    plain, rep = compile_plan(ds, Plan(metric="revenue")).collect()
    assert rep.analyzed_rows == 4 and plain[0]["value"] == 80.0
    res = compile_plan(ds, Plan(metric="revenue", duplicates="drop_exact",
                                filters=[Filter("region", "ne", "合计")]))
    rows, rep = res.collect()
    assert rows[0]["value"] == 30.0 and rep.analyzed_rows == 2 and rep.duplicate_rows_removed == 1
    assert ds.df.count() == 4  # source unchanged


def test_missing_policies(spark):
    ds = frame(spark, [("A", 10.0), (None, 20.0), ("A", None)], "region string, value double")
    with pytest.raises(Exception, match="missing"):
        compile_plan(ds, Plan(group_by=["region"], metric="value")).df.collect()
    with pytest.raises(PlanError, match="missing"):
        compile_plan(ds, Plan(group_by=["region"], metric="value")).report()
    keep = values(compile_plan(ds, Plan(group_by=["region"], metric="value", missing="keep")))
    assert keep == {("A",): 10.0, (None,): 20.0}
    excl = values(compile_plan(ds, Plan(group_by=["region"], metric="value", missing="exclude")))
    assert excl == {("A",): 10.0}


def test_count_includes_null_metrics_and_global_group(spark):
    ds = frame(spark, [("A", None), ("A", 1.0), ("B", 2.0)], "g string, v double")
    cnt = values(compile_plan(ds, Plan(group_by=["g"], aggregation="count", missing="keep")))
    assert cnt == {("A",): 2, ("B",): 1}
    glob = compile_plan(ds, Plan(metric="v", missing="keep")).df.first()
    assert glob["_all"] == "All / 全部" and glob["value"] == 3.0


def test_ne_null_semantics_by_dtype(spark):
    ds = frame(spark, [("A", 1.0), (None, None), ("B", 2.0)], "s string, n double")
    ne_num = compile_plan(ds, Plan(aggregation="count", filters=[Filter("n", "ne", 1.0)])).df.first()["value"]
    ne_str = compile_plan(ds, Plan(aggregation="count", filters=[Filter("s", "ne", "A")])).df.first()["value"]
    assert ne_num == 2 and ne_str == 1


def test_filters_contains_in_and_dates(spark):
    rows = [("华东", 100.0, dt.datetime(2026, 1, 1)), ("华南", 200.0, dt.datetime(2026, 2, 1))]
    ds = frame(spark, rows, "region string, amount double, d timestamp_ntz")
    eq = compile_plan(ds, Plan(metric="amount", filters=[Filter("region", "eq", "华东")])).df.first()
    assert eq["value"] == 100.0
    cont = compile_plan(ds, Plan(metric="amount", filters=[Filter("amount", "contains", "20")])).df.first()
    assert cont["value"] == 200.0
    din = compile_plan(ds, Plan(metric="amount", filters=[Filter("d", "in", ["2026-02-01"])])).df.first()
    assert din["value"] == 200.0
    with pytest.raises(PlanError, match="no rows are left"):
        compile_plan(ds, Plan(metric="amount", filters=[Filter("amount", "gt", 1e9)])).collect()


def test_sorts_nulls_last_and_label(spark):
    ds = frame(spark, [("b", 2.0), ("a", 3.0), (None, 1.0), ("c", None)], "k string, v double")
    desc = [r["k"] for r in compile_plan(ds, Plan(group_by=["k"], metric="v", sort="desc", missing="keep")).df.collect()]
    asc = [r["k"] for r in compile_plan(ds, Plan(group_by=["k"], metric="v", sort="asc", missing="keep")).df.collect()]
    label = [r["k"] for r in compile_plan(ds, Plan(group_by=["k"], metric="v", sort="label", missing="keep")).df.collect()]
    assert desc == ["a", "b", None, "c"] and asc == [None, "b", "a", "c"] and label == ["a", "b", "c", None]


def test_validation_rules(spark):
    ds = frame(spark, [("x", 1.0, dt.datetime(2026, 1, 1))], "s string, n double, d timestamp_ntz")
    with pytest.raises(PlanError, match="metric: "):
        compile_plan(ds, Plan(metric="s"))
    with pytest.raises(PlanError, match="time bucket"):
        compile_plan(ds, Plan(group_by=["s"], metric="n", time_grain="month"))
    with pytest.raises(PlanError, match="denominator: "):
        compile_plan(ds, Plan(metric="n", denominator="s", aggregation="ratio_total"))


def test_display_names_resolve_to_ids(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "a string, b double")
    ds = Dataset.from_frame(df, names=["Region", "Sales"], positional_ids=True)
    out = compile_plan(ds, Plan(group_by=["Region"], metric="Sales")).df.first()
    assert out["f1"] == "A" and out["value"] == 3.0
    dup = Dataset.from_frame(df, names=["Same", "Same"], positional_ids=True)
    assert dup.warnings
    with pytest.raises(PlanError, match="no field has the ID"):
        compile_plan(dup, Plan(metric="Same"))


def test_raw_rows_rename_metric(spark):
    ds = frame(spark, [("A", 1.0), ("B", 2.0)], "g string, v double")
    out = compile_plan(ds, Plan(group_by=["g"], metric="v", aggregation="raw", sort="desc")).df
    assert out.columns == ["g", "value"] and [r["g"] for r in out.collect()] == ["B", "A"]


def test_property_group_sums_equal_global_sum(spark):
    from planwise.registry import dataset
    ds = dataset(spark, "/root/testdata/sf0.001", "lineitem")
    groups = compile_plan(ds, Plan(group_by=["l_returnflag"], metric="l_quantity")).df.collect()
    total = compile_plan(ds, Plan(metric="l_quantity")).df.first()["value"]
    assert sum(r["value"] for r in groups) == pytest.approx(total)
    one_per_group = frame(spark, [("A", 3.0, 4.0), ("B", 1.0, 5.0)], "g string, n double, d double")
    rt = values(compile_plan(one_per_group, Plan(group_by=["g"], metric="n", denominator="d", aggregation="ratio_total")))
    rm = values(compile_plan(one_per_group, Plan(group_by=["g"], metric="n", denominator="d", aggregation="ratio_mean")))
    assert rt == pytest.approx(rm)


def test_filter_and_complement_cover_input(spark):
    from planwise.registry import dataset
    ds = dataset(spark, "/root/testdata/sf0.001", "orders")
    n = ds.df.count()
    a = compile_plan(ds, Plan(aggregation="count", filters=[Filter("o_totalprice", "gt", 100000)])).df.first()["value"]
    b = compile_plan(ds, Plan(aggregation="count", filters=[Filter("o_totalprice", "lte", 100000)])).df.first()["value"]
    assert a + b == n


def test_canonical_json_roundtrip():
    p = Plan(group_by=["a"], metric="m", filters=[Filter("a", "in", ["x", "y"])])
    assert Plan.from_json(p.canonical_json()) == p


DEMO_ROWS = [
    (0, "2026-01", 12000.0, 1000.0, 100.0), (0, "2026-02", 18000.0, 3000.0, 150.0), (0, "2026-03", 15000.0, 2000.0, 200.0),
    (1, "2026-01", 9000.0, 800.0, 80.0), (1, "2026-02", 11000.0, 1200.0, 180.0), (1, "2026-03", 13000.0, 2000.0, 140.0),
    (2, "2026-01", 17000.0, 1500.0, 120.0), (2, "2026-02", 21000.0, 2500.0, 300.0), (2, "2026-03", 19000.0, 1000.0, 150.0),
    (3, "2026-01", 6000.0, 400.0, 40.0), (3, "2026-02", 8000.0, 800.0, 40.0), (3, "2026-03", 7000.0, 1200.0, 180.0),
]


def test_demo_ratios_and_top_sales(spark):
    from planwise.functions.exprs import format_value
    from planwise.operators.review import check_positive_finite
    df = spark.createDataFrame(DEMO_ROWS, "region int, month string, sales double, visits double, orders double")
    ds = frame(spark, DEMO_ROWS, "region int, month string, sales double, visits double, orders double")
    check_positive_finite(df, "sales", "visits")
    total = compile_plan(ds, Plan(group_by=["region"], metric="orders", denominator="visits", aggregation="ratio_total"))
    mean = compile_plan(ds, Plan(group_by=["region"], metric="orders", denominator="visits", aggregation="ratio_mean"))
    fmt = lambda res: {r["region"]: r["label"] for r in res.df.select("region", format_value(res.df["value"], "percent").alias("label")).collect()}
    assert fmt(total)[0] == "7.50%" and fmt(mean)[0] == "8.33%"
    top = compile_plan(ds, Plan(group_by=["region"], metric="sales", sort="desc")).df.first()
    assert (top["region"], top["value"]) == (2, 57000.0)


def test_conversion_fixture(spark):
    ds = frame(spark, [("East", 1000.0, 100.0), ("East", 2000.0, 400.0), ("West", 1000.0, 100.0)],
               "region string, visits double, orders double")
    got = values(compile_plan(ds, Plan(group_by=["region"], metric="orders", denominator="visits",
                                       aggregation="ratio_total")))
    assert got[("East",)] == pytest.approx(500 / 3000) and got[("West",)] == pytest.approx(0.1)


def test_positive_finite_guard(spark):
    from planwise.operators.review import GuardError, check_positive_finite
    bad = spark.createDataFrame([(1.0, 0.0)], "m double, d double")
    with pytest.raises(GuardError):
        check_positive_finite(bad, "m", "d")


@pytest.mark.parametrize("duplicates,missing,grain", [
    ("keep", "exclude", "month"), ("drop_exact", "exclude", "month"), ("drop_exact", "keep", "none"),
    ("keep", "keep", "day"),
])
def test_exact_report_equals_observed_report(spark, duplicates, missing, grain):
    """The default report (its own aggregate, exact under task retries) has
    the same counts as the observed fast path on the main job."""
    import datetime
    d = datetime.datetime
    rows = [("A", 1.0, d(2026, 1, 1)), ("A", 1.0, d(2026, 1, 1)), ("B", None, d(2026, 1, 31)),
            (None, 5.0, d(2026, 2, 3)), ("B", 7.0, None), ("C", 2.0, d(2026, 3, 9)), ("C", 2.0, d(2026, 3, 9)),
            ("A", 9.0, d(2025, 12, 30))]
    ds = Dataset.from_frame(spark.createDataFrame(rows, "g string, v double, t timestamp_ntz"))
    group = ("t", "g") if grain != "none" else ("g",)
    plan = Plan(group_by=group, metric="v", missing=missing, duplicates=duplicates, time_grain=grain,
                filters=[Filter("v", "ne", 9.0)])
    exact_rows, exact = compile_plan(ds, plan).collect()
    obs_rows, observed = compile_plan(ds, plan, observe=True).collect(exact_report=False)
    assert sorted(map(tuple, exact_rows), key=repr) == sorted(map(tuple, obs_rows), key=repr)
    for key in ("input_rows", "filtered_rows", "analyzed_rows", "missing_rows", "duplicate_rows_removed",
                "observed_range"):
        assert getattr(exact, key) == getattr(observed, key), key
    assert exact.duplicate_rows_removed == (2 if duplicates == "drop_exact" else 0)
