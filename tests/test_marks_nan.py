"""Values that are not numbers, lying bars, matrix and density guards, schemas that change."""

import pytest
from pyspark.sql import functions as F

from planwise.operators import marks
from planwise.operators.review import GuardError
from planwise.sources.parquet import read_parquet

NAN = float("nan")


def test_nan_is_missing_in_marks(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", NAN, 2.0), ("a", 3.0, 3.0), ("a", 2.0, NAN)], "g string, v double, w double")
    assert sum(r["count"] for r in marks.histogram(df, "v", 2).collect()) == 3
    box = marks.box_stats(df, "g", "v").first()
    assert (box["n"], box["q1"], box["median"], box["q3"], box["outliers"]) == (3, 1.5, 2.0, 2.5, 0)
    assert marks.box_outliers(df, "g", "v").count() == 0
    assert marks.violin_density(df, "g", "v", points=5).where("isnan(density) OR density IS NULL").count() == 0
    assert sorted((r.px, r.py) for r in marks.density_raster(df, "v", "w", 2, 2).collect()) == [(0, 0), (1, 1)]
    assert [r.color_t for r in marks.color_scale(df, "v").collect()] == [0.0, None, 1.0, 0.5]
    assert [r.value for r in marks.bar_marks(df, "g", "v").collect()] == [1.0, None, 3.0, 2.0]


def test_bars_lie_where_only_x_is_numeric(spark):
    df = spark.createDataFrame([(2.0, "a"), (1.0, None)], "x double, y string")
    assert marks.is_horizontal(df, "x", "y") and not marks.is_horizontal(df, "y", "x")
    assert [r.value for r in marks.bar_marks(df, "x", "y").collect()] == [2.0, 1.0]


def test_matrix_and_density_guards(spark, monkeypatch):
    df = spark.range(5).select("id", F.lit("r").alias("r"), F.lit(1.0).alias("v"))
    monkeypatch.setattr(marks, "MAX_COLUMNS", 4)
    with pytest.raises(GuardError, match="Over 4 heatmap columns"):
        marks.heatmap_matrix(df, "r", "id", "v")
    with pytest.raises(GuardError, match="two fields"):
        marks.density_raster(df, "v", "v", 4, 4)


def test_color_codes_have_no_global_window_over_categories(spark):
    df = spark.range(1000).select((F.col("id") % 257).cast("string").alias("c"))
    got = {r.c: r.color_code for r in marks.color_codes(df.unionByName(df.limit(1).select(F.lit(None).cast("string").alias("c"))), "c").collect()}
    want = {c: k % 10 for k, c in enumerate(sorted({str(k) for k in range(257)}))} | {None: 257 % 10}
    assert got == want


def test_a_changed_table_has_its_new_schema(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    spark.range(3).write.parquet(path)
    assert read_parquet(spark, path).columns == ["id"]
    spark.range(3).withColumn("more", F.lit("x")).write.mode("overwrite").parquet(path)
    assert read_parquet(spark, path).columns == ["id", "more"]
