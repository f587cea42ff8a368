"""Hot keys: one group holds a third or more of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwise.operators import marks, runlog


@pytest.fixture()
def skewed(spark):
    # key 0 holds half of the rows; the rest spread over 50 keys.
    return spark.range(30000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("k"),
        F.col("id").alias("seq"),
        (F.col("id") * 7919 % 10007).cast("double").alias("v"),
    ).repartition(12)


def test_hot_group_quantiles_exact_and_split(spark, skewed):
    got = {r["k"]: r for r in marks.exact_quantiles(skewed, "k", "v").collect()}
    pdf = skewed.toPandas()
    for key in (0, 2, 18):
        vals = pdf.loc[pdf.k == key, "v"].to_numpy()
        assert [got[key]["q0"], got[key]["q1"], got[key]["q2"]] == pytest.approx(list(np.quantile(vals, [.25, .5, .75])))
    # The range partitioning spreads the hot group over several partitions.
    parts = (skewed.select("k", "v").repartitionByRange(8, "k", "v")
             .withColumn("pid", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("pid").alias("p")))
    assert parts.filter("k = 0").first()["p"] > 1


def test_hot_key_recent_and_superseded(spark, skewed):
    top = runlog.recent_per_key(skewed, "k", "seq", 5).filter("k = 0").orderBy("rank").collect()
    assert [r["seq"] for r in top] == [29998, 29996, 29994, 29992, 29990]
    sup = runlog.superseded(skewed, "k", "seq").filter("k = 0 AND NOT superseded").collect()
    assert [r["seq"] for r in sup] == [29998]
    latest = runlog.latest_state(skewed, "k", "seq").filter("k = 0").first()
    assert latest["seq"] == 29998
