import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import ranks, split
from kindred.sources import logs


@pytest.fixture
def skewed(spark):
    """A third and more of the rows in one label; ids with gaps."""
    return spark.range(0, 3000, 3).select(F.col("id").alias("idx_global"), F.when(
        F.col("id") % 5 < 3, 7).otherwise(F.col("id") % 4).cast("int").alias("label"))


def test_relative_index_over_chunks(skewed):
    got = ranks.relative_index(skewed, ["label"], chunk_rows=64).toPandas().sort_values("idx_global")
    assert (got.groupby("label").cumcount() == got.idx_relativo).all()


def test_exact_sample_is_the_hash_order_prefix(skewed):
    ids = [r.idx_global for r in skewed.collect()]
    want = sorted(ids, key=lambda i: (hashlib.md5(f"s{i}".encode()).hexdigest(), i))[:37]
    for digits in (1, 4):
        got = ranks.exact_sample(skewed, 0.037, "idx_global", "s", digits)
        assert sorted(r.idx_global for r in got.collect()) == sorted(want)


def test_top_n(skewed):
    got = ranks.top_n(skewed, ["label"], [F.col("idx_global").desc()], 2).toPandas()
    assert (got.groupby("label").size() == 2).all()


def test_stratified_split_keeps_proportions(skewed):
    noisy = skewed.withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    got = split.stratified_split(noisy, 0.2).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r.label != -1 and r.t == int(r.n * 0.2 + 0.5) for r in got)
    again = split.stratified_split(noisy, 0.2, remove_noise=False)
    assert again.count() == noisy.count()


def test_folds_are_contiguous_and_even(skewed):
    got = split.kfold(skewed, 3).toPandas().sort_values("idx_global")
    assert got.fold.is_monotonic_increasing
    assert got.groupby("fold").size().tolist() == [334, 333, 333]


def test_too_few_classes_fail(spark):
    one = spark.range(5).select(F.lit(1).alias("label"))
    with pytest.raises(ValueError, match="at least 2"):
        split.require_classes(one)


def test_next_ids_continue_the_log(spark, skewed):
    last = spark.createDataFrame([(41,)], "last_id long")
    got = logs.next_ids(skewed, last, "idx_global", chunk_rows=100).toPandas().sort_values("idx_global")
    assert got.id.tolist() == list(range(42, 42 + len(got)))
    empty = spark.createDataFrame([(None,)], "last_id long")
    assert logs.next_ids(skewed, empty, "idx_global").agg(F.min("id")).first()[0] == 1


def test_positions_of_sparse_and_negative_ids(spark):
    rng = np.random.default_rng(4)
    ids = np.unique(np.concatenate([rng.integers(-2**63, 2**63 - 1, 300), np.arange(40), [-2**63, 2**63 - 1]]))
    df = spark.createDataFrame([(int(i), int(i) % 2) for i in ids], "idx_global long, g int")
    got = {r.idx_global: r.idx_relativo for r in ranks.relative_index(df, ["g"]).collect()}
    for g in (0, 1):
        assert [got[i] for i in sorted(i for i in got if i % 2 == g)] == list(range(sum(i % 2 == g for i in got)))


@pytest.mark.parametrize("listed", [1000, 1])
def test_only_the_folders_of_asked_groups_are_read(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(ranks, "LISTED_GROUPS", listed)
    rows = [(i, i % 5) for i in range(40)]
    spark.createDataFrame(rows, "idx_global long, label int").write.partitionBy("label").parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    asked = spark.createDataFrame([(1, 3), (2, 3), (3, 9), (4, None)], "query_id long, label int")
    got = ranks.in_asked_groups(corpus, asked, "label")
    assert {tuple(r) for r in got.collect()} == {r for r in rows if r[1] == 3}
    if listed == 1000:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "label" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "Exchange" not in plan
    none = ranks.in_asked_groups(corpus, asked.limit(0), "label")
    assert none.count() == 0
