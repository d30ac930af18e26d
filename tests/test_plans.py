"""Plans that must not move rows, and storage that lets them."""

from pyspark.sql import functions as F

from peakloom.operators import associations
from peakloom.plans import catalogue
from peakloom.sources import bucketed

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_three_stored_tables_are_joined_where_they_lie(spark):
    plan = executed(catalogue.queries()["co_partitioned"](spark, SF))
    assert plan.count("Bucketed: true") >= 3 and "Exchange" not in plan


def test_contingency_of_bucketed_tables_moves_sums_only(spark, tmp_path):
    features = spark.createDataFrame([(i % 3, i // 3, i % 5, 1.0) for i in range(300)], "chunk int, token int, feature_idx int, activation double")
    labels = features.select("chunk", "token", (F.col("token") % 4).cast("long").alias("concepts")).distinct()
    stored = []
    for name, rows in (("f", features), ("l", labels)):
        path = f"file://{tmp_path}/{name}"
        bucketed.write_bucketed(rows, path, ["chunk", "token"], 4)
        assert bucketed.is_bucketed(spark, path)
        spark.sql(f"DROP TABLE {bucketed._name(path)}")  # as in another session
        stored.append(bucketed.read_bucketed(spark, path))
    found = associations.contingency(*stored, 7, 2, ["chunk", "token"])
    plan = executed(found)
    joined = plan[plan.index("SortMergeJoin") :]
    assert "Exchange hashpartitioning(chunk" not in plan and "Exchange hashpartitioning(token" not in plan and "Bucketed: true" in joined
    key = lambda r: (r["feature_idx"], r["concept_idx"])
    assert sorted(found.collect(), key=key) == sorted(associations.contingency(features, labels, 7, 2, ["chunk", "token"]).collect(), key=key)
    bucketed.drop_bucketed(spark, path)
    assert not bucketed.is_bucketed(spark, path)


def test_bucket_counts_hang_on_the_data_alone():
    assert [bucketed.buckets_for(n) for n in (0, 10**6, 67_500_000)] == [8, 8, 512]
