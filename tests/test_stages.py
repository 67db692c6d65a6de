"""Stages that know their inputs, and samples that open few files."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from bazaarlens.sources import star


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_a_stage_is_written_again_when_inputs_or_plan_change(spark):
    source, out = f"{folder()}/in", f"{folder()}/out"
    spark.range(10).write.parquet(source)
    stage = lambda plan=lambda d: d: star.stage_write(plan(spark.read.parquet(source)), out)
    table, status = stage()
    assert (table.count(), status) == (10, "written") and stage()[1] == "kept"
    spark.range(5).write.mode("append").parquet(source)
    table, status = stage()
    assert (table.count(), status) == (15, "written") and stage()[1] == "kept"
    table, status = stage(lambda d: d.filter("id > 3"))
    assert status == "written" and table.filter("id <= 3").count() == 0
    assert stage(lambda d: d.filter("id > 3"))[1] == "kept" and stage(lambda d: d.filter("id > 4"))[1] == "written"
    assert star.stage_write(spark.read.parquet(source), out, overwrite=True)[1] == "written"
    fs = star._path(spark, out)[1]
    fs.delete(star._path(spark, f"{out}/_SUCCESS")[0], False)
    assert stage()[1] == "written"


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_a_block_sample_opens_few_files(spark):
    path = f"{folder()}/many"
    spark.range(10_000).withColumn("x", F.col("id") % 7).repartition(100, "id").write.parquet(path)
    table = spark.read.parquet(path)
    n = len(table.inputFiles())
    part = star.block_sample(table, 10)
    assert files_read(table.select("id")) == n and files_read(part.select("id")) <= n / 10 + 2
    assert 800 < part.count() < 1200 and part.columns == ["id", "x"]
    assert sorted(r.id for r in part.collect()) == sorted(r.id for r in star.block_sample(spark.read.parquet(path), 10).collect())
    assert star.block_sample(table, 10, seed=8).join(part, "id").count() < 600
    assert star.block_sample(table, 100).count() == 10_000
    assert 0 < star.block_sample(table.filter("id < 5000").select((F.col("id") + 1).alias("y")), 10).count() < 1000


def test_staged_features_are_joined_without_exchanging_the_stages(spark):
    from bazaarlens.operators import features

    def plain(n):
        return features.FeatureStages(
            spark.range(n).select(F.col("id").alias("item_id"), F.col("id").alias("days")), spark.range(n).select(F.col("id").alias("user_id"), F.col("id").alias("total_pos")),
            *[spark.range(n).select(F.col("id").alias("user_id"), F.col("id").alias("item_id"), F.col("id").cast("double").alias(c)) for c in ("a", "b", "c")])

    candidates = spark.range(40).select((F.col("id") % 9).alias("user_id"), (F.col("id") % 11).alias("item_id")).distinct()
    truth = candidates.filter("user_id = item_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        staged = features.stage_features(plain(10))
        from bazaarlens.session import bucketed
        out = features.assemble_features(bucketed(candidates, "candidates", "user_id", "item_id"), staged)
        exchanges = out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        loose = features.assemble_features(candidates, plain(10))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert exchanges <= 2 < loose
        rows = lambda stages: sorted(map(tuple, features.assemble_features(candidates, stages, truth).collect()))
        assert rows(staged) == rows(plain(10)) and len(rows(staged)) == candidates.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
