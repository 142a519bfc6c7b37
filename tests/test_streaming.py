import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from propspark.operators import learning
from propspark.session import new_path
from propspark.streaming import jobs


def test_scoring_equals_batch(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"cid": range(90), "a": rng.normal(size=90), "b": rng.normal(size=90), "molecular_weight": 50.0})
    f["smiles"] = ["C1CC" if i % 9 == 0 else "CCO" for i in range(90)]
    f["y"] = f["a"] * 2
    df = spark.createDataFrame(f)
    bundle = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 3, "max_depth": 3}).train(df, ["a", "b"], "y")
    src, out = new_path(spark, "in"), new_path(spark, "out")
    df.repartition(3).write.parquet(src)
    stream = jobs.read_files(spark, src, df.schema, per_trigger=1)
    jobs.run_to_end(jobs.score_stream(stream, [bundle], out))
    want = learning.score_batch(df, [bundle])
    for sink, status in (("scored", "ok"), ("quarantine", "failed")):
        got = jobs.read_scored(spark, out, sink).select("cid", "pred_y", "error", "batch_id")
        assert sorted(map(str, got.drop("batch_id").collect())) == sorted(map(str, want.where(F.col("status") == status).select("cid", "pred_y", "error").collect()))
    assert jobs.read_scored(spark, out).select("batch_id").distinct().count() == 3
    df.withColumn("cid", F.col("cid") + 1000).write.mode("append").parquet(src)  # later files continue from the checkpoint
    jobs.run_to_end(jobs.score_stream(jobs.read_files(spark, src, df.schema), [bundle], out))
    assert jobs.read_scored(spark, out).count() == 160


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), "ok" if i % 3 else "failed") for i in range(240)]
    return spark.createDataFrame(rows, "cid long, ts timestamp, status string")


def test_collection_drops_repeats(spark):
    src, out = new_path(spark, "in"), new_path(spark, "out")
    df = events(spark)
    for part in (df.where("cid < 120"), df.where("cid between 100 and 239")):  # the second file repeats 20 keys
        part.coalesce(1).write.mode("append").parquet(src)
        jobs.run_to_end(jobs.collect_stream(jobs.read_files(spark, src, df.schema), out))
    got = spark.read.parquet(out)
    assert got.count() == 240 and got.select("cid").distinct().count() == 240


def test_counts_over_several_batches(spark):
    src, out = new_path(spark, "in"), new_path(spark, "out")
    df = events(spark)
    for lo in (0, 80, 160):
        df.where(f"cid >= {lo} AND cid < {lo + 80}").coalesce(1).write.mode("append").parquet(src)
    jobs.run_to_end(jobs.count_stream(jobs.read_files(spark, src, df.schema, per_trigger=1), out))
    assert sorted(map(tuple, jobs.latest_counts(spark, out).collect())) == sorted(map(tuple, jobs.status_counts(df).collect()))


def test_no_row_is_lost(spark):
    """Late rows and repeats have sinks of their own; counts come from stored rows, whatever the number of triggers."""
    src, out = new_path(spark, "in"), new_path(spark, "out")
    t0 = dt.datetime(2024, 1, 1)
    batches = []
    for b in range(12):
        rows = [(100 * b + i, t0 + dt.timedelta(minutes=30 * b + i), "new") for i in range(6)]
        rows += [(100 * b, t0 + dt.timedelta(minutes=30 * b + 20), "again")]  # in its own batch
        if b:
            rows += [(100 * (b - 1) + 1, t0 + dt.timedelta(minutes=30 * b), "again")]  # of the batch before
        if b > 4:
            rows += [(9000 + b, t0 + dt.timedelta(minutes=30 * b - 120), "late")]
        batches.append(rows)
    schema = "cid long, ts timestamp, kind string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    jobs.run_to_end(jobs.collect_every_row(jobs.read_files(spark, src, spark.createDataFrame([], schema).schema, per_trigger=1), out))
    got = {s: sorted(map(tuple, jobs.collected(spark, out, s).select("cid", "kind").collect())) for s in jobs.SINKS}
    every = [r for rows in batches for r in rows]
    assert got["late"] == sorted((c, k) for c, _, k in every if k == "late")
    assert got["repeat"] == sorted((c, k) for c, _, k in every if k == "again")
    assert got["kept"] == sorted((c, k) for c, _, k in every if k == "new")
    counts = jobs.collected_counts(spark, out).first()
    assert counts.rows_in == len(every) == counts.kept + counts.repeat + counts.late
