"""Structured Streaming jobs: scoring, incremental collection, running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from propspark.operators.learning import ModelBundle, score_batch


def read_files(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of a folder; the schema is declared, never inferred."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, bundles: Sequence[ModelBundle], out: str, smiles: str = "smiles",
                 mass: str = "molecular_weight", key: str = "cid", checkpoint: str | None = None) -> StreamingQuery:
    """Score arriving rows; good rows go to ``out/scored``, bad ones to ``out/quarantine``.

    Each micro-batch is scored once and written under its batch id, so a repeated
    batch replaces its own files.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one write, split by folder: the batch is read and scored a single time
        part = F.when(F.col("status") == "ok", "scored").otherwise("quarantine")
        scored = score_batch(batch, bundles, smiles, mass, key).withColumn("sink", part).withColumn("batch_id", F.lit(batch_id))
        scored.write.mode("overwrite").partitionBy("sink").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(sink).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or f"{out}/_checkpoint").start()
    )


def read_scored(spark: SparkSession, out: str, sink: str = "scored") -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*/sink={sink}")


def collect_stream(stream: DataFrame, out: str, key: str = "cid", time: str = "ts", delay: str = "1 hour",
                   checkpoint: str | None = None) -> StreamingQuery:
    """Append each key once; repeats within the watermark delay are dropped, state stays bounded by it."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return (
        timed.dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").outputMode("append")
        .trigger(availableNow=True).option("path", out)
        .option("checkpointLocation", checkpoint or f"{out}/_checkpoint").start()
    )


SINKS = ("kept", "repeat", "late")


def collect_every_row(stream: DataFrame, out: str, key: str = "cid", time: str = "ts", delay: str = "1 hour",
                      checkpoint: str | None = None) -> StreamingQuery:
    """Like ``collect_stream``, but no row is lost: each goes to one of the sinks ``kept``, ``repeat`` and ``late`` below ``out``.

    A row is late if its time lies behind the newest time of the batches before by more than ``delay``, and a repeat if
    its key was kept by them not longer than ``delay`` before that, or stands earlier in its batch (by time, then by
    all columns). A batch is judged by the stored rows of earlier batches alone and written under its number, so a repeated batch
    gives the same rows and replaces its own files. Kept rows are stored by hour, and only the hours that still matter are read.
    """
    spark = stream.sparkSession
    columns = stream.columns
    hours = f"{out}/kept"

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(time, F.col(time).cast("timestamp"))
        floor = _newest(spark, out, batch_id)
        limit = F.lit(None).cast("timestamp") if floor is None else F.lit(floor).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        judged = rows.withColumn("_late", F.coalesce(F.col(time) < limit, F.lit(False)))
        order = Window.partitionBy(key).orderBy(time, *[F.col(c).cast("string") for c in columns if c not in (key, time)])
        fresh = judged.where(~F.col("_late")).withColumn("_rank", F.row_number().over(order))
        if floor is not None:
            since = limit - F.expr(f"INTERVAL {delay}")
            before = spark.read.schema(_with_places(rows)).option("basePath", hours).parquet(hours).where(
                (F.col("batch") < batch_id) & (F.col("hour") >= F.date_format(since, HOUR)) & (F.col(time) >= since))
            fresh = fresh.join(before.select(F.col(key).alias("_key")).distinct(), F.col(key).eqNullSafe(F.col("_key")), "left")
        else:
            fresh = fresh.withColumn("_key", F.lit(None).cast(rows.schema[key].dataType))
        seen = F.col("_key").isNotNull() | (F.col("_rank") > 1)
        told = fresh.select(*columns, F.when(seen, "repeat").otherwise("kept").alias("sink")).unionByName(
            judged.where("_late").select(*columns, F.lit("late").alias("sink")))
        # written once, then dealt out: the batch is read and judged a single time
        whole = f"{out}/_judged/batch={batch_id}"
        told.write.mode("overwrite").parquet(whole)
        told = spark.read.schema(told.schema).parquet(whole)
        for name in SINKS:
            part = told.where(F.col("sink") == name).drop("sink")
            if name == "kept":
                part.withColumn("hour", F.date_format(time, HOUR)).write.mode("overwrite").partitionBy("hour").parquet(f"{hours}/batch={batch_id}")
            else:
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        newest = told.agg(F.max(time).alias("newest"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("sink") == s).alias(s) for s in SINKS])
        newest.coalesce(1).write.mode("overwrite").parquet(f"{out}/_counts/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(sink).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or f"{out}/_checkpoint").start()
    )


def status_counts(df: DataFrame, time: str = "ts", status: str = "status", width: str = "1 hour") -> DataFrame:
    """Rows per time window and status; the same expression for batch and stream."""
    return df.groupBy(F.window(time, width).alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), status, "n")


def count_stream(stream: DataFrame, out: str, time: str = "ts", status: str = "status", width: str = "1 hour",
                 delay: str = "1 hour", checkpoint: str | None = None) -> StreamingQuery:
    """Running counts; each micro-batch writes the windows it changed under its batch id."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        status_counts(timed, time, status, width).writeStream.outputMode("update").foreachBatch(sink)
        .trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{out}/_checkpoint").start()
    )


def latest_counts(spark: SparkSession, out: str, status: str = "status") -> DataFrame:
    """The newest count of every window and status."""
    rows = spark.read.parquet(f"{out}/batch=*")
    return rows.groupBy("window_start", status).agg(F.max_by("n", "batch_id").alias("n"))


HOUR = "yyyy-MM-dd-HH"


def _with_places(rows: DataFrame) -> StructType:
    """Schema of stored rows with the folders' columns."""
    return StructType([*rows.schema.fields, StructField("batch", LongType()), StructField("hour", StringType())])


def _counts(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{out}/_counts").parquet(f"{out}/_counts")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _newest(spark: SparkSession, out: str, batch_id: int):
    """Newest time of the batches before; one short row for each is stored."""
    counts = _counts(spark, out)
    return None if counts is None else counts.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]


def collected(spark: SparkSession, out: str, sink: str = "kept") -> DataFrame:
    """Rows that ``collect_every_row`` sent to a sink."""
    return spark.read.option("basePath", f"{out}/{sink}").parquet(f"{out}/{sink}").drop("batch", "hour")


def collected_counts(spark: SparkSession, out: str) -> DataFrame:
    """``rows_in, kept, repeat, late`` over all batches, from what each of them stored."""
    return _counts(spark, out).agg(F.sum("n").alias("rows_in"), *[F.sum(s).alias(s) for s in SINKS])


def run_to_end(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for an ``availableNow`` run and raise its error, if any; ``seconds`` is a limit (none by default)."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream did not finish within {seconds} s")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful steps of the last triggers dropped because they came behind the watermark.

    A query remembers 100 triggers; ``collect_every_row`` keeps the rows themselves and counts all of them.
    """
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
