"""Streaming queries over the events and orders files, run to the end of the available data."""

from pyspark.sql import functions as F

from catalog.base import ORDER_COMPOUNDS, proxy_sql, query, table
from catalog.cleaning import RECORD_ERRORS, RECORDS
from catalog.modelling import small_forest
from propspark.session import new_path
from propspark.streaming import jobs


def _stream(spark, sf_dir, name):
    return jobs.read_files(spark, sf_dir, table(spark, sf_dir, name).schema, f"{name}.parquet")


STREAM_RECORDS = {**ORDER_COMPOUNDS, **RECORDS}
SCORE_SQL = f"SELECT pos, CASE WHEN errors = '' THEN 'scored' ELSE 'quarantine' END AS sink, errors AS error FROM (SELECT *, {RECORD_ERRORS} AS errors FROM ({proxy_sql('orders', RECORDS)}))"


@query("stream_scoring", SCORE_SQL)
def stream_scoring(spark, sf_dir):
    _, bundle = small_forest(spark, sf_dir)
    records = _stream(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in STREAM_RECORDS.items()])
    out = new_path(spark, "stream-score")
    jobs.run_to_end(jobs.score_stream(records, [bundle], out))
    both = [jobs.read_scored(spark, out, s).select("pos", F.lit(s).alias("sink"), F.coalesce("error", F.lit("")).alias("error")) for s in ("scored", "quarantine")]
    return both[0].unionByName(both[1])


@query("stream_collection", "SELECT event_id, user_id, event_type, value FROM events")
def stream_collection(spark, sf_dir):
    """Every event arrives twice; each is kept once."""
    events = _stream(spark, sf_dir, "events")
    out = new_path(spark, "stream-collect")
    jobs.run_to_end(jobs.collect_stream(events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), out, "event_id", "ts"))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


@query("stream_every_row", """SELECT count(*) * 2 AS rows_in, count(*) AS kept, count(*) AS repeat, 0::BIGINT AS late FROM events""")
def stream_every_row(spark, sf_dir):
    """Every event arrives twice; the rows of all sinks are counted where they are stored."""
    events = _stream(spark, sf_dir, "events")
    out = new_path(spark, "stream-all")
    jobs.run_to_end(jobs.collect_every_row(events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), out, "event_id", "ts"))
    stored = [jobs.collected(spark, out, s).agg(F.count(F.lit(1)).alias(s)) for s in ("kept", "repeat")]
    counts = jobs.collected_counts(spark, out).select("rows_in", "late")
    return counts.withColumns({c: F.lit(d.first()[0]).cast("bigint") for c, d in zip(("kept", "repeat"), stored)}).select("rows_in", "kept", "repeat", "late")


@query("stream_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    out = new_path(spark, "stream-counts")
    jobs.run_to_end(jobs.count_stream(events, out))
    return _shown(jobs.latest_counts(spark, out))


@query("status_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    return _shown(jobs.status_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")))


def _shown(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
