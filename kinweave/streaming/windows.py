"""Streams: question sessions and event timelines. Every function takes a batch or a streaming frame."""
from pyspark.sql import DataFrame, functions as F

from kinweave import settings as S
from kinweave.session import shared_dir


def _timed(df, ts, delay):
    """Event time as an instant, with a watermark on streams."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay) if df.isStreaming else df


def sessions(log: DataFrame, user="user_id", ts="ts", delay="10 minutes") -> DataFrame:
    """Sessions of a user: a break longer than the idle time starts a new one."""
    log = _timed(log, ts, delay)
    return log.groupBy(F.col(user), F.session_window(ts, f"{S.SESSION_GAP_SECONDS} seconds").alias("w")).agg(
        F.count("*").alias("n_questions"), F.max(ts).alias("last_ts")).select(
        user, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("last_ts").cast("timestamp_ntz"), "n_questions")


def timeline(event: DataFrame, ts="ts", delay="10 minutes", width="1 day") -> DataFrame:
    """Count and amount per company, type and day."""
    event = _timed(event, ts, delay)
    return event.groupBy("subject_code", "event_type", F.window(ts, width).alias("w")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("amount", F.lit(0.0)).cast("decimal(18,2)")).cast("decimal(28,2)").alias("total_amount")).select(
        "subject_code", "event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total_amount")


def run_to_table(stream: DataFrame, name, mode="append") -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder, and read that."""
    import uuid
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/kinweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def read_stream(spark, folder, name, schema) -> DataFrame:
    """One table of a warehouse folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
