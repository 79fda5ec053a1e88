"""Recurring jobs as Structured Streaming.

Results are written per micro-batch into a folder named by the batch number,
so a repeated batch replaces its own output.
"""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.numbers import exact_sum, half_up
from leadloom.operators.enrich import behavior_weight
from leadloom.session import staged
from leadloom.store import ContactStore, merge_batch


def read_stream(spark: SparkSession, path: str, schema, archive: str | None = None) -> DataFrame:
    """Files of a landing folder; finished ones move to ``archive`` when given."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Process everything that has landed, then stop; returns the progress reports of the run's batches."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of every key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


# --- incremental ingest ----------------------------------------------------
def ingest_batch(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Merge a batch of raw contact rows into the next version of the store at ``path``: only touched buckets are rewritten."""
    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(ContactStore(batch.sparkSession, path, buckets), batch, f"{number:012d}")
    return merge


def stored_contacts(spark: SparkSession, path: str) -> DataFrame:
    return ContactStore(spark, path).contacts()


# --- windows ---------------------------------------------------------------
def pane_batch(path: str, late: str = "1 day") -> Callable[[DataFrame, int], None]:
    """Write the daily partial sums (uid, day, points, events) of a batch of interactions, and count what came too late.

    A pane is closed once the newest event of earlier batches is more than ``late``
    past its end; rows of closed panes are left out and counted.  Both counts and
    the newest event are kept beside the panes per batch, so that no state lives
    between batches and a repeated batch replaces its own files.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = pane_counts(spark, path)
        before = None if seen is None else seen.filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        day = F.date_trunc("day", "ts")
        closed = F.lit(False) if before is None else F.coalesce(
            day + F.expr("INTERVAL 1 DAY") <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {late}"), F.lit(False))
        rows = batch.filter("uid <> '' AND ts IS NOT NULL").withColumns({"day": day, "closed": closed})
        points = behavior_weight(F.col("behavior")).cast("decimal(20,4)")
        panes = rows.filter("NOT closed").groupBy("uid", "day").agg(F.sum(points).alias("points"), F.count("*").alias("events"))
        panes.write.mode("overwrite").parquet(f"{path}/panes/batch={number}")
        counts = rows.agg(F.count_if(~F.col("closed")).alias("accepted"), F.count_if("closed").alias("late"), F.max("ts").alias("newest"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
    return write


def pane_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """(accepted, late, newest, batch): one row per batch; None before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("accepted LONG, late LONG, newest TIMESTAMP, batch LONG").parquet(f"{path}/counts")


def rolling_interactions(panes: DataFrame, days: int = 7) -> DataFrame:
    """Behaviour points per uid, at most 10, in windows of ``days`` that slide by a day: each the sum of its panes.

    Batches are reduced to one pane per uid and day first; only panes, not events, meet several windows.
    """
    daily = panes.groupBy("uid", "day").agg(F.sum("points").alias("points"), F.sum("events").alias("events"))
    starts = F.sequence(F.col("day") - F.make_dt_interval(F.lit(days - 1)), F.col("day"), F.expr("INTERVAL 1 DAY"))
    return (daily.withColumn("window_start", F.explode(starts)).groupBy("uid", "window_start")
            .agg(half_up(F.least(F.sum("points"), F.lit(10)), 2).alias("hot_score"), F.sum("events").alias("events")))


def chat_sessions(stream: DataFrame, gap: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Messages per conversation and session, for append mode: a session is given out, and its state dropped, when the watermark has passed it."""
    return (stream.withWatermark("ts", late).groupBy("conv_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("messages"), F.count_if(F.col("sender") == "customer").alias("customer_messages"))
            .select("conv_id", F.col("w.start").alias("session_start"), "messages", "customer_messages"))


def conversation_totals(sessions: DataFrame) -> DataFrame:
    """Sessions and messages of every conversation over its closed sessions."""
    return sessions.groupBy("conv_id").agg(
        F.count("*").alias("sessions"), F.sum("messages").alias("messages"), F.sum("customer_messages").alias("customer_messages"),
        F.max("session_start").alias("last_session"))


def daily_insights(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Spend, leads and clicks per campaign and day."""
    return (stream.withWatermark("ts", late).groupBy("campaign_id", F.window("ts", "1 day").alias("w"))
            .agg(exact_sum(F.col("spend")).cast("double").alias("spend"), F.sum("leads").alias("leads"), F.sum("clicks").alias("clicks"))
            .select("campaign_id", F.col("w.start").alias("day"), "spend", "leads", "clicks"))


def first_keys(stream: DataFrame, key: Column, late: str = "2 days") -> DataFrame:
    """Lead keys without repetitions within the watermark, which bounds the state, for feeds in order of time.

    Keys of rows that are later than the watermark are dropped; ``fresh_keys``
    takes rows in any order and knows keys of any age.
    """
    return stream.withColumn("lead_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["lead_key"])


def fresh_keys(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Write the keys of a batch that were never seen, however long ago, to ``path``/fresh and add them to the store of known keys.

    The stored keys lie in hash buckets; the exact anti-join reads the buckets
    that the batch's keys fall into.  A repeated batch is compared with what was
    known before its first run.
    """
    def write(batch: DataFrame, number: int) -> None:
        store, version = ContactStore(batch.sparkSession, f"{path}/known", buckets), f"{number:012d}"
        base = store.before(version)
        keys = staged(batch.select("lead_key").filter("lead_key IS NOT NULL").distinct(), "keys")
        known = store.known_keys(keys, base)
        fresh = keys if known is None else keys.join(known, "lead_key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/fresh/batch={number}")
        store.add_keys(batch.sparkSession.read.schema("lead_key string").parquet(f"{path}/fresh/batch={number}"), version, base)
    return write
