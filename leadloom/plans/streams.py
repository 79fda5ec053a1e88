"""Streaming queries: views land as files, the stream runs to the end, its table is returned."""

from pyspark.sql import functions as F

from leadloom.operators import resolve as R
from leadloom.operators.common import one_row
from leadloom.plans import contacts as PC
from leadloom.plans import duck as O
from leadloom.plans.registry import cte, query
from leadloom.plans.views import load
from leadloom.session import new_dir, staged
from leadloom.streaming import jobs as J

c = F.col


def _replay(spark, rows, make, mode, parts=None, order=None):
    """Land rows (in ``parts`` appends by an order column), running the stream after each."""
    path = new_dir(spark, "stream")
    landing, out, checkpoint = f"{path}/landing", f"{path}/out", f"{path}/checkpoint"
    for cond in parts or [F.lit(True)]:
        rows.filter(cond).write.mode("append").parquet(landing)
        J.run_available(make(J.read_stream(spark, landing, rows.schema)), checkpoint, J.batch_writer(out), mode)
    return out


def _land(spark, source, landing):
    """Files arrive by a rename, as whole files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at(landing).getParent())
    if files.exists(at(source)):
        files.rename(at(source), at(landing))


@query("str1_incremental_ingest", """
SELECT lead_key, phone, email, name, source_tier, source_weight, CAST(source_count AS BIGINT) AS source_count FROM {o_golden}""")
def str1_incremental_ingest(spark, sf):
    """Three landings in file order; the stored contacts equal one ingest of everything."""
    path = new_dir(spark, "ingest")
    part = F.when(c("file_name") < "C", 0).when(c("file_name") < "V", 1).otherwise(2)
    rows = PC.raw(spark, sf)
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{path}/outside")  # the contact rows are made once
    for number in range(3):
        _land(spark, f"{path}/outside/part={number}", f"{path}/landing/{number}")
        J.run_available(J.read_stream(spark, f"{path}/landing", rows.schema, f"{path}/archive"), f"{path}/checkpoint",
                        J.ingest_batch(f"{path}/store"))
    return J.stored_contacts(spark, f"{path}/store").select(
        "lead_key", "phone", "email", "name", "source_tier", "source_weight", "source_count")


@query("str2_rolling_interactions", f"""
SELECT uid, CAST(strftime(day, '%Y-%m-%d') AS VARCHAR) AS window_start, {O.rnd("least(10, sum(CASE behavior WHEN 'comment' THEN 3.0 WHEN 'tag' THEN 2.5 WHEN 'share' THEN 2.0 ELSE 0.5 END))", 2)} AS hot_score, count(*) AS events
FROM (SELECT uid, behavior, CAST(ts AS DATE) - CAST(k AS INTEGER) AS day FROM {{v_interactions}}, range(7) r(k) WHERE uid <> '') t GROUP BY uid, day""")
def str2_rolling_interactions(spark, sf):
    """Two landings in order, then the first days once more: too late, so they are left out."""
    return J.rolling_interactions(spark.read.parquet(f"{_panes(spark, sf)}/panes")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("str2_late_rows", """
SELECT count(*) AS accepted, count(*) FILTER (WHERE ts < '2024-01-05') AS late, count(DISTINCT uid) AS uids FROM {v_interactions} WHERE uid <> ''""")
def str2_late_rows(spark, sf):
    """Rows taken and rows left out as too late."""
    path = _panes(spark, sf)
    counts = J.pane_counts(spark, path).agg(F.sum("accepted").alias("accepted"), F.sum("late").alias("late"))
    return one_row(counts, spark.read.parquet(f"{path}/panes").agg(F.count_distinct("uid").alias("uids")))


def _panes(spark, sf):
    rows = load(spark, sf, "v_interactions").select("uid", "behavior", c("ts").cast("timestamp").alias("ts"))
    path = new_dir(spark, "panes")
    for cond in (c("ts") < "2024-01-16", c("ts") >= "2024-01-16", c("ts") < "2024-01-05"):
        rows.filter(cond).write.mode("append").parquet(f"{path}/landing")
        J.run_available(J.read_stream(spark, f"{path}/landing", rows.schema), f"{path}/checkpoint", J.pane_batch(path))
    return path


_CHAT_TS = "CAST(1704067200 + (conv_id % 20) * 86400 + idx * 600 + CASE WHEN conv_id % 7 = 3 AND idx >= 3 THEN 172800 ELSE 0 END AS BIGINT)"
cte("o_chat_ts", f"SELECT conv_id, sender, {_CHAT_TS} AS s FROM {{v_messages}}")


@query("str3_chat_sync", """
SELECT conv_id, min(s) AS session_start, count(*) AS messages, count(*) FILTER (WHERE sender = 'customer') AS customer_messages
FROM (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY s) AS n FROM (
  SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY conv_id ORDER BY s) >= 86400 THEN 1 ELSE 0 END AS brk FROM {o_chat_ts}) a) b GROUP BY conv_id, n""")
def str3_chat_sync(spark, sf):
    """Sessions as the watermark closes them; a last message of no conversation, a month later, closes all."""
    rows = load(spark, sf, "v_messages").select("conv_id", "sender", F.timestamp_seconds(F.expr(_CHAT_TS)).alias("ts"))
    last = rows.agg(F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit("end").alias("sender"),
                    (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    rows = staged(rows.unionByName(last), "messages")
    split = c("ts") < "2024-01-11"
    out = _replay(spark, rows, J.chat_sessions, "append", [split & c("conv_id").isNotNull(), ~split & c("conv_id").isNotNull(), c("conv_id").isNull()])
    done = spark.read.parquet(out).filter("conv_id IS NOT NULL").drop("batch")
    return done.withColumn("session_start", F.unix_timestamp("session_start"))


@query("str4_daily_insights", f"""
SELECT campaign_id, strftime(date_start, '%Y-%m-%d') AS day, CAST({O.esum('spend')} AS DOUBLE) AS spend, CAST(sum(leads) AS BIGINT) AS leads, CAST(sum(clicks) AS BIGINT) AS clicks
FROM {{v_insights}} GROUP BY 1, 2""")
def str4_daily_insights(spark, sf):
    rows = load(spark, sf, "v_insights").select("campaign_id", c("date_start").cast("timestamp").alias("ts"), "spend", "leads", "clicks")
    cuts = [c("ts") < "1998-01-01", c("ts") >= "1998-01-01"]
    out = _replay(spark, rows, J.daily_insights, "update", cuts)
    return J.newest(spark, out, ["campaign_id", "day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("str5_stream_dedup", "SELECT DISTINCT lead_key FROM {o_keyed} WHERE lead_key IS NOT NULL")
def str5_stream_dedup(spark, sf):
    """No state between batches: older keys, whatever their dates, are known from the store."""
    rows = PC.raw(spark, sf).select("raw_phone", "raw_email", c("file_date").cast("timestamp").alias("ts"), "row_id")
    path = new_dir(spark, "keys")
    for cond in (c("row_id") % 2 == 0, c("row_id") % 2 == 1):
        rows.filter(cond).write.mode("append").parquet(f"{path}/landing")
        stream = J.read_stream(spark, f"{path}/landing", rows.schema)
        keyed = R.lead_keys(stream.withColumns({"phone": PC.P.phone_local(c("raw_phone")), "email": PC.T.email_clean(c("raw_email"))}))
        J.run_available(keyed.filter("lead_key IS NOT NULL"), f"{path}/checkpoint", J.fresh_keys(path, 16))
    return spark.read.parquet(f"{path}/fresh").select("lead_key")
