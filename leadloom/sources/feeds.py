"""Landed feeds: interaction exports, insights, lead forms, conversations, search results, profiles."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.common import join_dimension

from leadloom import dictionaries as D

INSIGHT_SCHEMA = ("campaign_id STRING, adset_id STRING, adset_name STRING, ad_id STRING, date_start STRING, impressions BIGINT, "
                  "clicks BIGINT, spend DOUBLE, cpm DOUBLE, cpc DOUBLE, ctr DOUBLE, frequency DOUBLE, reach BIGINT, leads BIGINT, "
                  "actions ARRAY<STRUCT<action_type: STRING, value: BIGINT>>")
FORM_SCHEMA = "id STRING, ad_id STRING, created_time STRING, field_data ARRAY<STRUCT<name: STRING, values: ARRAY<STRING>>>"
CONVERSATION_SCHEMA = "id STRING, thread_key STRING, messages ARRAY<STRUCT<idx: BIGINT, sender: STRING, message: STRING, created_time: STRING>>"
SEARCH_SCHEMA = "title STRING, link STRING, snippet STRING, keyword STRING, html STRING"
PROFILE_SCHEMA = "fb_uid STRING, synced_at BIGINT, profile_data STRUCT<name: STRING, city: STRING>, messages ARRAY<STRING>"


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def read_interaction_csv(spark: SparkSession, path: str) -> DataFrame:
    """Interaction exports: uid or facebook_uid, post_url or url, behaviour (like by default)."""
    raw = spark.read.option("header", "true").csv(path)
    for name in ("uid", "facebook_uid", "post_url", "url", "behavior", "keyword", "timestamp"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return raw.select(
        F.coalesce(_text("uid"), _text("facebook_uid")).alias("uid"),
        F.coalesce(_text("post_url"), F.col("url"), F.lit("")).alias("source_url"),
        F.lower(F.coalesce(F.nullif("behavior", F.lit("")), F.lit("like"))).alias("behavior"),
        F.coalesce("keyword", F.lit("")).alias("keyword"),
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts")).filter("uid IS NOT NULL")


def lead_count(leads: Column, actions: Column) -> Column:
    """The leads field, else the first lead action, else 0."""
    found = F.filter(actions, lambda a: a["action_type"].isin(D.LEAD_ACTION_TYPES))
    return F.coalesce(leads, F.get(found, F.lit(0))["value"], F.lit(0).cast("bigint"))


def read_insights_json(spark: SparkSession, path: str) -> DataFrame:
    """Insight records with defaults and casts."""
    raw = spark.read.schema(INSIGHT_SCHEMA).json(path)
    zero = {c: 0 for c in ("impressions", "clicks", "reach")} | {c: 0.0 for c in ("spend", "cpm", "cpc", "ctr", "frequency")}
    return raw.select(
        "campaign_id", F.coalesce("adset_id", F.lit("")).alias("adset_id"),
        F.coalesce("adset_name", "adset_id", F.lit("")).alias("adset_name"), F.coalesce("ad_id", F.lit("")).alias("ad_id"),
        F.col("date_start").try_cast("date").alias("date_start"), *zero,
        lead_count(F.col("leads"), F.col("actions")).alias("leads")).fillna(zero)


def read_lead_forms(spark: SparkSession, path: str) -> DataFrame:
    """Form submissions flattened to name, phone and e-mail, all fields kept as JSON."""
    raw = spark.read.schema(FORM_SCHEMA).json(path)
    fields = F.map_from_entries(F.transform("field_data", lambda f: F.struct(
        f["name"], F.coalesce(F.get(f["values"], F.lit(0)), F.lit("")))))

    def first(*names):
        return F.coalesce(*[F.nullif(F.element_at("_f", n), F.lit("")) for n in names], F.lit(""))

    return raw.withColumn("_f", fields).select(
        F.col("id").alias("submission_id"), F.col("ad_id").alias("fb_ad_id"), "created_time",
        first("full_name", "name").alias("name"), first("phone_number", "phone").alias("phone"), first("email").alias("email"),
        F.to_json("_f").alias("raw_fields"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """One row per message of landed conversations."""
    raw = spark.read.schema(CONVERSATION_SCHEMA).json(path)
    return raw.select(F.col("id").alias("conversation_id"), "thread_key", F.explode("messages").alias("m")).select(
        "conversation_id", "thread_key", "m.idx", "m.sender", F.col("m.message").alias("text"), "m.created_time")


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_SCHEMA).json(path)


def merge_profile_payloads(profiles: DataFrame, payloads: DataFrame) -> DataFrame:
    """The latest payload of each uid merged into the profile's JSON note; profiles without uid are left alone."""
    latest = payloads.groupBy("fb_uid").agg(F.max_by(F.struct("profile_data", "messages"), "synced_at").alias("p"))
    kept = F.coalesce(F.from_json("note", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(kept, lambda k, _: ~k.isin("extension_profile", "extension_messages"))
    merged = F.to_json(F.map_concat(kept, F.create_map(
        F.lit("extension_profile"), F.to_json("p.profile_data"), F.lit("extension_messages"), F.to_json("p.messages"))))
    known = profiles.withColumn("_uid", F.nullif("uid", F.lit("")))
    latest = latest.filter("fb_uid <> ''").withColumnRenamed("fb_uid", "_uid")
    row = [c for c in ("profile_key", "phone", "name", "note") if c in profiles.columns]
    return (join_dimension(known, latest, "_uid", row)
            .withColumn("synced", F.col("p").isNotNull())
            .withColumn("name", F.coalesce("p.profile_data.name", "name"))
            .withColumn("note", F.when(F.col("synced"), merged).otherwise(F.col("note"))).drop("p", "_uid"))
