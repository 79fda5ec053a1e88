"""Interactions and listings: hot scores, matching, profiles, lead scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import dates as DT
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.functions.numbers import half_up
from leadloom.operators import score as S
from leadloom.operators.common import computed_once, join_dimension

BASE_LISTING_SCORE, LISTING_STEP, LISTING_CAP = 3.0, 0.5, 8.0  # fixed values
RECENT_FACTOR, STALE_BELOW = 1.5, 0.3  # fixed values


def behavior_weight(behavior: Column) -> Column:
    out = F.lit(D.BEHAVIOR_WEIGHTS["like"])
    for name, weight in D.BEHAVIOR_WEIGHTS.items():
        out = F.when(behavior == name, F.lit(weight)).otherwise(out)
    return out


def _points(recent: Column) -> Column:
    """Points of an interaction: behaviour weights, recent ones counted 1.5 times."""
    return (behavior_weight(F.col("behavior")) * F.when(recent, F.lit(RECENT_FACTOR)).otherwise(F.lit(1.0))).cast("decimal(20,4)")


def _hot_score(points: Column) -> Column:
    return half_up(F.least(F.sum(points), F.lit(10)), 2).alias("hot_score")


def interaction_scores(interactions: DataFrame, as_of: str) -> DataFrame:
    """Hot score per uid: behaviour weights, recent ones counted 1.5 times, at most 10."""
    return interactions.groupBy("uid").agg(_hot_score(_points(DT.within_days(F.col("ts"), as_of))))


def social_hot_leads(interactions: DataFrame, as_of: str) -> DataFrame:
    """Interaction rows with the score of their uid; stale low scores are dropped."""
    known = interactions.filter("uid <> ''")
    return (join_dimension(known, interaction_scores(known, as_of), "uid", ["event_id"], "inner")
            .filter(F.col("hot_score") >= STALE_BELOW)
            .select(F.lit("facebook").alias("source"), F.col("event_id").alias("seq"), "uid",
                    F.lit(None).cast("string").alias("phone"), "keyword", "behavior", "source_url",
                    "hot_score", F.col("ts").alias("seen_at")))


def social_hot_uids(interactions: DataFrame, as_of: str) -> DataFrame:
    """The same reduced to one row per uid, which is all that profiles need: its score and its first behaviour.

    Rows are counted per uid and behaviour first, by numbers only, so that one
    hash aggregation reads them and no row is sorted or carried as a whole; points
    are made of the counts.
    """
    kinds = interactions.filter("uid <> ''").groupBy("uid", "behavior").agg(
        F.count("*").alias("_n"), F.count_if(DT.within_days(F.col("ts"), as_of)).alias("_recent"), F.min("event_id").alias("_seq"))
    points = _points(F.lit(True)) * F.col("_recent") + _points(F.lit(False)) * (F.col("_n") - F.col("_recent"))
    named = F.struct("_seq", "behavior")
    firsts = kinds.groupBy("uid").agg(
        _hot_score(points), F.min("_seq").alias("_any"), F.min(F.when(F.col("behavior") != "", named)).alias("_first"))
    return (firsts.filter(F.col("hot_score") >= STALE_BELOW)
            .select(F.lit("facebook").alias("source"), F.coalesce("_first._seq", "_any").alias("seq"), "uid",
                    F.lit(None).cast("string").alias("phone"), F.coalesce("_first.behavior", F.lit("")).alias("behavior"), "hot_score"))


def valid_listings(listings: DataFrame) -> DataFrame:
    """Listings with a mobile number; landlines and broken numbers are no leads."""
    return listings.filter(P.phone_e164(F.col("phone")).isNotNull())


def listing_scores(listings: DataFrame) -> DataFrame:
    """One row per valid phone: frequency score, and the first listing's keyword, url and time."""
    scored = F.lit(BASE_LISTING_SCORE) + (F.count("*") - 1) * F.lit(LISTING_STEP)
    phones = listings.filter("phone IS NOT NULL").groupBy("phone").agg(
        half_up(F.least(scored, F.lit(LISTING_CAP)), 2).alias("hot_score"),
        F.count("*").alias("listings"), F.min("id").alias("id"),
        F.min_by(F.struct("keyword", "source_url", "scraped_at"), "id").alias("first"))
    # a number is judged once, not in each of its listings
    judged = computed_once(phones, {"_valid": P.phone_e164(F.col("phone")).isNotNull()})
    return judged.filter("_valid").select("phone", "hot_score", "listings", "id", "first.*")


def listing_hot_leads(listings: DataFrame) -> DataFrame:
    return listing_scores(listings).select(
        F.lit("google").alias("source"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("uid"),
        "phone", "keyword", F.lit("listing").alias("behavior"), "source_url", "hot_score",
        F.col("scraped_at").alias("seen_at"))


def listing_dedup(listings: DataFrame) -> DataFrame:
    """The row with the smallest id of each valid phone."""
    cols = [c for c in listings.columns if c != "phone"]
    return (valid_listings(listings).groupBy("phone").agg(F.min_by(F.struct(*cols), "id").alias("first"))
            .select("phone", "first.*"))


def match_hot_leads(hot: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds the profile of each hot lead: by uid, else by phone."""
    keys = profiles.select("profile_key", "uid")
    by_uid = keys.filter("uid <> ''").groupBy("uid").agg(F.max("profile_key").alias("_by_uid"))
    by_phone = keys.select(F.col("profile_key").alias("_phone_key"),
                               F.col("profile_key").alias("_by_phone")).distinct()
    keyed = hot.withColumn("_phone_key", P.phone_join_key(F.col("phone")))
    row = ["source", "seq"]
    matched = join_dimension(join_dimension(keyed, by_uid, "uid", row), by_phone, "_phone_key", row)
    return (
        matched.withColumn("profile_key", F.coalesce("_by_uid", "_by_phone"))
        .withColumn("is_existing_customer", F.col("profile_key").isNotNull())
        .drop("_by_uid", "_by_phone", "_phone_key")
    )


def profiles_of(contacts: DataFrame) -> DataFrame:
    """Golden contacts with a phone as customer profiles."""
    return contacts.filter("phone IS NOT NULL").select(
        P.phone_join_key(F.col("phone")).alias("profile_key"), "name", "phone", "uid", "email",
        "address", "source", "note")


def new_profiles(matched: DataFrame) -> DataFrame:
    """Unmatched listing leads as profiles of their own."""
    return matched.filter("source = 'google' AND NOT is_existing_customer AND phone <> ''").select(
        P.phone_join_key(F.col("phone")).alias("profile_key"), F.lit("").alias("name"), "phone",
        F.lit("").alias("uid"), F.lit("").alias("email"), F.lit("").alias("address"),
        F.lit("google_scraping").alias("source"),
        F.concat(F.lit("Thu thập từ Google: "), F.coalesce("keyword", F.lit("")), F.lit(" | "),
                 F.coalesce("source_url", F.lit(""))).alias("note"))


def hot_by_profile(matched: DataFrame) -> DataFrame:
    """Best social and search score per matched profile, first behaviour and keyword."""
    social = F.col("source") == "facebook"
    order = F.struct("source", "seq")
    return matched.filter("profile_key IS NOT NULL").groupBy("profile_key").agg(
        F.coalesce(F.max(F.when(social, F.col("hot_score"))), F.lit(0.0)).alias("fb_score"),
        F.coalesce(F.max(F.when(~social, F.col("hot_score"))), F.lit(0.0)).alias("search_score"),
        F.coalesce(F.min_by("behavior", F.when(social & (F.col("behavior") != ""), order)), F.lit("")).alias("behavior"),
        F.coalesce(F.min_by("keyword", F.when(~social & (F.col("keyword") != ""), order)), F.lit("")).alias("keyword"))


def hot_by_phone(matched: DataFrame) -> DataFrame:
    """Best search score per phone, for profiles that no lead was matched to."""
    return (matched.filter("phone <> ''").groupBy(P.phone_join_key(F.col("phone")).alias("profile_key"))
            .agg(F.coalesce(F.max(F.when(F.col("source") != "facebook", F.col("hot_score"))), F.lit(0.0))
                 .alias("phone_search_score")))


def with_hot(profiles: DataFrame, matched: DataFrame) -> DataFrame:
    """Profiles with their hot scores, by id and else by phone; 0 without any."""
    return (
        profiles.join(hot_by_profile(matched), "profile_key", "left")
        .join(hot_by_phone(matched), "profile_key", "left")
        .withColumn("search_score", F.coalesce("search_score", "phone_search_score", F.lit(0.0)))
        .withColumn("fb_score", F.coalesce("fb_score", F.lit(0.0)))
        .drop("phone_search_score")
    )


def with_contact_analytics(profiles: DataFrame, scored: DataFrame) -> DataFrame:
    """Source count, unified score and tier of the contact with the same number."""
    analytics = scored.filter("phone IS NOT NULL").select(
        P.phone_join_key(F.col("phone")).alias("profile_key"), "source_count", "unified_score",
        "source_tier", "source_weight")
    return (profiles.join(analytics, "profile_key", "left")
            .withColumn("source_count", F.coalesce("source_count", F.lit(1).cast("bigint")))
            .withColumn("unified_score", F.coalesce("unified_score", F.lit(0.0)))
            .withColumn("source_tier", F.coalesce("source_tier", F.lit("unknown"))))


def with_lead_score(profiles: DataFrame) -> DataFrame:
    c = F.col
    return profiles.withColumn("lead_score", S.lead_score(
        c("phone"), c("uid"), c("email"), c("cluster"), c("fb_score"), c("search_score"),
        c("source_count"), c("unified_score"), c("source_tier")))


def features(profiles: DataFrame) -> DataFrame:
    """The six columns of the three-cluster model."""
    c = F.col
    return profiles.select(
        "profile_key", c("unified_score").cast("double").alias("unified_score"),
        T.tier_code(c("source_tier")).cast("double").alias("tier_code"),
        F.least(c("source_count"), F.lit(10)).cast("double").alias("source_count"),
        (c("email") != "").cast("double").alias("has_email"), (c("uid") != "").cast("double").alias("has_uid"),
        F.least(c("fb_score") + c("search_score"), F.lit(10.0)).alias("hot_total"))


def search_listings(results: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Phones of search results: title and snippet, then the page of listing domains."""
    domains = domains or D.LISTING_DOMAINS
    domain = T.url_domain(F.col("link"))
    rows = results.withColumn("_trusted", domain.isin(domains)).withColumn(
        "_body", F.when(F.col("_trusted"), P.html_body(F.col("html"))))
    rows = rows.withColumn("_snippet", P.phones_in_text(F.concat_ws(" ", "snippet", "title"))).withColumn(
        "_page", F.when(F.col("_trusted"), P.phones_in_body(F.col("_body"))).otherwise(F.array().cast("array<string>")))
    return rows.select("link", "title", "keyword",
                       F.posexplode(F.array_union("_snippet", "_page")).alias("pos", "phone"))
