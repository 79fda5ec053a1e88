"""360 degree profile: profile, hot leads, chats, ad touches and social attributes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import phones as P
from leadloom.functions.numbers import exact_avg, half_up
from leadloom.operators.common import top_per_key


def hot_summary(matched: DataFrame, n: int = 10) -> DataFrame:
    """The n best hot leads of every profile as one array, and their best score."""
    rows = matched.filter("profile_key IS NOT NULL").select("profile_key", "source", "seq", "behavior", "keyword", "hot_score")
    best = top_per_key(rows, "profile_key", [F.desc("hot_score"), "source", "seq"], n, F.col("seq"))
    return best.groupBy("profile_key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "behavior", "keyword", "hot_score"))).alias("behaviors"),
        F.max("hot_score").alias("best_hot"))


def chat_summary(chat_leads: DataFrame) -> DataFrame:
    """Chats of a phone: number, mean quality, ads touched."""
    return (chat_leads.filter("phone IS NOT NULL").groupBy(P.phone_join_key(F.col("phone")).alias("profile_key"))
            .agg(F.count("*").alias("chats"), exact_avg(F.col("quality_score"), 4).alias("agg_quality"),
                 F.count_distinct("fb_ad_id").alias("ad_touches")))


def profile_360(leads: DataFrame, matched: DataFrame, chat_leads: DataFrame, social: DataFrame | None = None) -> DataFrame:
    """Scores, probability and actions per profile; nothing is invented for missing parts."""
    c = F.col
    rows = (leads.drop("behavior").join(hot_summary(matched), "profile_key", "left")
            .join(chat_summary(chat_leads), "profile_key", "left"))
    attributes = {"activity_score": "double", "income": "double", "sector": "string", "children": "int", "age": "int"}
    if social is None:
        rows = rows.withColumns({name: F.lit(None).cast(kind) for name, kind in attributes.items()})
    else:
        rows = rows.join(social.select("profile_key", *attributes), "profile_key", "left")
    zero = F.lit(0.0)
    score, quality = F.coalesce("lead_score", zero), F.coalesce("agg_quality", zero)
    hot = F.coalesce(c("best_hot"), score * F.lit(0.8))
    rows = rows.withColumn("intent_score", half_up(F.least(
        score * F.lit(0.35) + quality * F.lit(0.30) + hot * F.lit(0.20) + F.coalesce("activity_score", zero) * F.lit(0.15), F.lit(10.0)), 1))

    def band(pos):
        out = F.lit(D.PROFILE_PROBABILITY[-1][pos])
        for entry in reversed(D.PROFILE_PROBABILITY[:-1]):
            out = F.when(c("intent_score") >= entry[0], F.lit(entry[pos])).otherwise(out)
        return out

    def cluster(pos):
        out = F.lit(D.PROFILE_UNCLUSTERED[pos])
        for number, entry in D.PROFILE_CLUSTERS.items():
            out = F.when(c("cluster") == number, F.lit(entry[pos])).otherwise(out)
        return out

    def action(cond, priority, order, name):
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(priority).alias("priority"), F.lit(order).alias("ord"), F.lit(name).alias("action")))

    offered = F.array_compact(F.array(
        action(c("intent_score") >= 8, 1, 0, "Gọi điện ngay"), action(c("cluster") == 2, 1, 1, "Chuẩn bị offer VIP"),
        action(quality >= 7, 2, 2, "Đặt lịch xem nhà mẫu"), action(c("sector") == "realestate", 2, 3, "Tư vấn đầu tư"),
        action(c("ad_touches") >= 2, 3, 4, "Gửi tài liệu dự án")))
    fallback = F.array(F.struct(F.lit(3).alias("priority"), F.lit(5).alias("ord"), F.lit("Nuture qua Messenger").alias("action")))

    def bonus(cond, points):
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(zero)

    fit = (F.lit(5.0) + bonus((c("cluster") == 2) & (c("income") >= 40000000), 3.0)
           + bonus((c("cluster") == 0) & c("sector").isin("realestate", "finance"), 2.5)
           + bonus((c("cluster") == 1) & (c("children") > 0), 2.0) + bonus(c("age") >= 30, 1.0))
    return rows.withColumns({
        "cluster_label": cluster(0), "priority": cluster(1), "prob_label": band(1), "prob_pct": band(2),
        "profile_fit": half_up(F.least(fit, F.lit(10.0)), 1), "agg_quality": half_up(quality, 1),
        "n_behaviors": F.coalesce(F.size("behaviors"), F.lit(0)), "chats": F.coalesce("chats", F.lit(0)),
        "ad_touches": F.coalesce("ad_touches", F.lit(0)),
        "actions": F.transform(F.array_sort(F.when(F.size(offered) > 0, offered).otherwise(fallback)), lambda a: a["action"])})
