"""Queries over campaigns, insights and chat leads."""

from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import numbers as N
from leadloom.operators import ads as A
from leadloom.operators import content as K
from leadloom.operators import score as S
from leadloom.operators.common import join_dimension
from leadloom.plans import duck as O
from leadloom.plans.registry import cte, query
from leadloom.plans.reports import leads as profile_leads
from leadloom.plans.views import load
from leadloom.session import staged

c = F.col
BMS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _v(name):
    return lambda spark, sf: load(spark, sf, name)


insights, campaigns, adsets, ads, chats = (_v(n) for n in ("v_insights", "v_campaigns", "v_adsets", "v_ads", "v_chat_leads"))


def costs(spark, sf):
    return A.campaign_costs(A.insights_slice(insights(spark, sf), "adset"))


def scored_chats(spark, sf):
    return A.scored_chat_leads(chats(spark, sf), profile_leads(spark, sf).select("profile_key", "lead_score"))


def chat_only(spark, sf):
    """Chat leads scored by chat signals only, the profile scores left out."""
    return chats(spark, sf).withColumn("quality", S.chat_quality(
        c("sender_name"), c("phone"), c("email"), c("intent_score"), c("message_count"), F.lit(False), F.lit(0.0)))


def per_ad(spark, sf):
    return A.ad_quality(chat_only(spark, sf))


def tree(spark, sf):
    return A.ad_tree(campaigns(spark, sf), adsets(spark, sf), ads(spark, sf))


def matrix(spark, sf):
    return A.quality_cost_matrix(costs(spark, sf), A.campaign_quality(per_ad(spark, sf), tree(spark, sf)), campaigns(spark, sf))


def by_type(spark, sf):
    return K.content_performance(insights(spark, sf), campaigns(spark, sf), chats(spark, sf))


def _rating(metric, x):
    good, medium = D.COST_BENCHMARKS[metric]
    op = ">=" if metric in D.HIGHER_IS_BETTER else "<="
    return f"CASE WHEN {x} {op} {good}e0 THEN 'good' WHEN {x} {op} {medium}e0 THEN 'medium' ELSE 'poor' END"


def _slice(keys, where="TRUE"):
    return f"""
SELECT {keys}, impressions, clicks, leads, reach, spend, {O.rate('clicks', 'impressions', 6, 100)} AS ctr,
       {O.rate('spend', 'impressions', 6, 1000)} AS cpm, {O.rate('spend', 'clicks', 6, 1)} AS cpc, {O.rate('impressions', 'reach', 6, 1)} AS frequency
FROM (SELECT {keys}, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(leads) AS BIGINT) AS leads,
             CAST(sum(reach) AS BIGINT) AS reach, {O.esum('spend')} AS spend FROM {{v_insights}} WHERE {where} GROUP BY {keys}) t"""


cte("o_adset_slice", _slice("campaign_id, adset_id"))
_MEANS = {m: O.safe(f"s_{m}", "n") for m in ("cpm", "ctr", "cpc", "frequency")}
cte("o_costs", f"""
SELECT campaign_id, CAST(total_spend AS DOUBLE) AS total_spend, total_clicks, total_leads, total_reach, total_impressions, cpl, conv_rate,
       {', '.join(f"{O.rnd(v, 2)} AS avg_{m}, {_rating(m, v)} AS rating_{m}" for m, v in _MEANS.items())},
       {_rating('cpl', 'cpl')} AS rating_cpl, {_rating('conv_rate', 'conv_rate')} AS rating_conv_rate
FROM (SELECT *, {O.rate('total_spend', 'total_leads', 0, 1)} AS cpl, {O.rate('total_leads', 'total_clicks', 2, 100)} AS conv_rate
      FROM (SELECT campaign_id, count(*) AS n, {O.esum('spend')} AS total_spend, CAST(sum(clicks) AS BIGINT) AS total_clicks,
                   CAST(sum(leads) AS BIGINT) AS total_leads, CAST(sum(reach) AS BIGINT) AS total_reach, CAST(sum(impressions) AS BIGINT) AS total_impressions,
                   {', '.join(f"{O.esum(m)} AS s_{m}" for m in _MEANS)}
            FROM {{o_adset_slice}} GROUP BY campaign_id) a) b""")


@query("src10_insights_slice", _slice("campaign_id, adset_id, date_start", "date_start BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'").replace(
    "SELECT campaign_id, adset_id, date_start, impressions, clicks, leads, reach, spend,", "SELECT campaign_id, adset_id, date_start, impressions, clicks, leads, reach, CAST(spend AS DOUBLE) AS spend,", 1))
def src10_insights_slice(spark, sf):
    return A.insights_slice(insights(spark, sf), "adset", "1995-01-01", "2001-12-31", daily=True).withColumn("spend", c("spend").cast("double"))


@query("mth3_safe_ratio", f"""
SELECT campaign_id, {O.rate('spend', 'leads', 0, 1)} AS cpl, {O.rate('leads', 'clicks', 2, 100)} AS conv_rate, {O.rate('spend', 'impressions', 2, 1000)} AS cpm,
       {O.rate('clicks', 'impressions', 2, 100)} AS ctr
FROM (SELECT campaign_id, {O.esum('spend')} AS spend, sum(leads) AS leads, sum(clicks) AS clicks, sum(impressions) AS impressions FROM {{v_insights}} GROUP BY 1) t""")
def mth3_safe_ratio(spark, sf):
    s = A.insights_slice(insights(spark, sf), "campaign")
    return s.select("campaign_id", A.compute_cpl(c("spend"), c("leads")).alias("cpl"), N.rate(c("leads"), c("clicks"), 2, 100).alias("conv_rate"),
                    N.rate(c("spend"), c("impressions"), 2, 1000).alias("cpm"), N.rate(c("clicks"), c("impressions"), 2, 100).alias("ctr"))


@query("mth4_rate_metric", "SELECT campaign_id, adset_id, " + ", ".join(f"{_rating(m, m)} AS {m}" for m in ("ctr", "cpm", "cpc", "frequency")) + " FROM {o_adset_slice}")
def mth4_rate_metric(spark, sf):
    return A.insights_slice(insights(spark, sf), "adset").select(
        "campaign_id", "adset_id", *[A.rate_metric(m, c(m)).alias(m) for m in ("ctr", "cpm", "cpc", "frequency")])


@query("agg20_campaign_cost", "SELECT * FROM {o_costs}")
def agg20_campaign_cost(spark, sf):
    return costs(spark, sf)


@query("agg21_cost_report", f"""
SELECT campaign_id, count(*) AS campaigns, CAST({O.esum('total_spend')} AS DOUBLE) AS total_spend, CAST(sum(total_leads) AS BIGINT) AS total_leads,
       {O.rate(O.esum('total_spend'), 'sum(total_leads)', 0, 1)} AS cpl
FROM {{v_campaigns}} JOIN {{o_costs}} USING (campaign_id) GROUP BY ROLLUP (campaign_id)""")
def agg21_cost_report(spark, sf):
    return A.cost_report(costs(spark, sf), campaigns(spark, sf))


_ALERTS = [("HIGH_CPL", "critical", "cpl", "leads > 0 AND cpl > 400000"), ("AD_FATIGUE", "warning", "frequency", "frequency > 3.5e0"),
           ("LOW_CTR", "warning", "ctr", "ctr < 1e0"), ("CPM_SPIKE", "warning", "cpm", "cpm > 200000")]
cte("o_adset_cpl", f"SELECT *, {O.rate('spend', 'leads', 0, 1)} AS cpl FROM {{o_adset_slice}}")


@query("scr11_anomaly_alerts", " UNION ALL ".join(
    f"SELECT campaign_id, adset_id, '{t}' AS type, '{s}' AS severity, {v} AS value FROM {{o_adset_cpl}} WHERE {w}" for t, s, v, w in _ALERTS))
def scr11_anomaly_alerts(spark, sf):
    return A.anomalies(A.insights_slice(insights(spark, sf), "adset"))


# --- quality ---------------------------------------------------------------
def _quality(profile):
    points = f"""(CASE WHEN sender_name <> '' THEN 1e0 ELSE 0e0 END) + (CASE WHEN phone IS NOT NULL THEN 1.5e0 ELSE 0e0 END) + (CASE WHEN email IS NOT NULL THEN 0.5e0 ELSE 0e0 END)
 + least(3e0, intent_score * 0.3e0) + (CASE WHEN message_count >= 6 THEN 2e0 WHEN message_count >= 4 THEN 1.5e0 WHEN message_count >= 2 THEN 1e0 ELSE 0e0 END)
 + (CASE WHEN message_count >= 10 THEN 2e0 WHEN message_count >= 6 THEN 1e0 WHEN message_count >= 3 THEN 0.5e0 ELSE 0e0 END)
 + (CASE WHEN {profile} >= 8 THEN 1e0 WHEN {profile} >= 6 THEN 0.5e0 ELSE 0e0 END)"""
    return O.rnd(f"least(10e0, {points})", 2)


cte("o_chat_scored", f"""
SELECT v.*, coalesce(l.lead_score, 0e0) AS profile_score, {_quality('coalesce(l.lead_score, 0e0)')} AS quality
FROM (SELECT * FROM {{v_chat_leads}}) v LEFT JOIN (SELECT profile_key, lead_score FROM {{o_leads}}) l ON l.profile_key = '+84' || substr(v.phone, 2)""")
cte("o_per_ad", f"""
SELECT fb_ad_id, count(*) AS lead_count, {O.eavg('quality', 2)} AS avg_quality, {O.esum('quality')} AS quality_sum,
       count(*) FILTER (WHERE quality >= 7) AS high, count(*) FILTER (WHERE quality >= 4 AND quality < 7) AS medium, count(*) FILTER (WHERE quality < 4) AS low
FROM (SELECT *, {_quality('0')} AS quality FROM {{v_chat_leads}}) t GROUP BY fb_ad_id""")


@query("join8_lead_profile", "SELECT conversation_id, phone, profile_score FROM {o_chat_scored}")
def join8_lead_profile(spark, sf):
    return scored_chats(spark, sf).select("conversation_id", "phone", "profile_score")


@query("scr9_chat_quality", "SELECT conversation_id, quality FROM {o_chat_scored}")
def scr9_chat_quality(spark, sf):
    return scored_chats(spark, sf).select("conversation_id", "quality")


@query("agg22_ad_quality", "SELECT fb_ad_id, lead_count, avg_quality, high, medium, low FROM {o_per_ad}")
def agg22_ad_quality(spark, sf):
    return per_ad(spark, sf).drop("quality_sum")


@query("agg22_ad_scores", f"SELECT fb_ad_id, quality, count(*) AS leads FROM (SELECT fb_ad_id, {_quality('0')} AS quality FROM {{v_chat_leads}}) t GROUP BY 1, 2")
def agg22_ad_scores(spark, sf):
    return A.ad_score_histogram(chat_only(spark, sf))


@query("join10_ad_tree", """
SELECT c.campaign_id, count(DISTINCT a.adset_id) AS adsets, count(*) AS ads FROM {v_campaigns} c JOIN {v_adsets} a USING (campaign_id) JOIN {v_ads} d USING (adset_id) GROUP BY 1""")
def join10_ad_tree(spark, sf):
    return tree(spark, sf).groupBy("campaign_id").agg(F.count_distinct("adset_id").alias("adsets"), F.count("*").alias("ads"))


cte("o_tree", "SELECT c.campaign_id, c.campaign_name, c.status, d.adset_id, d.ad_id FROM {v_campaigns} c JOIN {v_adsets} a USING (campaign_id) JOIN {v_ads} d USING (adset_id)")
cte("o_campaign_quality", f"""
SELECT *, {O.rnd('CAST(avg_quality AS DECIMAL(18,4)) * 0.6 + CAST(high_ratio_pct AS DECIMAL(18,4)) * 0.04', 2)} AS rank_score
FROM (SELECT campaign_id, campaign_name, status, CAST(sum(lead_count) AS BIGINT) AS total_leads, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium,
             CAST(sum(low) AS BIGINT) AS low, {O.rate('sum(quality_sum)', 'sum(lead_count)', 2, 1)} AS avg_quality, {O.rate('sum(high)', 'sum(lead_count)', 1, 100)} AS high_ratio_pct
      FROM {{o_tree}} JOIN {{o_per_ad}} ON ad_id = fb_ad_id GROUP BY 1, 2, 3) t""")


@query("agg23_campaign_quality_rank", "SELECT * FROM {o_campaign_quality}")
def agg23_campaign_quality_rank(spark, sf):
    return A.campaign_quality(per_ad(spark, sf), tree(spark, sf)).orderBy(F.desc("rank_score"), "campaign_id")


cte("o_adset_quality", f"SELECT adset_id, {O.eavg('avg_quality', 4)} AS avg_quality FROM {{o_tree}} JOIN {{o_per_ad}} ON ad_id = fb_ad_id GROUP BY adset_id")


@query("agg24_adset_quality", "SELECT * FROM {o_adset_quality}")
def agg24_adset_quality(spark, sf):
    return A.adset_quality(per_ad(spark, sf), tree(spark, sf))


_QUAD = "CASE WHEN avg_quality >= 6 AND cpl <= 200000 THEN 1 WHEN avg_quality >= 6 THEN 2 WHEN cpl <= 200000 THEN 3 ELSE 4 END"
cte("o_matrix", f"""
SELECT *, CASE priority {' '.join(f"WHEN {i + 1} THEN '{q}'" for i, (q, _) in enumerate(D.QUADRANTS))} END AS quadrant,
       CASE priority {' '.join(f"WHEN {i + 1} THEN {O.lit(lb)}" for i, (_, lb) in enumerate(D.QUADRANTS))} END AS label
FROM (SELECT *, {_QUAD} AS priority FROM (
  SELECT c.campaign_id, c.campaign_name, o.cpl, coalesce(q.avg_quality, 0e0) AS avg_quality, coalesce(q.total_leads, 0) AS total_leads, o.total_spend
  FROM {{v_campaigns}} c JOIN {{o_costs}} o USING (campaign_id) LEFT JOIN {{o_campaign_quality}} q ON q.campaign_id = c.campaign_id) a) b""")


@query("join11_quality_cost", "SELECT campaign_id, cpl, avg_quality, total_leads, total_spend FROM {o_matrix}")
def join11_quality_cost(spark, sf):
    return matrix(spark, sf).select("campaign_id", "cpl", "avg_quality", "total_leads", "total_spend")


@query("scr10_quadrant", "SELECT campaign_id, quadrant, label, CAST(priority AS INTEGER) AS priority FROM {o_matrix}")
def scr10_quadrant(spark, sf):
    return matrix(spark, sf).select("campaign_id", "quadrant", "label", "priority")


@query("srt8_matrix_priority", "SELECT campaign_id, campaign_name, quadrant FROM {o_matrix}")
def srt8_matrix_priority(spark, sf):
    return matrix(spark, sf).orderBy("priority", "campaign_id").select("campaign_id", "campaign_name", "quadrant")


_N = "format('{:,}', CAST(cpl AS BIGINT))"


def _one(x):
    return f"CAST({O.rnd(x, 1)} AS VARCHAR)"


cte("o_rule_rows", """
SELECT c.campaign_name AS campaign, c.campaign_id, a.adset_id, a.adset_name, a.daily_budget, o.cpl, o.avg_ctr AS ctr, o.avg_frequency AS frequency,
       coalesce(q.avg_quality, 0e0) AS avg_quality
FROM {v_campaigns} c JOIN {v_adsets} a USING (campaign_id) JOIN {o_costs} o ON o.campaign_id = c.campaign_id LEFT JOIN {o_adset_quality} q ON q.adset_id = a.adset_id
WHERE c.status <> 'DELETED'""")
_COST_TEXT = f"'CPL ' || {_N} || 'đ & quality ' || {_one('avg_quality')}"
_RULES = [
    ("PAUSE", "pause_adset", _COST_TEXT, "NULL", "cpl > 500000 AND avg_quality < 4"),
    ("SCALE", "update_budget", _COST_TEXT, "floor(daily_budget * 1.5e0)", "cpl > 0 AND cpl < 150000 AND avg_quality >= 7"),
    ("TEST_BUDGET", "update_budget", "'CTR ' || CAST(ctr AS VARCHAR) || '%'", "floor(daily_budget * 0.7e0)", "ctr > 0 AND ctr < 1"),
    ("FREQ_CAP", "pause_adset", f"'Frequency ' || {_one('frequency')} || 'x'", "NULL", "frequency > 3.5e0"),
    ("WINNER", "duplicate_adset", f"'Quality ' || {_one('avg_quality')}", "floor(daily_budget * 2e0)", "avg_quality >= 8 AND cpl > 0 AND cpl < 300000"),
]
cte("o_actions", " UNION ALL ".join(
    f"SELECT campaign, campaign_id, adset_id, adset_name, cpl, ctr, frequency, avg_quality, '{r}' AS rule, '{a}' AS action, {t} AS reason, CAST({b} AS BIGINT) AS new_budget FROM {{o_rule_rows}} WHERE {w}"
    for r, a, t, b, w in _RULES))


def actions(spark, sf):
    q = A.adset_quality(per_ad(spark, sf), tree(spark, sf))
    return A.budget_actions(adsets(spark, sf), costs(spark, sf), q, campaigns(spark, sf))


@query("scr12_budget_rules", "SELECT * FROM {o_actions}")
def scr12_budget_rules(spark, sf):
    return actions(spark, sf)


@query("flt6_status_exclude", "SELECT campaign_id, adset_id FROM {v_adsets} JOIN (SELECT campaign_id FROM {v_campaigns} WHERE status <> 'DELETED') c USING (campaign_id) WHERE status <> 'PAUSED'")
def flt6_status_exclude(spark, sf):
    live = campaigns(spark, sf).filter("status <> 'DELETED'").select("campaign_id")
    return adsets(spark, sf).filter("status <> 'PAUSED'").join(live, "campaign_id").select("campaign_id", "adset_id")


@query("src9_ad_objects", "SELECT a.adset_id, c.campaign_id, c.status, count(*) AS ads FROM {v_campaigns} c JOIN {v_adsets} a USING (campaign_id) JOIN {v_ads} d USING (adset_id) WHERE c.status IN ('ACTIVE', 'PAUSED') GROUP BY 1, 2, 3")
def src9_ad_objects(spark, sf):
    wanted = campaigns(spark, sf).filter(c("status").isin("ACTIVE", "PAUSED"))
    return A.ad_tree(wanted, adsets(spark, sf), ads(spark, sf)).groupBy("adset_id", "campaign_id", "status").agg(F.count("*").alias("ads"))


cte("o_summary", """
SELECT a.*, coalesce(s.cpl, 0e0) AS cpl, coalesce(s.frequency, 2e0) AS frequency, coalesce(q.avg_quality, 5e0) AS quality_score
FROM {v_adsets} a LEFT JOIN {o_adset_cpl} s ON s.adset_id = a.adset_id LEFT JOIN {o_adset_quality} q ON q.adset_id = a.adset_id""")


def summary(spark, sf):
    q = A.adset_quality(per_ad(spark, sf), tree(spark, sf))
    return A.adset_summary(adsets(spark, sf), A.insights_slice(insights(spark, sf), "adset").select("adset_id", "spend", "leads", "frequency"), q)


_FLAT_TEXT = f"'CPL ' || {_N} || 'd & quality ' || {_one('quality_score')}"
_FLAT = [("PAUSE", "pause_adset", _FLAT_TEXT, "NULL", "cpl > 500000 AND quality_score < 4"),
         ("SCALE", "update_budget", _FLAT_TEXT, "floor(daily_budget * 1.5e0)", "cpl < 150000 AND quality_score >= 7"),
         ("WINNER", "duplicate_adset", f"'Quality ' || {_one('quality_score')}", "floor(daily_budget * 2e0)", "quality_score >= 8")]
cte("o_flat_rows", """
SELECT c.campaign_name AS campaign, c.account_id, c.bm_id, s.* FROM {o_summary} s LEFT JOIN {v_campaigns} c ON c.campaign_id = s.campaign_id WHERE s.status <> 'PAUSED'""")
cte("o_flat", " UNION ALL ".join(
    f"SELECT campaign, account_id, bm_id, adset_id, adset_name, daily_budget, cpl, quality_score, '{r}' AS rule, '{a}' AS action, {t} AS reason, CAST({b} AS BIGINT) AS new_budget FROM {{o_flat_rows}} WHERE {w}"
    for r, a, t, b, w in _FLAT))


def flat(spark, sf):
    return A.budget_actions_flat(summary(spark, sf), campaigns(spark, sf))


@query("scr13_budget_rules_flat", "SELECT * FROM {o_flat}")
def scr13_budget_rules_flat(spark, sf):
    return flat(spark, sf)


@query("agg37_rule_counts", "SELECT rule, count(*) AS actions, CAST(sum(CASE WHEN rule = 'PAUSE' THEN daily_budget ELSE 0 END) AS BIGINT) AS saved_budget FROM {o_flat} GROUP BY rule")
def agg37_rule_counts(spark, sf):
    return A.rule_counts(flat(spark, sf))


@query("join15_adset_campaign", "SELECT adset_id, campaign_name, account_id FROM {v_adsets} LEFT JOIN {v_campaigns} USING (campaign_id)")
def join15_adset_campaign(spark, sf):
    names = campaigns(spark, sf).select("campaign_id", "campaign_name", "account_id")
    return adsets(spark, sf).join(names, "campaign_id", "left").select("adset_id", "campaign_name", "account_id")


@query("srt7_adsets_by_cpl", "SELECT adset_id, cpl, quality_score FROM {o_summary}")
def srt7_adsets_by_cpl(spark, sf):
    return summary(spark, sf).select("adset_id", "cpl", "quality_score").orderBy("cpl", "adset_id")


cte("o_plan", """
SELECT *, CASE WHEN expected_leads > 0 THEN CAST(floor(expected_spend / expected_leads) AS BIGINT) ELSE 0 END AS est_cpl, CASE WHEN avg_quality >= 8 THEN 1 ELSE 2 END AS plan_priority
FROM (SELECT *, CAST(floor(total_spend / 7e0 * scale_factor) AS BIGINT) AS new_daily_budget, CAST(floor(total_leads * scale_factor) AS BIGINT) AS expected_leads,
             CAST(floor(total_spend * scale_factor) AS BIGINT) AS expected_spend
      FROM (SELECT *, CASE WHEN avg_quality >= 9 THEN 3e0 WHEN avg_quality >= 8 THEN 2e0 ELSE 1.5e0 END AS scale_factor FROM {o_matrix} WHERE quadrant = 'SCALE_UP') a) b""")


@query("scr14_scale_plan", "SELECT campaign_id, scale_factor, new_daily_budget, expected_leads, expected_spend, est_cpl, CAST(plan_priority AS INTEGER) AS plan_priority FROM {o_plan}")
def scr14_scale_plan(spark, sf):
    return A.scale_plan(matrix(spark, sf)).select("campaign_id", "scale_factor", "new_daily_budget", "expected_leads", "expected_spend", "est_cpl", "plan_priority")


@query("win7_top_adsets", """
SELECT campaign_id, adset_id, CAST(r AS INTEGER) AS rank, CAST(floor(daily_budget * scale_factor) AS BIGINT) AS new_budget
FROM (SELECT a.*, p.scale_factor, row_number() OVER (PARTITION BY a.campaign_id ORDER BY a.list_order, a.adset_id) AS r FROM {v_adsets} a JOIN {o_plan} p ON p.campaign_id = a.campaign_id) t WHERE r <= 3""")
def win7_top_adsets(spark, sf):
    return A.adsets_to_scale(A.scale_plan(matrix(spark, sf)), adsets(spark, sf))


@query("scr15_recommendations", f"""
SELECT campaign_id, campaign_name, CASE quadrant WHEN 'SCALE_UP' THEN 'scale_up' WHEN 'PAUSE' THEN 'pause' ELSE 'optimize' END AS kind, quadrant, cpl, avg_quality,
       CASE quadrant WHEN 'OPTIMIZE_TARGETING' THEN 'Thử narrow targeting hoặc lookalike audience chất lượng hơn' WHEN 'TEST_CREATIVE' THEN 'Thử creative mới: video testimonial, carousel dự án'
            WHEN 'PAUSE' THEN 'CPL ' || {_N} || 'đ cao + quality ' || {_one('avg_quality')} || ' thấp' END AS suggestion FROM {{o_matrix}}""")
def scr15_recommendations(spark, sf):
    return A.recommendations(matrix(spark, sf))


@query("agg38_recommend_summary", f"""
SELECT (SELECT count(*) FROM {{o_matrix}} WHERE quadrant = 'SCALE_UP') AS winners, (SELECT count(*) FROM {{o_matrix}} WHERE quadrant IN ('OPTIMIZE_TARGETING', 'TEST_CREATIVE')) AS to_optimize,
       (SELECT count(*) FROM {{o_matrix}} WHERE quadrant = 'PAUSE') AS to_pause, (SELECT count(*) FROM {{o_matrix}}) AS total_campaigns,
       {O.rnd('coalesce(' + O.esum('expected_spend - total_spend') + ', 0)', 0)} AS extra_budget, CAST(coalesce(sum(expected_leads), 0) AS BIGINT) AS expected_leads FROM {{o_plan}}""")
def agg38_recommend_summary(spark, sf):
    return A.recommendation_summary(matrix(spark, sf))


@query("agg36_campaign_daily", f"""
SELECT campaign_id, date_start, CAST({O.esum('spend')} AS DOUBLE) AS spend, CAST(sum(leads) AS BIGINT) AS leads, {O.rate(O.esum('spend'), 'sum(leads)', 0, 1)} AS cpl FROM {{v_insights}} GROUP BY 1, 2""")
def agg36_campaign_daily(spark, sf):
    daily = A.insights_slice(insights(spark, sf), "campaign", daily=True)
    return daily.select("campaign_id", "date_start", c("spend").cast("double").alias("spend"), "leads", A.compute_cpl(c("spend"), c("leads")).alias("cpl"))


_BENCH = {"cpl": "cpl", "cpm": "avg_cpm", "ctr": "avg_ctr", "frequency": "avg_frequency", "conv_rate": "conv_rate"}


@query("agg42_benchmark_avg", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, x AS average, {_rating(m, 'x')} AS rating FROM (SELECT {O.eavg(col, 4)} AS x FROM {{o_costs}}) t_{m}" for m, col in _BENCH.items()))
def agg42_benchmark_avg(spark, sf):
    return A.benchmark_averages(costs(spark, sf))


# --- content ---------------------------------------------------------------
def _case(table, x, default):
    return f"CASE {x} " + " ".join(f"WHEN {O.lit(k)} THEN {O.lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


_LABEL = _case({k: v[0] for k, v in D.CONTENT_TYPES.items()}, "content_type", "content_type")
_FORMAT = _case({k: v[1] for k, v in D.CONTENT_TYPES.items()}, "content_type", "'other'")
cte("o_first", "SELECT page_id, arg_min(campaign_id, list_order) AS campaign_id, arg_min(content_type, list_order) AS content_type, arg_min(account_id, list_order) AS account_id, arg_min(bm_id, list_order) AS bm_id FROM {v_campaigns} GROUP BY page_id")
cte("o_attr", "SELECT l.quality_score, f.campaign_id, f.content_type, f.account_id, f.bm_id FROM {v_chat_leads} l JOIN {o_first} f USING (page_id)")
cte("o_daily", f"SELECT content_type, date_start, {O.esum('spend')} AS spend, sum(leads) AS leads FROM {{v_insights}} GROUP BY 1, 2")
cte("o_trend", f"""
SELECT content_type, CASE WHEN n < 4 THEN 'stable' WHEN recent < early * 0.9e0 THEN 'improving' WHEN recent > early * 1.1e0 THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT content_type, count(*) AS n,
             {O.safe('sum(spend) FILTER (WHERE u <= 3)', 'greatest(sum(leads) FILTER (WHERE u <= 3), 1)')} AS early,
             {O.safe('sum(spend) FILTER (WHERE d <= 3)', 'greatest(sum(leads) FILTER (WHERE d <= 3), 1)')} AS recent
      FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY date_start) AS u, row_number() OVER (PARTITION BY content_type ORDER BY date_start DESC) AS d FROM {{o_daily}}) a GROUP BY 1) b""")
cte("o_tiers", "SELECT content_type, tier, count(*) AS rows FROM {v_insights} GROUP BY 1, 2")
cte("o_dominant", "SELECT content_type, tier AS dominant_tier FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY rows DESC, tier) AS k FROM {o_tiers}) t WHERE k = 1")


def _norm(x, lo, hi):
    return f"least(1e0, greatest(0e0, (CAST({x} AS DOUBLE) - {lo}e0) / {hi - lo + 1}e0))"


_COMPOSITE = (f"((1 - {_norm('cpl', 0, 900000)}) * 0.35e0 + {_norm('avg_quality', 0, 10)} * 0.30e0 + {_norm('avg_ctr', 0, 6)} * 0.15e0 "
              f"+ {_norm('conv_rate', 0, 20)} * 0.15e0 + (1 - {_norm('avg_freq', 1, 6)}) * 0.05e0) * 100")
cte("o_by_type", f"""
SELECT *, CASE WHEN composite_score >= 70 THEN 'excellent' WHEN composite_score >= 50 THEN 'good' WHEN composite_score >= 35 THEN 'average' ELSE 'poor' END AS rating,
       CASE WHEN cpl < 150000 THEN 'good' WHEN cpl > 400000 THEN 'poor' ELSE 'avg' END AS cpl_vs_bench,
       CASE WHEN avg_ctr > 2 THEN 'good' WHEN avg_ctr < 1 THEN 'poor' ELSE 'avg' END AS ctr_vs_bench,
       CASE WHEN avg_quality >= 7 THEN 'good' WHEN avg_quality < 4 THEN 'poor' ELSE 'avg' END AS qual_vs_bench,
       CASE WHEN avg_freq > 3.5e0 THEN 'high' WHEN avg_freq > 2.5e0 THEN 'medium' ELSE 'low' END AS freq_risk,
       CASE WHEN avg_freq > 0 THEN CAST({O.rnd('total_impressions / avg_freq', 0)} AS BIGINT) ELSE total_impressions END AS reach,
       {O.rate('total_spend', 'sum(CAST(total_spend AS DECIMAL(28,6))) OVER ()', 1, 100)} AS spend_pct
FROM (SELECT *, {O.rnd(_COMPOSITE, 1)} AS composite_score
      FROM (SELECT content_type, {_LABEL} AS label, {_FORMAT} AS format, campaigns, {O.rnd('spend', 0)} AS total_spend, total_leads, total_clicks, total_impressions,
                   {O.rate('spend', 'total_leads', 0, 1)} AS cpl, {O.rate('s_ctr', 'n', 2, 1)} AS avg_ctr, {O.rate('s_freq', 'n', 2, 1)} AS avg_freq,
                   {O.rate('total_leads', 'total_clicks', 2, 100)} AS conv_rate, {O.rate('spend', 'total_impressions', 0, 1000)} AS cpm,
                   {O.rate('coalesce(q_sum, 0)', 'coalesce(q_n, 0)', 2, 1)} AS avg_quality, trend, dominant_tier
            FROM (SELECT content_type, count(*) AS n, {O.esum('spend')} AS spend, CAST(sum(leads) AS BIGINT) AS total_leads, CAST(sum(clicks) AS BIGINT) AS total_clicks,
                         CAST(sum(impressions) AS BIGINT) AS total_impressions, {O.esum('ctr')} AS s_ctr, {O.esum('frequency')} AS s_freq, count(DISTINCT campaign_id) AS campaigns
                  FROM {{v_insights}} GROUP BY content_type) s
            LEFT JOIN (SELECT content_type, {O.esum('quality_score')} AS q_sum, count(*) AS q_n FROM {{o_attr}} GROUP BY 1) q USING (content_type)
            LEFT JOIN {{o_trend}} USING (content_type) LEFT JOIN {{o_dominant}} USING (content_type)) a) b""")


@query("agg25_content_type_perf", "SELECT * FROM {o_by_type}")
def agg25_content_type_perf(spark, sf):
    return by_type(spark, sf)


@query("agg26_dominant_tier", "SELECT content_type, tier, rows, tier = dominant_tier AS dominant FROM {o_tiers} JOIN {o_dominant} USING (content_type)")
def agg26_dominant_tier(spark, sf):
    counts = K.tier_counts(insights(spark, sf))
    return counts.join(K.dominant_tier(counts), "content_type").select(
        "content_type", "tier", "rows", (c("tier") == c("dominant_tier")).alias("dominant"))


cte("o_by_format", f"""
SELECT format, {O.rnd(O.esum('total_spend'), 0)} AS total_spend, CAST(sum(total_leads) AS BIGINT) AS total_leads, {O.rate(O.esum('total_spend'), 'sum(total_leads)', 0, 1)} AS cpl,
       {O.rate(O.esum('avg_quality * campaigns'), 'sum(campaigns)', 2, 1)} AS avg_quality, {O.rate('sum(total_leads)', 'sum(total_clicks)', 2, 100)} AS conv_rate,
       CAST(sum(total_impressions) AS BIGINT) AS impressions, CAST(sum(total_clicks) AS BIGINT) AS clicks FROM {{o_by_type}} GROUP BY format""")


@query("agg27_format_perf", "SELECT * FROM {o_by_format}")
def agg27_format_perf(spark, sf):
    return K.format_performance(by_type(spark, sf)).orderBy("cpl", "format")


@query("agg28_funnel", "SELECT format, impressions, clicks, total_leads AS leads, avg_quality AS quality FROM {o_by_format}")
def agg28_funnel(spark, sf):
    return K.funnel(K.format_performance(by_type(spark, sf)))


@query("win4_cpl_trend", "SELECT * FROM {o_trend}")
def win4_cpl_trend(spark, sf):
    return K.cpl_trend(K.content_daily(insights(spark, sf)))


@query("win5_share", "SELECT content_type, total_spend, spend_pct FROM {o_by_type}")
def win5_share(spark, sf):
    return by_type(spark, sf).select("content_type", "total_spend", "spend_pct")


@query("agg35_day_format_cpl", "SELECT date_start, " + ", ".join(
    f"CASE WHEN sum(leads) FILTER (WHERE format = '{f}') > 0 THEN " + O.rnd(f"CAST(sum(CAST(spend AS DECIMAL(28,6))) FILTER (WHERE format = '{f}') AS DOUBLE) / sum(leads) FILTER (WHERE format = '{f}') / 1000", 1) + f" END AS {f}"
    for f in D.CONTENT_FORMATS) + f" FROM (SELECT *, {_FORMAT} AS format FROM {{v_insights}}) t GROUP BY date_start")
def agg35_day_format_cpl(spark, sf):
    return K.format_daily_cpl(insights(spark, sf))


@query("srt6_top5_bottom5", """
SELECT * FROM (SELECT content_type, composite_score, cpl, 'top' AS side FROM {o_by_type} ORDER BY composite_score DESC, content_type LIMIT 5) a
UNION ALL SELECT * FROM (SELECT content_type, composite_score, cpl, 'bottom' FROM {o_by_type} WHERE total_leads > 0 ORDER BY composite_score, content_type LIMIT 5) b""")
def srt6_top5_bottom5(spark, sf):
    return K.top_bottom(by_type(spark, sf))


@query("agg43_content_kpis", f"""
SELECT (SELECT content_type FROM {{o_by_type}} ORDER BY composite_score DESC, content_type LIMIT 1) AS best_content, (SELECT content_type FROM {{o_by_type}} ORDER BY cpl DESC, content_type LIMIT 1) AS worst_content,
       {O.rnd(O.safe(O.esum('avg_quality * total_leads'), 'greatest(sum(total_leads), 1)'), 1)} AS avg_quality, count(*) AS content_types,
       (SELECT format FROM {{o_by_format}} ORDER BY cpl, format LIMIT 1) AS best_format FROM {{o_by_type}}""")
def agg43_content_kpis(spark, sf):
    types = staged(by_type(spark, sf), "content-types")
    return K.content_kpis(types, K.format_performance(types))


@query("scr20_content_insights", """
SELECT 'scale_best' AS rule, 'ok' AS severity, content_type AS subject, composite_score AS value FROM (SELECT * FROM {o_by_type} ORDER BY composite_score DESC, content_type LIMIT 1) a
UNION ALL SELECT 'video_vs_image', 'info', CASE WHEN v < i THEN 'video' ELSE 'image' END, least(v, i) FROM (SELECT max(cpl) FILTER (WHERE format = 'video') AS v, max(cpl) FILTER (WHERE format = 'image') AS i FROM {o_by_format}) b WHERE v IS NOT NULL AND i IS NOT NULL
UNION ALL SELECT 'personal_brand', 'ok', format, cpl FROM {o_by_format} WHERE format = 'personal' AND cpl < 100000
UNION ALL SELECT 'declining', 'warn', content_type, cpl FROM {o_by_type} WHERE trend = 'declining' AND total_leads > 5
UNION ALL SELECT 'poor_conversion', 'crit', content_type, conv_rate FROM {o_by_type} WHERE conv_rate < 2 AND total_spend > 5000000
UNION ALL SELECT 'ad_fatigue', 'warn', content_type, avg_freq FROM {o_by_type} WHERE freq_risk = 'high' AND total_spend > 2000000
UNION ALL SELECT * FROM (SELECT 'improving', 'ok', content_type, cpl FROM {o_by_type} WHERE trend = 'improving' ORDER BY composite_score DESC, content_type LIMIT 2) d""")
def scr20_content_insights(spark, sf):
    types = staged(by_type(spark, sf), "content-types")
    return K.content_insights(types, K.format_performance(types))


# --- accounts --------------------------------------------------------------
def bms(spark, sf):
    rows = campaigns(spark, sf).select("bm_id", "account_id").distinct()
    return rows.groupBy("bm_id").agg(F.sort_array(F.collect_set("account_id")).alias("accounts")).select(
        F.concat(F.lit("BM "), "bm_id").alias("bm_name"), F.lower("bm_id").alias("bm_type"), "accounts")


@query("join12_page_first", "SELECT l.conversation_id, f.campaign_id, f.content_type, f.account_id, f.bm_id FROM {v_chat_leads} l LEFT JOIN {o_first} f USING (page_id)")
def join12_page_first(spark, sf):
    first = K.first_campaign_of_page(campaigns(spark, sf))
    return join_dimension(chats(spark, sf), first, "page_id", ["conversation_id"]).select("conversation_id", "campaign_id", "content_type", "account_id", "bm_id")


@query("join13_page_all", f"SELECT c.campaign_id, count(l.quality_score) AS leads, {O.eavg('l.quality_score', 1)} AS avg_quality FROM {{v_campaigns}} c JOIN {{v_chat_leads}} l ON l.page_id = c.page_id GROUP BY 1")
def join13_page_all(spark, sf):
    """All campaigns of a page share the page's aggregated quality; no pairs are built."""
    pages = K.page_quality(chats(spark, sf))
    return campaigns(spark, sf).join(pages, "page_id").select(
        "campaign_id", c("q_n").alias("leads"), N.rate(c("q_sum"), c("q_n"), 1).alias("avg_quality"))


@query("join14_bm_lookup", "SELECT account_id, 'BM ' || bm_id AS bm_name, lower(bm_id) AS bm_type FROM {v_campaigns} GROUP BY 1, 2, 3")
def join14_bm_lookup(spark, sf):
    accounts = campaigns(spark, sf).select("account_id").distinct()
    return accounts.join(K.bm_of_account(bms(spark, sf)), "account_id", "left")


cte("o_accounts", f"""
SELECT account_id, bm_id, 'BM ' || bm_id AS bm_name, lower(bm_id) AS bm_type, {O.rnd('spend', 0)} AS total_spend, total_leads, total_clicks, total_impressions, {O.rate('spend', 'total_leads', 0, 1)} AS cpl,
       {O.rate('total_clicks', 'total_impressions', 2, 100)} AS ctr, campaigns, pages, {O.rate('coalesce(q_sum, 0)', 'coalesce(q_n, 0)', 2, 1)} AS avg_quality
FROM (SELECT account_id, max(bm_id) AS bm_id, {O.esum('spend')} AS spend, CAST(sum(leads) AS BIGINT) AS total_leads, CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(impressions) AS BIGINT) AS total_impressions,
             count(DISTINCT campaign_id) AS campaigns, array_to_string(list_sort(list(DISTINCT page_id)), ', ') AS pages FROM {{v_insights}} GROUP BY 1) s
LEFT JOIN (SELECT account_id, {O.esum('quality_score')} AS q_sum, count(*) AS q_n FROM {{o_attr}} GROUP BY 1) q USING (account_id)""")


@query("agg29_account_rollup", "SELECT * FROM {o_accounts}")
def agg29_account_rollup(spark, sf):
    return K.account_rollup(insights(spark, sf), campaigns(spark, sf), chats(spark, sf), bms(spark, sf))


cte("o_bms", f"""
SELECT bm_id, {O.rnd('spend', 0)} AS total_spend, total_leads, {O.rate('spend', 'total_leads', 0, 1)} AS cpl, accounts, campaigns, {O.rate('coalesce(q_sum, 0)', 'coalesce(q_n, 0)', 2, 1)} AS avg_quality
FROM (SELECT bm_id, {O.esum('spend')} AS spend, CAST(sum(leads) AS BIGINT) AS total_leads, count(DISTINCT account_id) AS accounts, count(DISTINCT campaign_id) AS campaigns FROM {{v_insights}} GROUP BY 1) s
LEFT JOIN (SELECT bm_id, {O.esum('quality_score')} AS q_sum, count(*) AS q_n FROM {{o_attr}} GROUP BY 1) q USING (bm_id)""")


@query("agg30_bm_rollup", "SELECT * FROM {o_bms}")
def agg30_bm_rollup(spark, sf):
    return K.bm_rollup(insights(spark, sf), campaigns(spark, sf), chats(spark, sf))


cte("o_tier_roll", f"""
SELECT tier, campaign_count, total_spend, total_leads, cpl, avg_quality, {O.rate('total_spend', 'sum(CAST(total_spend AS DECIMAL(28,6))) OVER ()', 1, 100)} AS spend_pct
FROM (SELECT tier, coalesce(n, 0) AS campaign_count, {O.rnd('coalesce(spend, 0)', 0)} AS total_spend, coalesce(leads, 0) AS total_leads, {O.rate('coalesce(spend, 0)', 'coalesce(leads, 0)', 0, 1)} AS cpl,
             {O.rate('coalesce(q_sum, 0)', 'coalesce(q_n, 0)', 2, 1)} AS avg_quality
      FROM (SELECT tier, count(*) AS n FROM {{v_campaigns}} GROUP BY 1) a FULL JOIN (SELECT tier, {O.esum('spend')} AS spend, CAST(sum(leads) AS BIGINT) AS leads FROM {{v_insights}} GROUP BY 1) b USING (tier)
      FULL JOIN (SELECT tier, {O.esum('quality_score')} AS q_sum, count(*) AS q_n FROM {{v_chat_leads}} GROUP BY 1) d USING (tier)) t""")


@query("agg31_tier_rollup", "SELECT * FROM {o_tier_roll}")
def agg31_tier_rollup(spark, sf):
    return K.tier_rollup(insights(spark, sf), campaigns(spark, sf), chats(spark, sf))


cte("o_metrics", f"""
SELECT c.campaign_id, campaign_name, account_id, bm_id, c.page_id, tier, status, objective, content_type, daily_budget, {O.rnd('coalesce(spend, 0)', 0)} AS total_spend, coalesce(leads, 0) AS total_leads,
       {O.rate('coalesce(spend, 0)', 'coalesce(leads, 0)', 0, 1)} AS cpl, {O.rate('coalesce(s_ctr, 0)', 'coalesce(n, 0)', 2, 1)} AS ctr, {O.rate('coalesce(s_freq, 0)', 'coalesce(n, 0)', 2, 1)} AS frequency,
       {O.rate('coalesce(q_sum, 0)', 'coalesce(q_n, 0)', 1, 1)} AS avg_quality
FROM {{v_campaigns}} c LEFT JOIN (SELECT campaign_id, {O.esum('spend')} AS spend, CAST(sum(leads) AS BIGINT) AS leads, {O.esum('ctr')} AS s_ctr, {O.esum('frequency')} AS s_freq, count(*) AS n FROM {{v_insights}} GROUP BY 1) s ON s.campaign_id = c.campaign_id
LEFT JOIN (SELECT page_id, {O.esum('quality_score')} AS q_sum, count(*) AS q_n FROM {{v_chat_leads}} GROUP BY 1) q ON q.page_id = c.page_id""")


@query("agg32_campaign_metrics", "SELECT * FROM {o_metrics}")
def agg32_campaign_metrics(spark, sf):
    return K.campaign_metrics(insights(spark, sf), campaigns(spark, sf), chats(spark, sf))


@query("flt7_multi_filter", "SELECT campaign_id, bm_id, tier, total_spend FROM {o_metrics} WHERE bm_id = 'ASIA' AND tier = 'STABLE' UNION ALL SELECT campaign_id, bm_id, tier, total_spend FROM {o_metrics} WHERE bm_id = 'EUROPE'")
def flt7_multi_filter(spark, sf):
    args = (insights(spark, sf), campaigns(spark, sf), chats(spark, sf))
    both = K.campaign_metrics(*args, bm="ASIA", tier="STABLE").unionByName(K.campaign_metrics(*args, bm="EUROPE"))
    return both.select("campaign_id", "bm_id", "tier", "total_spend")


@query("agg33_overview_summary", f"""
SELECT i.*, (SELECT count(*) FROM {{v_campaigns}}) AS total_campaigns, (SELECT count(DISTINCT bm_id) FROM {{v_campaigns}}) AS total_bms, (SELECT count(DISTINCT account_id) FROM {{v_campaigns}}) AS total_accounts,
       (SELECT count(DISTINCT page_id) FROM {{v_campaigns}}) AS total_pages, (SELECT count(*) FROM {{v_adsets}}) AS total_adsets, (SELECT count(*) FROM {{v_chat_leads}}) AS messenger_leads,
       (SELECT {O.eavg('quality_score', 2)} FROM {{v_chat_leads}}) AS avg_quality
FROM (SELECT {O.rnd(O.esum('spend'), 0)} AS total_spend, CAST(sum(leads) AS BIGINT) AS total_leads, CAST(sum(impressions) AS BIGINT) AS total_impressions, {O.rate(O.esum('spend'), 'sum(leads)', 0, 1)} AS overall_cpl FROM {{v_insights}}) i""")
def agg33_overview_summary(spark, sf):
    return K.overview(insights(spark, sf), campaigns(spark, sf), adsets(spark, sf), chats(spark, sf))


@query("agg34_day_bm_trend", "SELECT date_start, " + ", ".join(
    O.rnd(f"CAST(coalesce(sum(CAST(spend AS DECIMAL(28,6))) FILTER (WHERE bm_id = '{b}'), 0) AS DOUBLE) / 1000000", 2) + f' AS "{b}_spend", CAST(coalesce(sum(leads) FILTER (WHERE bm_id = \'{b}\'), 0) AS BIGINT) AS "{b}_leads"'
    for b in BMS) + " FROM {v_insights} GROUP BY date_start")
def agg34_day_bm_trend(spark, sf):
    return K.day_bm_trend(insights(spark, sf), BMS)


@query("scr21_account_insights", """
SELECT 'best_bm' AS rule, 'ok' AS severity, bm_id AS subject, cpl AS value FROM (SELECT * FROM {o_bms} ORDER BY cpl, bm_id LIMIT 1) a
UNION ALL SELECT 'costly_bm', 'warn', bm_id, cpl FROM (SELECT * FROM {o_bms} ORDER BY cpl DESC, bm_id DESC LIMIT 1) b WHERE cpl > 300000
UNION ALL SELECT 'poor_tier_spend', 'crit', tier, spend_pct FROM {o_tier_roll} WHERE tier = 'POOR' AND spend_pct > 5
UNION ALL SELECT 'scale_winners', 'ok', tier, CAST(campaign_count AS DOUBLE) FROM {o_tier_roll} WHERE tier = 'WINNER' AND campaign_count > 0
UNION ALL SELECT 'quality_gap', 'info', x.account_id || ' vs ' || y.account_id, CAST(round(CAST(x.avg_quality - y.avg_quality AS DECIMAL(38,10)), 2) AS DOUBLE)
  FROM (SELECT * FROM {o_accounts} ORDER BY avg_quality DESC, account_id DESC LIMIT 1) x, (SELECT * FROM {o_accounts} ORDER BY avg_quality, account_id LIMIT 1) y WHERE x.account_id <> y.account_id
UNION ALL SELECT 'declining_tier', 'warn', tier, CAST(campaign_count AS DOUBLE) FROM {o_tier_roll} WHERE tier = 'DECLINING' AND campaign_count > 0
UNION ALL SELECT 'agent_account', 'ok', account_id, cpl FROM (SELECT * FROM {o_accounts} WHERE contains(account_id, 'agent') ORDER BY total_spend DESC, account_id LIMIT 1) z WHERE cpl < 150000""")
def scr21_account_insights(spark, sf):
    i, k, l = insights(spark, sf), campaigns(spark, sf), chats(spark, sf)
    return K.account_insights(K.bm_rollup(i, k, l), K.tier_rollup(i, k, l), K.account_rollup(i, k, l, bms(spark, sf)))


@query("srt3_chat_top200", "SELECT conversation_id, quality_score FROM {v_chat_leads} ORDER BY quality_score DESC, conversation_id LIMIT 200")
def srt3_chat_top200(spark, sf):
    return chats(spark, sf).select("conversation_id", "quality_score").orderBy(F.desc("quality_score"), "conversation_id").limit(200)
