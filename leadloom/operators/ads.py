"""Campaign cost, lead quality, budget actions.

Chat leads are reduced to one row per page or ad before they meet campaigns,
so no lead-campaign pairs are produced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import phones as P
from leadloom.functions.numbers import exact_avg, exact_sum, half_up, rate, rating, ratio, steps
from leadloom.operators import score as S
from leadloom.operators.common import join_dimension, one_row, top_per_key

LEVELS = {"campaign": ["campaign_id"], "adset": ["campaign_id", "adset_id"],
          "ad": ["campaign_id", "adset_id", "ad_id"]}


def compute_cpl(spend: Column, leads: Column) -> Column:
    return rate(spend, leads, 0)


def rate_metric(metric: str, value: Column, benchmarks: dict | None = None) -> Column:
    good, medium = (benchmarks or D.COST_BENCHMARKS)[metric]
    return rating(value, good, medium, metric in D.HIGHER_IS_BETTER)


def insights_slice(insights: DataFrame, level: str, since: str | None = None, until: str | None = None,
                   daily: bool = False) -> DataFrame:
    """Metrics per campaign, adset or ad (and day) inside a date range."""
    rows = insights
    if since:
        rows = rows.filter(F.col("date_start") >= F.lit(since).cast("date"))
    if until:
        rows = rows.filter(F.col("date_start") <= F.lit(until).cast("date"))
    keys = LEVELS[level] + (["date_start"] if daily else [])
    c = F.col
    return rows.groupBy(*keys).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.sum("leads").alias("leads"), F.sum("reach").alias("reach"),
        exact_sum(c("spend")).alias("spend")).withColumns({
            "ctr": rate(c("clicks"), c("impressions"), 6, 100), "cpm": rate(c("spend"), c("impressions"), 6, 1000),
            "cpc": rate(c("spend"), c("clicks"), 6), "frequency": rate(c("impressions"), c("reach"), 6)})


def date_preset(as_of: str, preset: str) -> tuple[str, str]:
    """(since, until) of last_7d / last_14d / last_30d before ``as_of``."""
    import datetime

    days = {"last_7d": 7, "last_14d": 14, "last_30d": 30}.get(preset, 7)
    end = datetime.date.fromisoformat(as_of) - datetime.timedelta(days=1)
    return (end - datetime.timedelta(days=days - 1)).isoformat(), end.isoformat()


def campaign_costs(rows: DataFrame) -> DataFrame:
    """Totals, means of the row rates, cost per lead, conversion and ratings per campaign.

    The ``avg_`` columns are means of the rows' rates, not ratios of sums.
    """
    c = F.col
    means = {m: ratio(c(f"_{m}"), c("rows")) for m in ("cpm", "ctr", "cpc", "frequency")}
    out = rows.groupBy("campaign_id").agg(
        F.count("*").alias("rows"), exact_sum(c("spend")).alias("total_spend"),
        F.sum("clicks").alias("total_clicks"), F.sum("leads").alias("total_leads"),
        F.sum("reach").alias("total_reach"), F.sum("impressions").alias("total_impressions"),
        *[exact_sum(c(m)).alias(f"_{m}") for m in means])
    out = out.withColumns({"cpl": compute_cpl(c("total_spend"), c("total_leads")),
                           "conv_rate": rate(c("total_leads"), c("total_clicks"), 2, 100),
                           **{f"_avg_{m}": v for m, v in means.items()}})
    return out.select(
        "campaign_id", c("total_spend").cast("double").alias("total_spend"), "total_clicks", "total_leads",
        "total_reach", "total_impressions", "cpl", "conv_rate",
        *[half_up(c(f"_avg_{m}"), 2).alias(f"avg_{m}") for m in means],
        *[rate_metric(m, c(f"_avg_{m}")).alias(f"rating_{m}") for m in means],
        rate_metric("cpl", c("cpl")).alias("rating_cpl"),
        rate_metric("conv_rate", c("conv_rate")).alias("rating_conv_rate"))


def cost_report(costs: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaign rows, and the total in the row without a campaign."""
    joined = campaigns.join(costs, "campaign_id")
    c = F.col
    return joined.rollup("campaign_id").agg(
        F.count("*").alias("campaigns"), exact_sum(c("total_spend")).cast("double").alias("total_spend"),
        F.sum("total_leads").alias("total_leads"),
        compute_cpl(exact_sum(c("total_spend")), F.sum("total_leads")).alias("cpl"))


def anomalies(rows: DataFrame, benchmarks: dict | None = None) -> DataFrame:
    """Up to four alerts per adset row."""
    b = benchmarks or D.COST_BENCHMARKS
    c = F.col
    cpl = compute_cpl(c("spend"), c("leads"))

    def alert(kind, severity, value, cond):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                                     value.cast("double").alias("value")))

    alerts = F.array_compact(F.array(
        alert("HIGH_CPL", "critical", cpl, (c("leads") > 0) & (cpl > b["cpl"][1])),
        alert("AD_FATIGUE", "warning", c("frequency"), c("frequency") > b["frequency"][1]),
        alert("LOW_CTR", "warning", c("ctr"), c("ctr") < b["ctr"][1]),
        alert("CPM_SPIKE", "warning", c("cpm"), c("cpm") > b["cpm"][1] * 2)))
    return rows.select("campaign_id", "adset_id", F.explode(alerts).alias("a")).select(
        "campaign_id", "adset_id", "a.*")


# --- lead quality ----------------------------------------------------------
def scored_chat_leads(chat_leads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Chat leads with the lead score of their profile (by phone) and their quality."""
    scores = profiles.select("profile_key", F.col("lead_score").alias("profile_score"))
    c = F.col
    keyed = chat_leads.withColumn("profile_key", P.phone_join_key(c("phone")))
    return (join_dimension(keyed, scores, "profile_key", ["conversation_id"])
            .withColumn("profile_score", F.coalesce("profile_score", F.lit(0.0)))
            .withColumn("quality", S.chat_quality(
                c("sender_name"), c("phone"), c("email"), c("intent_score"), c("message_count"),
                F.lit(False), c("profile_score"))))


def _bands(q: Column) -> list[Column]:
    return [F.count_if(q >= 7).alias("high"), F.count_if((q >= 4) & (q < 7)).alias("medium"),
            F.count_if(q < 4).alias("low")]


def ad_quality(leads: DataFrame) -> DataFrame:
    """Lead count, mean quality and bands per ad."""
    return leads.groupBy("fb_ad_id").agg(F.count("*").alias("lead_count"),
                                         exact_avg(F.col("quality"), 2).alias("avg_quality"),
                                         exact_sum(F.col("quality")).alias("quality_sum"), *_bands(F.col("quality")))


def ad_score_histogram(leads: DataFrame) -> DataFrame:
    """Leads per ad and score, the compact form of an ad's sorted score list."""
    return leads.groupBy("fb_ad_id", "quality").agg(F.count("*").alias("leads"))


def ad_tree(campaigns: DataFrame, adsets: DataFrame, ads: DataFrame) -> DataFrame:
    """campaign -> adset -> ad."""
    return (campaigns.select("campaign_id", "campaign_name", "status")
            .join(adsets.select("campaign_id", "adset_id"), "campaign_id")
            .join(ads, "adset_id"))


def campaign_quality(per_ad: DataFrame, tree: DataFrame) -> DataFrame:
    """Quality ranking of campaigns with leads."""
    c = F.col
    joined = tree.join(per_ad, tree["ad_id"] == per_ad["fb_ad_id"])
    sums = joined.groupBy("campaign_id").agg(
        F.max("campaign_name").alias("campaign_name"), F.max("status").alias("status"),
        F.sum("lead_count").alias("total_leads"), F.sum("quality_sum").alias("_q"),
        *[F.sum(b).alias(b) for b in ("high", "medium", "low")])
    return (sums.withColumn("avg_quality", rate(c("_q"), c("total_leads"), 2))
            .withColumn("high_ratio_pct", rate(c("high"), c("total_leads"), 1, 100))
            .withColumn("rank_score", half_up(
                c("avg_quality").cast("decimal(18,4)") * F.expr("CAST(0.6 AS DECIMAL(4,2))")
                + c("high_ratio_pct").cast("decimal(18,4)") * F.expr("CAST(0.04 AS DECIMAL(4,2))"), 2))
            .drop("_q"))


def adset_quality(per_ad: DataFrame, tree: DataFrame) -> DataFrame:
    """Mean of the per-ad averages of the adset's ads with leads."""
    joined = tree.join(per_ad, tree["ad_id"] == per_ad["fb_ad_id"])
    return joined.groupBy("adset_id").agg(exact_avg(F.col("avg_quality"), 4).alias("avg_quality"))


def quality_cost_matrix(costs: DataFrame, quality: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Quadrant of every campaign with costs, by quality and cost per lead."""
    c = F.col
    rows = (campaigns.select("campaign_id", "campaign_name").join(costs, "campaign_id")
            .join(quality.select("campaign_id", "avg_quality", c("total_leads").alias("quality_leads")), "campaign_id", "left")
            .withColumn("avg_quality", F.coalesce("avg_quality", F.lit(0.0))))
    cheap, good = c("cpl") <= 200000, c("avg_quality") >= 6.0
    number = F.when(good & cheap, 1).when(good, 2).when(cheap, 3).otherwise(4)
    names = F.array(*[F.lit(q) for q, _ in D.QUADRANTS])
    labels = F.array(*[F.lit(label) for _, label in D.QUADRANTS])
    return rows.withColumn("priority", number).select(
        "campaign_id", "campaign_name", "cpl", "avg_quality",
        F.coalesce("quality_leads", F.lit(0).cast("bigint")).alias("total_leads"), "total_spend",
        F.element_at(names, c("priority")).alias("quadrant"), F.element_at(labels, c("priority")).alias("label"), "priority")


# --- budget actions --------------------------------------------------------
def _number(value: Column) -> Column:
    return F.format_number(value, 0)


def _one(value: Column) -> Column:
    return half_up(value, 1).cast("string")


def _action(cond, rule, action, reason, new_budget=None):
    return F.when(cond, F.struct(
        F.lit(rule).alias("rule"), F.lit(action).alias("action"), reason.alias("reason"),
        (F.lit(None) if new_budget is None else new_budget).cast("bigint").alias("new_budget")))


def budget_actions(adsets: DataFrame, costs: DataFrame, quality: DataFrame, campaigns: DataFrame,
                   rules: dict | None = None) -> DataFrame:
    """Five rules per adset: campaign cost against adset quality."""
    r = rules or D.BUDGET_RULES
    c = F.col
    rows = (
        campaigns.filter("status <> 'DELETED'").select("campaign_id", c("campaign_name").alias("campaign"))
        .join(adsets.select("campaign_id", "adset_id", "adset_name", "daily_budget"), "campaign_id")
        .join(costs.select("campaign_id", "cpl", c("avg_ctr").alias("ctr"), c("avg_frequency").alias("frequency")), "campaign_id")
        .join(quality, "adset_id", "left").withColumn("avg_quality", F.coalesce("avg_quality", F.lit(0.0))))
    cpl, q, ctr, freq, budget = c("cpl"), c("avg_quality"), c("ctr"), c("frequency"), c("daily_budget")
    pause = (cpl > r["pause_cpl"]) & (q < r["pause_quality"])
    scale = ~pause & (cpl > 0) & (cpl < r["scale_cpl"]) & (q >= r["scale_quality"])
    cost_text = F.concat(F.lit("CPL "), _number(cpl), F.lit("đ & quality "), _one(q))
    actions = F.array_compact(F.array(
        _action(pause, "PAUSE", "pause_adset", cost_text),
        _action(scale, "SCALE", "update_budget", cost_text, F.floor(budget * F.lit(r["scale_factor"]))),
        _action((ctr > 0) & (ctr < r["ctr_poor"]), "TEST_BUDGET", "update_budget",
                F.concat(F.lit("CTR "), ctr.cast("string"), F.lit("%")), F.floor(budget * F.lit(r["ctr_budget_cut"]))),
        _action(freq > r["freq_cap"], "FREQ_CAP", "pause_adset",
                F.concat(F.lit("Frequency "), _one(freq), F.lit("x"))),
        _action((q >= r["winner_quality"]) & (cpl > 0) & (cpl < r["scale_cpl"] * 2), "WINNER", "duplicate_adset",
                F.concat(F.lit("Quality "), _one(q)), F.floor(budget * F.lit(r["winner_budget"])))))
    return rows.withColumn("a", F.explode(actions)).select(
        "campaign", "campaign_id", "adset_id", "adset_name", "cpl", "ctr", "frequency", "avg_quality", "a.*")


def action_log(actions: DataFrame, run_at: str, dry_run: bool = True) -> DataFrame:
    """Log rows with the parameters and metrics as JSON."""
    return actions.select(
        F.lit(run_at).cast("timestamp").alias("run_at"), F.lit(dry_run).alias("dry_run"), "rule", "action",
        "adset_id", "adset_name", "campaign", "reason",
        F.to_json(F.struct("adset_id", "new_budget")).alias("params_json"),
        F.to_json(F.struct("cpl", "ctr", "frequency", "avg_quality")).alias("metrics_json"),
        F.lit("preview").alias("status"))


def adset_summary(adsets: DataFrame, slices: DataFrame, quality: DataFrame) -> DataFrame:
    """Adsets with cost per lead, quality (5.0 when unknown) and frequency."""
    c = F.col
    return (adsets.join(slices.select("adset_id", compute_cpl(c("spend"), c("leads")).alias("cpl"), "frequency"), "adset_id", "left")
            .join(quality.select("adset_id", c("avg_quality").alias("quality_score")), "adset_id", "left")
            .fillna({"cpl": 0.0, "quality_score": 5.0, "frequency": 2.0}))


def budget_actions_flat(summary: DataFrame, campaigns: DataFrame, rules: dict | None = None) -> DataFrame:
    """Three-rule variant on active adset rows."""
    r = rules or D.BUDGET_RULES
    c = F.col
    rows = (summary.filter("status <> 'PAUSED'")
            .join(campaigns.select("campaign_id", c("campaign_name").alias("campaign"), "account_id", "bm_id"), "campaign_id", "left"))
    cpl, q, budget = c("cpl"), c("quality_score"), c("daily_budget")
    pause = (cpl > r["pause_cpl"]) & (q < r["pause_quality"])
    scale = ~pause & (cpl < r["scale_cpl"]) & (q >= r["scale_quality"])
    text = F.concat(F.lit("CPL "), _number(cpl), F.lit("d & quality "), _one(q))
    actions = F.array_compact(F.array(
        _action(pause, "PAUSE", "pause_adset", text),
        _action(scale, "SCALE", "update_budget", text, F.floor(budget * F.lit(r["scale_factor"]))),
        _action(q >= r["winner_quality"], "WINNER", "duplicate_adset",
                F.concat(F.lit("Quality "), _one(q)), F.floor(budget * F.lit(r["winner_budget"])))))
    return rows.withColumn("a", F.explode(actions)).select(
        "campaign", "account_id", "bm_id", "adset_id", "adset_name", "daily_budget", "cpl", "quality_score", "a.*")


def rule_counts(actions: DataFrame) -> DataFrame:
    """Actions per rule, and the daily budget that pausing would save."""
    return actions.groupBy("rule").agg(
        F.count("*").alias("actions"),
        F.sum(F.when(F.col("rule") == "PAUSE", F.col("daily_budget")).otherwise(F.lit(0))).cast("bigint").alias("saved_budget"))


def scale_plan(matrix: DataFrame) -> DataFrame:
    """New budget and expected outcome of every winner."""
    c = F.col
    factor = steps(c("avg_quality"), [(9.0, 3.0), (8.0, 2.0)], 1.5)
    plan = (matrix.filter("quadrant = 'SCALE_UP'").withColumn("scale_factor", factor)
            .withColumn("new_daily_budget", F.floor(c("total_spend") / F.lit(7) * c("scale_factor")).cast("bigint"))
            .withColumn("expected_leads", F.floor(c("total_leads") * c("scale_factor")).cast("bigint"))
            .withColumn("expected_spend", F.floor(c("total_spend") * c("scale_factor")).cast("bigint")))
    return plan.withColumn("est_cpl", F.when(c("expected_leads") > 0, F.floor(
        c("expected_spend") / c("expected_leads")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))).withColumn(
        "plan_priority", F.when(c("avg_quality") >= 8, 1).otherwise(2))


def adsets_to_scale(plan: DataFrame, adsets: DataFrame, n: int = 3) -> DataFrame:
    """The first n adsets of every winner in list order, with their new budget."""
    rows = adsets.join(plan.select("campaign_id", "scale_factor"), "campaign_id")
    first = top_per_key(rows, "campaign_id", ["list_order", "adset_id"], n, F.col("adset_id"))
    return first.select(
        "campaign_id", "adset_id", "rank",
        F.floor(F.coalesce("daily_budget", F.lit(100000)) * F.col("scale_factor")).cast("bigint").alias("new_budget"))


def recommendations(matrix: DataFrame) -> DataFrame:
    """What to do with every campaign."""
    c = F.col
    text = (F.when(c("quadrant") == "OPTIMIZE_TARGETING", "Thử narrow targeting hoặc lookalike audience chất lượng hơn")
            .when(c("quadrant") == "TEST_CREATIVE", "Thử creative mới: video testimonial, carousel dự án")
            .when(c("quadrant") == "PAUSE", F.concat(F.lit("CPL "), _number(c("cpl")), F.lit("đ cao + quality "),
                                                     _one(c("avg_quality")), F.lit(" thấp"))))
    kind = F.when(c("quadrant") == "SCALE_UP", "scale_up").when(c("quadrant") == "PAUSE", "pause").otherwise("optimize")
    return matrix.select("campaign_id", "campaign_name", kind.alias("kind"), "quadrant", "cpl", "avg_quality", text.alias("suggestion"))


def recommendation_summary(matrix: DataFrame) -> DataFrame:
    c = F.col
    plan = scale_plan(matrix).agg(
        half_up(F.coalesce(exact_sum(c("expected_spend") - c("total_spend")), F.lit(0)), 0).alias("extra_budget"),
        F.coalesce(F.sum("expected_leads"), F.lit(0)).alias("expected_leads"))
    counts = matrix.agg(F.count_if(c("quadrant") == "SCALE_UP").alias("winners"),
                        F.count_if(c("quadrant").isin("OPTIMIZE_TARGETING", "TEST_CREATIVE")).alias("to_optimize"),
                        F.count_if(c("quadrant") == "PAUSE").alias("to_pause"), F.count("*").alias("total_campaigns"))
    return one_row(counts, plan)


def benchmark_averages(costs: DataFrame) -> DataFrame:
    """Unweighted mean of each metric over campaigns, rated."""
    metrics = {"cpl": "cpl", "cpm": "avg_cpm", "ctr": "avg_ctr", "frequency": "avg_frequency", "conv_rate": "conv_rate"}
    row = costs.agg(*[exact_avg(F.col(col), 4).alias(m) for m, col in metrics.items()])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).alias("average"), rate_metric(m, F.col(m)).alias("rating")) for m in metrics])))
