"""Creative performance and multi-account rollups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions.numbers import exact_sum, half_up, rate, ratio, rescale
from leadloom.operators.ads import compute_cpl
from leadloom.operators.common import one_row
from leadloom.session import staged

def _every():
    """All rows of a small aggregated table."""
    return Window.partitionBy(F.lit(1))


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def content_label(content_type: Column) -> Column:
    return F.coalesce(F.element_at(_literal_map({k: v[0] for k, v in D.CONTENT_TYPES.items()}), content_type), content_type)


def content_format(content_type: Column) -> Column:
    return F.coalesce(F.element_at(_literal_map({k: v[1] for k, v in D.CONTENT_TYPES.items()}), content_type), F.lit("other"))


# --- chat lead attribution -------------------------------------------------
def page_quality(chat_leads: DataFrame) -> DataFrame:
    """Sum and count of chat quality per page."""
    return chat_leads.groupBy("page_id").agg(exact_sum(F.col("quality_score")).alias("q_sum"), F.count("quality_score").alias("q_n"))


def first_campaign_of_page(campaigns: DataFrame) -> DataFrame:
    """The first campaign of every page in list order."""
    return campaigns.groupBy("page_id").agg(F.min_by(
        F.struct("campaign_id", "content_type", "account_id", "bm_id"), F.struct("list_order", "campaign_id")).alias("f")).select("page_id", "f.*")


def quality_by_first(chat_leads: DataFrame, campaigns: DataFrame, key: str) -> DataFrame:
    """Chat quality per attribute of the page's first campaign."""
    return (page_quality(chat_leads).join(first_campaign_of_page(campaigns), "page_id")
            .groupBy(key).agg(F.sum("q_sum").alias("q_sum"), F.sum("q_n").alias("q_n")))


def _avg_quality(places: int) -> Column:
    return rate(F.coalesce("q_sum", F.lit(0)), F.coalesce("q_n", F.lit(0)), places)


# --- content types ---------------------------------------------------------
def insight_cube(insights: DataFrame) -> DataFrame:
    """Insight rows summed per content type, tier and day, written once.

    Its size is bounded by types x tiers x days however many rows come in, so
    the totals, the trend and the tier counts share one scan of the insights.
    """
    c = F.col
    cube = insights.groupBy(
        F.coalesce("content_type", F.lit("unknown")).alias("content_type"),
        F.coalesce("tier", F.lit("UNKNOWN")).alias("tier"), "date_start").agg(
            F.count("*").alias("rows"), exact_sum(c("spend")).alias("spend"), F.sum("leads").alias("leads"),
            F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
            exact_sum(c("ctr")).alias("ctr_sum"), exact_sum(c("frequency")).alias("frequency_sum"))
    return staged(cube, "cube")


def campaigns_per_type(insights: DataFrame) -> DataFrame:
    pairs = insights.select(F.coalesce("content_type", F.lit("unknown")).alias("content_type"), "campaign_id").distinct()
    return pairs.groupBy("content_type").agg(F.count("campaign_id").alias("campaigns"))


def content_daily(insights: DataFrame) -> DataFrame:
    return (insights.withColumn("content_type", F.coalesce("content_type", F.lit("unknown")))
            .groupBy("content_type", "date_start")
            .agg(exact_sum(F.col("spend")).alias("spend"), F.sum("leads").alias("leads")))


def cpl_trend(daily: DataFrame) -> DataFrame:
    """Cost per lead of the first three days against the last three, per content type."""
    days = Window.partitionBy("content_type")  # one row per day
    ranked = daily.withColumns({
        "_up": F.row_number().over(days.orderBy("date_start")),
        "_down": F.row_number().over(days.orderBy(F.desc("date_start")))})

    def cpl(end: str) -> Column:
        inside = F.col(end) <= 3
        return ratio(F.sum(F.when(inside, F.col("spend"))), F.greatest(F.sum(F.when(inside, F.col("leads"))), F.lit(1)))

    sums = ranked.groupBy("content_type").agg(F.count("*").alias("days"), cpl("_up").alias("early"), cpl("_down").alias("recent"))
    trend = F.when(F.col("days") < 4, "stable").when(F.col("recent") < F.col("early") * 0.9, "improving").when(
        F.col("recent") > F.col("early") * 1.1, "declining").otherwise("stable")
    return sums.select("content_type", trend.alias("trend"))


def tier_counts(insights: DataFrame) -> DataFrame:
    rows = F.sum("rows") if "rows" in insights.columns else F.count("*")
    return (insights.withColumn("content_type", F.coalesce("content_type", F.lit("unknown")))
            .groupBy("content_type", F.coalesce("tier", F.lit("UNKNOWN")).alias("tier")).agg(rows.alias("rows")))


def dominant_tier(counts: DataFrame) -> DataFrame:
    """Most frequent tier; of equal counts the first by name."""
    return counts.groupBy("content_type").agg(
        F.min_by("tier", F.struct((-F.col("rows")).alias("n"), "tier")).alias("dominant_tier"))


def composite(cpl: Column, quality: Column, ctr: Column, conv: Column, freq: Column) -> Column:
    parts = ((1 - rescale(cpl, 0, 900000)) * F.lit(0.35) + rescale(quality, 0, 10) * F.lit(0.30)
             + rescale(ctr, 0, 6) * F.lit(0.15) + rescale(conv, 0, 20) * F.lit(0.15)
             + (1 - rescale(freq, 1, 6)) * F.lit(0.05))
    return half_up(parts * 100, 1)


def content_performance(insights: DataFrame, campaigns: DataFrame, chat_leads: DataFrame) -> DataFrame:
    """Sums, rates, quality, composite score and flags per content type."""
    c = F.col
    cube = insight_cube(insights)
    sums = cube.groupBy("content_type").agg(
        F.sum("rows").alias("rows"), F.sum("spend").alias("spend"), F.sum("leads").alias("total_leads"),
        F.sum("clicks").alias("total_clicks"), F.sum("impressions").alias("total_impressions"),
        F.sum("ctr_sum").alias("_ctr"), F.sum("frequency_sum").alias("_freq"))
    quality = quality_by_first(chat_leads, campaigns, "content_type")
    b = D.CONTENT_BENCHMARKS
    out = (
        sums.join(campaigns_per_type(insights), "content_type").join(quality, "content_type", "left")
        .join(cpl_trend(content_daily(cube)), "content_type", "left")
        .join(dominant_tier(tier_counts(cube)), "content_type", "left")
        .withColumns({
            "label": content_label(c("content_type")), "format": content_format(c("content_type")),
            "total_spend": half_up(c("spend"), 0), "cpl": compute_cpl(c("spend"), c("total_leads")),
            "avg_ctr": rate(c("_ctr"), c("rows"), 2), "avg_freq": rate(c("_freq"), c("rows"), 2),
            "conv_rate": rate(c("total_leads"), c("total_clicks"), 2, 100),
            "cpm": rate(c("spend"), c("total_impressions"), 0, 1000), "avg_quality": _avg_quality(2)})
        .withColumn("composite_score", composite(c("cpl"), c("avg_quality"), c("avg_ctr"), c("conv_rate"), c("avg_freq")))
    )
    score, cpl = c("composite_score"), c("cpl")
    return out.withColumns({
        "reach": F.when(c("avg_freq") > 0, rate(c("total_impressions"), c("avg_freq"), 0).cast("bigint")).otherwise(c("total_impressions")),
        "rating": F.when(score >= 70, "excellent").when(score >= 50, "good").when(score >= 35, "average").otherwise("poor"),
        "cpl_vs_bench": F.when(cpl < b["cpl_good"], "good").when(cpl > b["cpl_poor"], "poor").otherwise("avg"),
        "ctr_vs_bench": F.when(c("avg_ctr") > b["ctr_good"], "good").when(c("avg_ctr") < b["ctr_poor"], "poor").otherwise("avg"),
        "qual_vs_bench": F.when(c("avg_quality") >= b["quality_good"], "good").when(c("avg_quality") < b["quality_poor"], "poor").otherwise("avg"),
        "freq_risk": F.when(c("avg_freq") > b["freq_warn"], "high").when(c("avg_freq") > b["freq_good"], "medium").otherwise("low"),
        "spend_pct": rate(c("total_spend"), exact_sum(c("total_spend")).over(_every()), 1, 100),
    }).drop("rows", "spend", "_ctr", "_freq", "q_sum", "q_n")


def format_performance(by_type: DataFrame) -> DataFrame:
    """Per format; quality weighted by the number of campaigns."""
    c = F.col
    return by_type.groupBy("format").agg(
        half_up(exact_sum(c("total_spend")), 0).alias("total_spend"), F.sum("total_leads").alias("total_leads"),
        compute_cpl(exact_sum(c("total_spend")), F.sum("total_leads")).alias("cpl"),
        rate(exact_sum(c("avg_quality") * c("campaigns")), F.sum("campaigns"), 2).alias("avg_quality"),
        rate(F.sum("total_leads"), F.sum("total_clicks"), 2, 100).alias("conv_rate"),
        F.sum("total_impressions").alias("impressions"), F.sum("total_clicks").alias("clicks"))


def funnel(by_format: DataFrame) -> DataFrame:
    return by_format.select("format", "impressions", "clicks", F.col("total_leads").alias("leads"), F.col("avg_quality").alias("quality"))


def format_daily_cpl(insights: DataFrame) -> DataFrame:
    """Day x format cost per lead in thousands; null without leads."""
    fmt = content_format(F.coalesce("content_type", F.lit("other")))
    c = F.col
    grouped = insights.withColumn("format", fmt).groupBy("date_start").pivot("format", D.CONTENT_FORMATS).agg(
        exact_sum(c("spend")).alias("s"), F.sum("leads").alias("l"))
    return grouped.select("date_start", *[
        F.when(c(f"{f}_l") > 0, half_up(c(f"{f}_s").cast("double") / c(f"{f}_l") / 1000, 1)).alias(f) for f in D.CONTENT_FORMATS])


def top_bottom(by_type: DataFrame, n: int = 5) -> DataFrame:
    """The n best, and the n worst with leads."""
    cols = ["content_type", "composite_score", "cpl"]
    best = by_type.select(*cols).orderBy(F.desc("composite_score"), "content_type").limit(n)
    worst = by_type.filter("total_leads > 0").select(*cols).orderBy("composite_score", "content_type").limit(n)
    return best.withColumn("side", F.lit("top")).unionByName(worst.withColumn("side", F.lit("bottom")))


def content_kpis(by_type: DataFrame, by_format: DataFrame) -> DataFrame:
    """Best and worst content, best format, lead-weighted quality; one row."""
    c = F.col
    kpi = by_type.agg(
        F.min_by("content_type", F.struct((-c("composite_score")).alias("s"), "content_type")).alias("best_content"),
        F.min_by("content_type", F.struct((-c("cpl")).alias("s"), "content_type")).alias("worst_content"),
        half_up(ratio(exact_sum(c("avg_quality") * c("total_leads")), F.greatest(F.sum("total_leads"), F.lit(1))), 1).alias("avg_quality"),
        F.count("*").alias("content_types"))
    best_format = by_format.agg(F.min_by("format", F.struct("cpl", "format")).alias("best_format"))
    return one_row(kpi, best_format)


def content_insights(by_type: DataFrame, by_format: DataFrame) -> DataFrame:
    """Rule messages as (rule, severity, subject, value)."""
    c = F.col

    def rows(df, rule, severity, subject, value):
        return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"),
                         value.cast("double").alias("value"))

    best = by_type.orderBy(F.desc("composite_score"), "content_type").limit(1)
    pair = by_format.agg(F.max(F.when(c("format") == "video", c("cpl"))).alias("video"),
                         F.max(F.when(c("format") == "image", c("cpl"))).alias("image")).filter("video IS NOT NULL AND image IS NOT NULL")
    improving = by_type.filter("trend = 'improving'").orderBy(F.desc("composite_score"), "content_type").limit(2)
    parts = [
        rows(best, "scale_best", "ok", c("content_type"), c("composite_score")),
        rows(pair, "video_vs_image", "info", F.when(c("video") < c("image"), "video").otherwise("image"), F.least("video", "image")),
        rows(by_format.filter("format = 'personal' AND cpl < 100000"), "personal_brand", "ok", c("format"), c("cpl")),
        rows(by_type.filter("trend = 'declining' AND total_leads > 5"), "declining", "warn", c("content_type"), c("cpl")),
        rows(by_type.filter("conv_rate < 2 AND total_spend > 5000000"), "poor_conversion", "crit", c("content_type"), c("conv_rate")),
        rows(by_type.filter("freq_risk = 'high' AND total_spend > 2000000"), "ad_fatigue", "warn", c("content_type"), c("avg_freq")),
        rows(improving, "improving", "ok", c("content_type"), c("cpl")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- accounts --------------------------------------------------------------
def _sums() -> list[Column]:
    c = F.col
    return [exact_sum(c("spend")).alias("spend"), F.sum("leads").alias("total_leads"), F.sum("clicks").alias("total_clicks"),
            F.sum("impressions").alias("total_impressions")]


def bm_of_account(bms: DataFrame) -> DataFrame:
    """Account -> business manager name and type from the account lists."""
    return bms.select(F.explode("accounts").alias("account_id"), "bm_name", "bm_type")


def account_rollup(insights: DataFrame, campaigns: DataFrame, chat_leads: DataFrame, bms: DataFrame) -> DataFrame:
    c = F.col
    sums = insights.groupBy("account_id").agg(
        *_sums(), F.count_distinct("campaign_id").alias("campaigns"), F.max("bm_id").alias("bm_id"),
        F.array_join(F.sort_array(F.collect_set("page_id")), ", ").alias("pages"))
    return (sums.join(quality_by_first(chat_leads, campaigns, "account_id"), "account_id", "left")
            .join(bm_of_account(bms), "account_id", "left")
            .select("account_id", "bm_id", F.coalesce("bm_name", F.lit("")).alias("bm_name"), F.coalesce("bm_type", F.lit("")).alias("bm_type"),
                    half_up(c("spend"), 0).alias("total_spend"), "total_leads", "total_clicks", "total_impressions",
                    compute_cpl(c("spend"), c("total_leads")).alias("cpl"),
                    rate(c("total_clicks"), c("total_impressions"), 2, 100).alias("ctr"), "campaigns", "pages", _avg_quality(2).alias("avg_quality")))


def bm_rollup(insights: DataFrame, campaigns: DataFrame, chat_leads: DataFrame) -> DataFrame:
    c = F.col
    pairs = insights.groupBy("bm_id", "account_id", "campaign_id").agg(*_sums())
    sums = pairs.groupBy("bm_id").agg(
        F.sum("spend").alias("spend"), F.sum("total_leads").alias("total_leads"),
        F.count_distinct("account_id").alias("accounts"), F.count_distinct("campaign_id").alias("campaigns"))
    return (sums.join(quality_by_first(chat_leads, campaigns, "bm_id"), "bm_id", "left")
            .select("bm_id", half_up(c("spend"), 0).alias("total_spend"), "total_leads",
                    compute_cpl(c("spend"), c("total_leads")).alias("cpl"), "accounts", "campaigns", _avg_quality(2).alias("avg_quality")))


def tier_rollup(insights: DataFrame, campaigns: DataFrame, chat_leads: DataFrame) -> DataFrame:
    """Campaigns, spend, leads, quality and share of spend per tier."""
    c = F.col
    counts = campaigns.groupBy("tier").agg(F.count("*").alias("campaign_count"))
    sums = insights.groupBy("tier").agg(exact_sum(c("spend")).alias("spend"), F.sum("leads").alias("total_leads"))
    quality = chat_leads.groupBy("tier").agg(exact_sum(c("quality_score")).alias("q_sum"), F.count("*").alias("q_n"))
    rows = counts.join(sums, "tier", "full_outer").join(quality, "tier", "full_outer").fillna(0, ["campaign_count", "total_leads"])
    spend = F.coalesce("spend", F.lit(0))
    return (rows.withColumn("total_spend", half_up(spend, 0))
            .withColumn("cpl", compute_cpl(spend, c("total_leads"))).withColumn("avg_quality", _avg_quality(2))
            .withColumn("spend_pct", rate(c("total_spend"), exact_sum(c("total_spend")).over(_every()), 1, 100))
            .select("tier", "campaign_count", "total_spend", "total_leads", "cpl", "avg_quality", "spend_pct"))


def campaign_metrics(insights: DataFrame, campaigns: DataFrame, chat_leads: DataFrame,
                     bm: str = "all", account: str = "all", tier: str = "all") -> DataFrame:
    """Metrics of the selected campaigns; quality of all chat leads of the page."""
    c = F.col
    chosen = campaigns
    for col, value in (("bm_id", bm), ("account_id", account), ("tier", tier)):
        if value != "all":
            chosen = chosen.filter(c(col) == value)
    sums = insights.groupBy("campaign_id").agg(
        exact_sum(c("spend")).alias("spend"), F.sum("leads").alias("leads"), exact_sum(c("ctr")).alias("_ctr"),
        exact_sum(c("frequency")).alias("_freq"), F.count("*").alias("rows"))
    return (chosen.join(sums, "campaign_id", "left").join(page_quality(chat_leads), "page_id", "left")
            .fillna(0, ["leads", "rows"]).withColumn("spend", F.coalesce("spend", F.lit(0)))
            .select("campaign_id", "campaign_name", "account_id", "bm_id", "page_id", "tier", "status", "objective",
                    "content_type", "daily_budget", half_up(c("spend"), 0).alias("total_spend"), c("leads").alias("total_leads"),
                    compute_cpl(c("spend"), c("leads")).alias("cpl"),
                    rate(F.coalesce("_ctr", F.lit(0)), c("rows"), 2).alias("ctr"),
                    rate(F.coalesce("_freq", F.lit(0)), c("rows"), 2).alias("frequency"), _avg_quality(1).alias("avg_quality")))


def overview(insights: DataFrame, campaigns: DataFrame, adsets: DataFrame, chat_leads: DataFrame) -> DataFrame:
    """One row of totals; every part is a single aggregated row."""
    c = F.col
    return one_row(
        insights.agg(half_up(exact_sum(c("spend")), 0).alias("total_spend"), F.sum("leads").alias("total_leads"),
                     F.sum("impressions").alias("total_impressions"),
                     compute_cpl(exact_sum(c("spend")), F.sum("leads")).alias("overall_cpl")),
        campaigns.agg(F.count("*").alias("total_campaigns"), F.count_distinct("bm_id").alias("total_bms"),
                      F.count_distinct("account_id").alias("total_accounts"), F.count_distinct("page_id").alias("total_pages")),
        adsets.agg(F.count("*").alias("total_adsets")),
        chat_leads.agg(F.count("*").alias("messenger_leads"),
                       rate(exact_sum(c("quality_score")), F.count("quality_score"), 2).alias("avg_quality")))


def day_bm_trend(insights: DataFrame, bm_ids: list[str]) -> DataFrame:
    """Spend in millions and leads per day and business manager; 0 when missing."""
    c = F.col
    wide = insights.groupBy("date_start").pivot("bm_id", bm_ids).agg(exact_sum(c("spend")).alias("s"), F.sum("leads").alias("l"))
    return wide.select("date_start", *[x for b in bm_ids for x in (
        half_up(F.coalesce(c(f"{b}_s"), F.lit(0)).cast("double") / 1000000, 2).alias(f"{b}_spend"),
        F.coalesce(c(f"{b}_l"), F.lit(0)).alias(f"{b}_leads"))])


def account_insights(by_bm: DataFrame, by_tier: DataFrame, by_account: DataFrame) -> DataFrame:
    """Rule messages as (rule, severity, subject, value)."""
    c = F.col

    def rows(df, rule, severity, subject, value):
        return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"),
                         value.cast("double").alias("value"))

    bms = by_bm.agg(F.count("*").alias("n"), F.min_by(F.struct("bm_id", "cpl"), F.struct("cpl", "bm_id")).alias("best"),
                    F.max_by(F.struct("bm_id", "cpl"), F.struct("cpl", "bm_id")).alias("worst")).filter("n >= 2")
    accs = by_account.agg(
        F.max_by(F.struct("account_id", "avg_quality"), F.struct("avg_quality", "account_id")).alias("best"),
        F.min_by(F.struct("account_id", "avg_quality"), F.struct("avg_quality", "account_id")).alias("worst")
    ).filter("best.account_id <> worst.account_id")
    agent = by_account.filter(c("account_id").contains("agent")).orderBy(F.desc("total_spend"), "account_id").limit(1)
    parts = [
        rows(bms, "best_bm", "ok", c("best.bm_id"), c("best.cpl")),
        rows(bms.filter("worst.cpl > 300000"), "costly_bm", "warn", c("worst.bm_id"), c("worst.cpl")),
        rows(by_tier.filter("tier = 'POOR' AND spend_pct > 5"), "poor_tier_spend", "crit", c("tier"), c("spend_pct")),
        rows(by_tier.filter("tier = 'WINNER' AND campaign_count > 0"), "scale_winners", "ok", c("tier"), c("campaign_count")),
        rows(accs, "quality_gap", "info", F.concat_ws(" vs ", "best.account_id", "worst.account_id"),
             half_up(c("best.avg_quality") - c("worst.avg_quality"), 2)),
        rows(by_tier.filter("tier = 'DECLINING' AND campaign_count > 0"), "declining_tier", "warn", c("tier"), c("campaign_count")),
        rows(agent.filter("cpl < 150000"), "agent_account", "ok", c("account_id"), c("cpl")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
