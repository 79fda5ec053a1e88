"""Scoring models: one select each over joined rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import dates as DT
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.functions.numbers import half_up, steps


def _filled(value: Column, nulls: tuple[str, ...]) -> Column:
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return (text != "") & ~text.isin(*nulls)


def _points(cond: Column, points: float) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))


def contact_score(phone: Column, email: Column, address: Column, province: Column,
                  file_name: Column, note: Column) -> Column:
    """0..10: reachability plus a bonus for VIP words."""
    located = _filled(address, ()) | (F.coalesce(province, F.lit("Unknown")) != "Unknown")
    total = (_points(_filled(phone, ()), 5.0) + _points(_filled(email, ()), 3.0)
             + _points(located, 2.0) + _points(T.has_vip_word(file_name, note), 2.0))
    return F.least(total, F.lit(10.0)).cast("int")


def completeness(phone: Column, email: Column, name: Column, address: Column) -> Column:
    return (_points(_filled(phone, ("nan", "none")), 20.0)
            + _points(_filled(email, ("nan", "none")) & email.contains("@"), 5.0)
            + _points(_filled(name, ("none", "nan", "unknown", "n/a", "-")), 3.0)
            + _points(_filled(address, ("nan", "none")) & (F.length(F.trim(address)) > 4), 2.0))


def source_quality(weight: Column) -> Column:
    w = F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.coalesce(weight, F.lit(0.25))))
    return half_up((w - F.lit(0.25)) / F.lit(0.75) * F.lit(25.0), 2)


def behavioral(intent: Column, chat_phone: Column, quality: Column) -> Column:
    points = (F.greatest(F.lit(0.0), F.least(F.lit(7.0), F.coalesce(intent, F.lit(0.0)) * F.lit(0.7)))
              + _points(chat_phone, 2.0) + _points(quality >= 7, 1.0))
    return half_up(F.least(points, F.lit(10.0)), 2)


def grade(score: Column) -> Column:
    out = F.lit(D.GRADES[-1][1])
    for bound, letter, _ in reversed(D.GRADES[:-1]):
        out = F.when(score >= bound, F.lit(letter)).otherwise(out)
    return out


def grade_label(letter: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, g, label in D.GRADES:
        out = F.when(letter == g, F.lit(label)).otherwise(out)
    return out


def unified_score(contacts: DataFrame, as_of: str, intent: Column | None = None,
                  chat_phone: Column | None = None, quality: Column | None = None) -> DataFrame:
    """Adds the five parts, the 0..100 total, its grade and label."""
    zero = F.lit(0.0)
    parts = {
        "s_completeness": completeness(F.col("phone"), F.col("email"), F.col("name"), F.col("address")),
        "s_source_quality": source_quality(F.col("source_weight")),
        "s_cross_source": DT.cross_source(F.col("source_count")),
        "s_recency": DT.unified_recency(F.col("latest_file_date"), as_of),
        "s_behavioral": behavioral(zero if intent is None else intent,
                                   F.lit(False) if chat_phone is None else chat_phone,
                                   zero if quality is None else quality),
    }
    total = sum((F.col(p).cast("decimal(10,2)") for p in list(parts)[1:]),
                F.col("s_completeness").cast("decimal(10,2)"))
    return (contacts.withColumns(parts)
            .withColumn("unified_score", half_up(F.least(total, F.lit(100)), 1))
            .withColumn("grade", grade(F.col("unified_score")))
            .withColumn("grade_label", grade_label(F.col("grade"))))


def legacy_score(unified: Column) -> Column:
    return half_up(F.least(unified.cast("decimal(20,6)") / F.lit(10), F.lit(10)), 1)


def rfm(source_count: Column, weight: Column, latest: Column, as_of: str) -> Column:
    raw = (DT.rfm_recency(latest, as_of).cast("decimal(10,4)") * F.expr("CAST(0.3 AS DECIMAL(4,2))")
           + DT.rfm_frequency(source_count).cast("decimal(10,4)") * F.expr("CAST(0.4 AS DECIMAL(4,2))")
           + DT.rfm_monetary(weight).cast("decimal(10,4)") * F.expr("CAST(0.3 AS DECIMAL(4,2))"))
    return half_up(raw * F.lit(2), 2)


def rfm_segment(score: Column) -> Column:
    return steps(score, D.RFM_SEGMENTS[:-1], D.RFM_SEGMENTS[-1][1])


def rescore(contacts: DataFrame, as_of: str) -> DataFrame:
    """All stored scores of the golden contacts in one select, no shuffle."""
    return T.with_province(
        unified_score(contacts, as_of)
        .withColumn("legacy_score", legacy_score(F.col("unified_score")))
        .withColumn("rfm_score", rfm(F.col("source_count"), F.col("source_weight"),
                                     F.col("latest_file_date"), as_of))
        .withColumn("rfm_segment", rfm_segment(F.col("rfm_score")))
        .withColumn("province_phone", P.province_from_phone(F.col("phone")))
        .withColumn("score", contact_score(F.col("phone"), F.col("email"), F.col("address"),
                                           F.lit("Unknown"), F.col("file_source"), F.col("note"))),
        F.col("address"), F.col("file_source"))


def lead_score(phone: Column, uid: Column, email: Column, cluster: Column, fb: Column,
               search: Column, source_count: Column, unified: Column, tier: Column) -> Column:
    """0..10 call priority of a profile."""
    fb, search = F.coalesce(fb, F.lit(0.0)), F.coalesce(search, F.lit(0.0))
    tier_points = F.lit(0.0)
    for names, points in (
        (("banking_vip", "real_estate_vip"), 2.0), (("ceo_director", "automotive_vip"), 1.5),
        (("stock_gold", "fitness_health"), 1.0), (("education_hr", "telecom_mass"), 0.5),
    ):
        tier_points = F.when(tier.isin(*names), F.lit(points)).otherwise(tier_points)
    total = (
        _points(_filled(phone, ()), 2.0) + _points(_filled(uid, ()), 1.0) + _points(_filled(email, ()), 1.0)
        + _points(cluster == 2, 2.0) + _points(cluster == 1, 1.0)
        + F.when(fb > 0, F.least(F.lit(2.0), fb / F.lit(5.0))).otherwise(F.lit(0.0))
        + F.when(search > 0, F.least(F.lit(2.0), search / F.lit(4.0))).otherwise(F.lit(0.0))
        + steps(F.coalesce(source_count, F.lit(1)), [(4, 1.5), (2, 1.0)], 0.0)
        + steps(F.coalesce(unified, F.lit(0.0)), [(80, 2.0), (70, 1.5), (50, 0.5)], 0.0)
        + tier_points)
    return half_up(F.least(total, F.lit(10.0)), 2)


def chat_quality(sender: Column, phone: Column, email: Column, intent: Column, messages: Column,
                 matched: Column, profile_score: Column) -> Column:
    """0..10 quality of a chat lead."""
    n = F.coalesce(messages, F.lit(0))
    total = (
        _points(_filled(sender, ()), 1.0) + _points(_filled(phone, ()), 1.5) + _points(_filled(email, ()), 0.5)
        + F.least(F.lit(3.0), F.coalesce(intent, F.lit(0.0)) * F.lit(0.3))
        + steps(n, [(6, 2.0), (4, 1.5), (2, 1.0)], 0.0) + steps(n, [(10, 2.0), (6, 1.0), (3, 0.5)], 0.0)
        + _points(matched, 0.5)
        + steps(F.coalesce(profile_score, F.lit(0.0)), [(8, 1.0), (6, 0.5)], 0.0))
    return half_up(F.least(total, F.lit(10.0)), 2)
