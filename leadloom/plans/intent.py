"""Queries over chat messages and 360 degree profiles."""

from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import dates as DT
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.operators import intent as I
from leadloom.operators import profile as PR
from leadloom.plans import duck as O
from leadloom.plans import reports as RP
from leadloom.plans.registry import cte, query
from leadloom.plans.views import load

c = F.col
CATS = I.CATEGORIES


def messages(spark, sf):
    return load(spark, sf, "v_messages")


_NORM = r"regexp_replace(regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g'), '([0-9])\s*-\s*([0-9])', '\1', 'g')"
cte("o_norm", f"SELECT *, {_NORM} AS norm FROM {{v_messages}}")
cte("o_patterns", "SELECT * FROM " + O.values([(i, cat, p, float(s), label) for i, (cat, p, s, label) in enumerate(D.INTENT_SIGNALS)])
    + " v(ord, category, pattern, score, label)")
cte("o_signals", """
SELECT conv_id, idx, CAST(ord AS INTEGER) AS ord, category, label, CAST(score AS DOUBLE) AS score,
       '...' || trim(regexp_extract(norm, '.{0,10}?(?:' || pattern || ').{0,20}', 0)) || '...' AS snippet
FROM {o_norm}, {o_patterns} WHERE sender = 'customer' AND regexp_matches(norm, pattern)""")


@query("txt13_msg_normalise", "SELECT conv_id, idx, norm FROM {o_norm}")
def txt13_msg_normalise(spark, sf):
    return messages(spark, sf).select("conv_id", "idx", T.message_normalise(c("text")).alias("norm"))


@query("txt14_signal_extract", "SELECT * FROM {o_signals}")
def txt14_signal_extract(spark, sf):
    return I.extract_signals(messages(spark, sf))


_AMOUNT = r"'[0-9]+\s*(tỷ|triệu|(tr|ty)([^\pL\pN_]|$))'"


def _intent(t):
    return O.rnd(f"least(10e0, least(6e0, {O.hits(t, D.HIGH_INTENT_WORDS)} * 1.5e0) + least(3e0, {O.hits(t, D.MEDIUM_INTENT_WORDS)} * 0.5e0) "
                 f"+ (CASE WHEN regexp_matches({t}, '0[3-9][0-9]{{8}}') THEN 1.5e0 ELSE 0e0 END) + (CASE WHEN regexp_matches({t}, {_AMOUNT}) THEN 0.5e0 ELSE 0e0 END))", 2)


@query("txt15_chat_intent_kw", f"SELECT conv_id, idx, {_intent('lower(text)')} AS intent_score FROM {{v_messages}}")
def txt15_chat_intent_kw(spark, sf):
    return messages(spark, sf).select("conv_id", "idx", T.chat_intent(c("text")).alias("intent_score"))


@query("txt16_ad_id_from_thread", """
SELECT conversation_id, CASE WHEN lead_no % 3 = 0 THEN NULL ELSE CAST(lead_no AS VARCHAR) END AS ad_id FROM {v_chat_leads}""")
def txt16_ad_id_from_thread(spark, sf):
    thread = F.when(c("lead_no") % 3 == 0, F.concat(F.lit("t_"), c("lead_no"))).when(
        c("lead_no") % 3 == 1, F.concat(F.lit("t_ad_x_ad_"), c("lead_no"), F.lit("_ref"))).otherwise(F.concat(F.lit("ad_"), c("lead_no")))
    return load(spark, sf, "v_chat_leads").select("conversation_id", T.ad_of_thread(thread).alias("ad_id"))


@query("txt17_chat_contact", """
SELECT conv_id, idx, nullif(regexp_extract(lower(text), '0[3-9][0-9]{8}', 0), '') AS phone,
       nullif(regexp_extract(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_]+', 0), '') AS email FROM {v_messages}""")
def txt17_chat_contact(spark, sf):
    return messages(spark, sf).select("conv_id", "idx", T.chat_phone(c("text")).alias("phone"), T.chat_email(c("text")).alias("email"))


cte("o_times", """
SELECT conv_id, idx, sender, coalesce(try_strptime(CASE WHEN ts_text = '' THEN NULL ELSE '1900/' || ts_text END, '%Y/%d/%m %H:%M'),
       try_strptime(ts_text, '%Y-%m-%dT%H:%M:%S'), try_strptime('1900-01-01 ' || ts_text, '%Y-%m-%d %H:%M')) AS ts FROM {v_messages}""")


@query("dat3_multi_format_ts", "SELECT conv_id, idx, CAST(epoch(ts) AS BIGINT) AS seconds FROM {o_times}")
def dat3_multi_format_ts(spark, sf):
    return messages(spark, sf).select("conv_id", "idx", F.unix_timestamp(DT.chat_timestamp(c("ts_text"))).alias("seconds"))


_AGG = ", ".join(f"max(score) FILTER (WHERE category = '{k}') AS m_{k}, sum(score) FILTER (WHERE category = '{k}' AND score > 0) AS p_{k}" for k in CATS)


def _raw(k):
    return f"coalesce(m_{k} + 0.5e0 * least(coalesce(p_{k}, 0e0) * 0.1e0, 2e0), 0e0)"


def _norm(k):
    clipped = f"abs({_raw(k)})" if k == "CONCERN" else f"greatest(0e0, {_raw(k)})"
    return O.rnd(f"least(10e0, {clipped})", 1)


def _scores(key, msgs, sigs):
    return f"""
SELECT {key}, message_count, customer_message_count, coalesce(n_signals, 0) AS n_signals, {', '.join(f"{O.rnd(_raw(k), 2)} AS raw_{k}, {_norm(k)} AS norm_{k}" for k in CATS)}
FROM (SELECT {key}, count(*) AS message_count, count(*) FILTER (WHERE sender = 'customer') AS customer_message_count FROM {msgs} GROUP BY 1) b
LEFT JOIN (SELECT {key}, count(*) AS n_signals, {_AGG} FROM {sigs} GROUP BY 1) s USING ({key})"""


_COMPOSITE = O.rnd("least(10, greatest(0, " + " + ".join(
    f"CAST(norm_{k} AS DECIMAL(6,2)) * {-0.3 if k == 'CONCERN' else w}" for k, (w, _) in D.INTENT_CATEGORIES.items()).replace("+ CAST(norm_CONCERN AS DECIMAL(6,2)) * -0.3", "- CAST(norm_CONCERN AS DECIMAL(6,2)) * 0.3") + "))", 1)
_STAGE = (f"CASE WHEN raw_TRANSACTION <> 0 OR raw_SCHEDULING <> 0 THEN {O.lit(D.STAGES['closing'])} WHEN raw_QUALIFICATION <> 0 OR raw_LEGAL_CHECK <> 0 THEN {O.lit(D.STAGES['evaluating'])} "
          f"WHEN raw_RESEARCH <> 0 THEN {O.lit(D.STAGES['collecting'])} ELSE {O.lit(D.STAGES['opening'])} END")


def _summary(src):
    a = D.NEXT_ACTIONS

    def level(i):
        return "CASE " + " ".join(f"WHEN composite_score >= {e[0]}e0 THEN {O.lit(e[i])}" for e in D.INTENT_LEVELS[:-1]) + f" ELSE {O.lit(D.INTENT_LEVELS[-1][i])} END"

    def act(i):
        return (f"CASE WHEN norm_TRANSACTION >= 8 OR norm_SCHEDULING >= 8 THEN {O.lit(a['call_now'][i])} WHEN norm_TRANSACTION >= 5 OR norm_SCHEDULING >= 6 THEN {O.lit(a['call_24h'][i])} "
                f"WHEN norm_QUALIFICATION >= 6 THEN {O.lit(a['send_finance'][i])} WHEN norm_CONCERN >= 4 THEN {O.lit(a['handle_concern'][i])} ELSE {O.lit(a['nurture'][i])} END")

    pos = [k for k in CATS if k != "CONCERN"]
    items = ", ".join(f"{{'k': -norm_{k}, 'i': {i}, 'l': {O.lit(D.INTENT_CATEGORIES[k][1])}}}" for i, k in enumerate(pos))
    return f"""
SELECT *, 'Khách ở giai đoạn «' || conversation_stage || '» với intent tập trung vào ' || CASE WHEN focus = '' THEN 'chung' ELSE focus END || '. Điểm tổng hợp '
       || CAST(composite_score AS VARCHAR) || '/10 — ' || intent_level || '.' || CASE WHEN norm_CONCERN >= 3 THEN ' Có ' || CAST(CAST({O.rnd('norm_CONCERN', 0)} AS INTEGER) AS VARCHAR) || ' điểm lo ngại cần xử lý.' ELSE '' END
       || ' Đề xuất: ' || next_action || '.' AS summary
FROM (SELECT *, {_STAGE} AS conversation_stage, {level(1)} AS intent_level, {level(2)} AS intent_color, {level(3)} AS purchase_probability, {act(0)} AS next_action, {act(1)} AS urgency,
             CASE WHEN n_signals >= 5 THEN 'high' WHEN n_signals >= 2 THEN 'medium' ELSE 'low' END AS confidence,
             array_to_string(list_transform(list_sort(list_filter([{items}], lambda e: e.k < 0))[1:2], lambda e: e.l), ' & ') AS focus
      FROM (SELECT *, {_COMPOSITE} AS composite_score FROM {src}) a) b"""


cte("o_scores", _scores("conv_id", "{v_messages}", "{o_signals}"))
cte("o_intent", _summary("{o_scores}"))


def scores(spark, sf):
    m = messages(spark, sf)
    return I.category_scores(m, I.extract_signals(m))


@query("agg39_category_scores", " UNION ALL ".join(f"SELECT conv_id, '{k}' AS category, raw_{k} AS raw_score, norm_{k} AS normalized FROM {{o_scores}}" for k in CATS))
def agg39_category_scores(spark, sf):
    return I.category_rows(scores(spark, sf))


@query("agg40_intent_composite", f"SELECT conv_id, {_COMPOSITE} AS composite_score FROM {{o_scores}}")
def agg40_intent_composite(spark, sf):
    return scores(spark, sf).select("conv_id", I.composite().alias("composite_score"))


@query("scr16_conversation_stage", f"SELECT conv_id, {_STAGE} AS conversation_stage FROM {{o_scores}}")
def scr16_conversation_stage(spark, sf):
    return scores(spark, sf).select("conv_id", I.stage().alias("conversation_stage"))


cte("o_response", f"""
SELECT conv_id, {O.rnd('sum(gap) / 60e0 / count(*)', 1)} AS avg_response_time_min
FROM (SELECT conv_id, sender, lag(sender) OVER w AS ps, abs(CAST(epoch(ts) AS BIGINT) - CAST(epoch(lag(ts) OVER w) AS BIGINT)) AS gap
      FROM {{o_times}} WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY idx)) t
WHERE ps <> sender AND gap > 0 AND gap < 86400 GROUP BY conv_id""")


@query("win2_response_time", "SELECT * FROM {o_response}")
def win2_response_time(spark, sf):
    return I.response_time(messages(spark, sf))


_PR = D.PROGRESSION
cte("o_progress", f"""
SELECT conv_id, CASE WHEN m < 3 THEN {O.lit(_PR['short'])} WHEN b > a * 1.3 THEN {O.lit(_PR['up'])} WHEN b < a * 0.7 THEN {O.lit(_PR['down'])} ELSE {O.lit(_PR['flat'])} END AS progression
FROM (SELECT conv_id, max(m) AS m, sum(CASE WHEN rn <= m // 2 THEN n ELSE 0 END) AS a, sum(CASE WHEN rn > m // 2 THEN n ELSE 0 END) AS b
      FROM (SELECT x.conv_id, row_number() OVER (PARTITION BY x.conv_id ORDER BY x.idx) AS rn, count(*) OVER (PARTITION BY x.conv_id) AS m, coalesce(s.n, 0) AS n
            FROM {{v_messages}} x LEFT JOIN (SELECT conv_id, idx, count(*) AS n FROM {{o_signals}} WHERE category <> 'CONCERN' GROUP BY 1, 2) s ON s.conv_id = x.conv_id AND s.idx = x.idx
            WHERE x.sender = 'customer') t GROUP BY 1) u""")


@query("win3_progression", "SELECT * FROM {o_progress}")
def win3_progression(spark, sf):
    return I.progression(messages(spark, sf))


_OUT = ["conv_id", "composite_score", "intent_level", "intent_color", "purchase_probability", "next_action", "urgency", "confidence",
        "conversation_stage", "summary", "message_count", "customer_message_count", "avg_response_time_min", "response_speed", "progression"]
_SPEED = "CASE WHEN avg_response_time_min IS NULL THEN " + O.lit(D.RESPONSE_UNKNOWN) + " " + " ".join(
    f"WHEN avg_response_time_min <= {b} THEN {O.lit(t)}" for b, t in D.RESPONSE_SPEED[:-1]) + f" ELSE {O.lit(D.RESPONSE_SPEED[-1][1])} END"
cte("o_analyzed", f"SELECT i.*, avg_response_time_min, {_SPEED} AS response_speed, coalesce(progression, {O.lit(_PR['short'])}) AS progression FROM {{o_intent}} i LEFT JOIN {{o_response}} USING (conv_id) LEFT JOIN {{o_progress}} USING (conv_id)")


@query("scr17_intent_summary", f"SELECT {', '.join(_OUT)} FROM {{o_analyzed}}")
def scr17_intent_summary(spark, sf):
    return I.analyze(messages(spark, sf)).select(*_OUT)


cte("o_single", "SELECT conv_id || '#' || idx AS msg_key, * FROM {v_messages} WHERE sender = 'customer'")
cte("o_single_signals", "SELECT conv_id || '#' || idx AS msg_key, * FROM {o_signals}")
cte("o_single_scores", _scores("msg_key", "{o_single}", "{o_single_signals}"))
cte("o_single_intent", _summary("{o_single_scores}"))


@query("scr18_single_message", "SELECT msg_key, composite_score, intent_level, next_action, urgency, confidence FROM {o_single_intent}")
def scr18_single_message(spark, sf):
    return I.analyze_messages(messages(spark, sf)).select("msg_key", "composite_score", "intent_level", "next_action", "urgency", "confidence")


@query("scr18_empty_conversations", f"""
SELECT d.doc_id AS conv_id, coalesce(composite_score, 0e0) AS composite_score, coalesce(conversation_stage, {O.lit(D.EMPTY_CHAT['stage'])}) AS conversation_stage,
       coalesce(next_action, {O.lit(D.EMPTY_CHAT['next_action'])}) AS next_action, coalesce(summary, {O.lit(D.EMPTY_CHAT['summary'])}) AS summary
FROM {{documents}} d LEFT JOIN {{o_analyzed}} a ON a.conv_id = d.doc_id""")
def scr18_empty_conversations(spark, sf):
    """Ids of the documents table stand for conversations, most of them without messages."""
    ids = load(spark, sf, "documents").select(c("doc_id").alias("conv_id"))
    return I.with_empty(ids, I.analyze(messages(spark, sf))).select("conv_id", "composite_score", "conversation_stage", "next_action", "summary")


@query("win7_top_signals", "SELECT conv_id, idx, ord, label, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, idx, ord) AS r FROM {o_signals} WHERE score > 0) t WHERE r <= 6")
def win7_top_signals(spark, sf):
    return I.top_signals(I.extract_signals(messages(spark, sf))).select("conv_id", "idx", "ord", "label", "score", "rank")


@query("win7_last_messages", "SELECT conv_id, idx, sender, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS r FROM {v_messages}) t WHERE r <= 3")
def win7_last_messages(spark, sf):
    return I.last_messages(messages(spark, sf))


cte("o_joined", "SELECT conv_id, lower(string_agg(text, ' ' ORDER BY idx)) AS t, count(*) AS message_count, arg_min(sender, idx) FILTER (WHERE sender <> 'agent') AS first_sender FROM {v_messages} GROUP BY conv_id")
cte("o_chat_lead", f"""
SELECT conv_id, nullif(regexp_extract(t, '0[3-9][0-9]{{8}}', 0), '') AS phone, nullif(regexp_extract(t, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_]+', 0), '') AS email,
       message_count, first_sender, {_intent('t')} AS intent_score, t AS full_text FROM {{o_joined}}""")


@query("agg41_chat_lead", "SELECT * FROM {o_chat_lead}")
def agg41_chat_lead(spark, sf):
    return I.chat_leads(messages(spark, sf))


@query("snk14_conversation_upsert", """
SELECT coalesce(f.conversation_id, s.conversation_id) AS conversation_id, coalesce(s.phone, f.phone) AS phone, coalesce(f.message_count, s.message_count) AS message_count,
       coalesce(f.intent_score, s.intent_score) AS intent_score
FROM (SELECT conversation_id, phone, message_count, intent_score FROM {v_chat_leads} WHERE lead_no % 3 <> 0) s
FULL JOIN (SELECT 'm_' || conv_id AS conversation_id, phone, message_count, intent_score FROM {o_chat_lead}) f ON s.conversation_id = f.conversation_id""")
def snk14_conversation_upsert(spark, sf):
    cols = ["conversation_id", "phone", "message_count", "intent_score"]
    stored = load(spark, sf, "v_chat_leads").filter("lead_no % 3 <> 0").select(*cols)
    fresh = I.chat_leads(messages(spark, sf)).withColumn("conversation_id", F.concat(F.lit("m_"), c("conv_id"))).select(*cols)
    return I.conversation_upsert(stored, fresh)


# --- 360 profile -----------------------------------------------------------
cte("o_social", """
SELECT '+84' || substr(phone, 2) AS profile_key, (lead_no % 11) * 1e0 AS activity_score, (lead_no % 90) * 1e6 AS income,
       CASE lead_no % 4 WHEN 0 THEN 'realestate' WHEN 1 THEN 'finance' ELSE 'retail' END AS sector, CAST(lead_no % 4 AS INTEGER) AS children, CAST(20 + lead_no % 40 AS INTEGER) AS age
FROM {v_chat_leads} WHERE phone IS NOT NULL AND lead_no % 5 <> 0""")


def social(spark, sf):
    n = c("lead_no")
    return load(spark, sf, "v_chat_leads").filter("phone IS NOT NULL AND lead_no % 5 <> 0").select(
        P.phone_join_key(c("phone")).alias("profile_key"), ((n % 11) * F.lit(1.0)).alias("activity_score"), ((n % 90) * F.lit(1e6)).alias("income"),
        F.when(n % 4 == 0, "realestate").when(n % 4 == 1, "finance").otherwise("retail").alias("sector"),
        (n % 4).cast("int").alias("children"), (20 + n % 40).cast("int").alias("age"))


cte("o_top_hot", """
SELECT profile_key, count(*) AS n, max(hot_score) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_key ORDER BY hot_score DESC, source, seq) AS r FROM {o_match} WHERE profile_key IS NOT NULL) t WHERE r <= 10 GROUP BY 1""")
cte("o_chat_sum", f"SELECT '+84' || substr(phone, 2) AS profile_key, count(*) AS chats, {O.eavg('quality_score', 4)} AS q, count(DISTINCT fb_ad_id) AS ads FROM {{v_chat_leads}} WHERE phone IS NOT NULL GROUP BY 1")
cte("o_360", f"""
SELECT profile_key, lead_score, cluster, coalesce(h.n, 0) AS n_behaviors, coalesce(chats, 0) AS chats, coalesce(ads, 0) AS ads, coalesce(q, 0e0) AS q, sector, income, children, age,
       {O.rnd('least(10e0, lead_score * 0.35e0 + coalesce(q, 0e0) * 0.30e0 + coalesce(h.best, lead_score * 0.8e0) * 0.20e0 + coalesce(activity_score, 0e0) * 0.15e0)', 1)} AS intent_score
FROM {{o_leads}} LEFT JOIN {{o_top_hot}} h USING (profile_key) LEFT JOIN {{o_chat_sum}} USING (profile_key) LEFT JOIN {{o_social}} USING (profile_key)""")


def _p360(spark, sf):
    leads, matched = RP.scored_profiles(spark, sf, events=True)
    return PR.profile_360(leads, matched, load(spark, sf, "v_chat_leads"), social(spark, sf))


@query("join17_profile_360", "SELECT profile_key, CAST(n_behaviors AS INTEGER) AS n_behaviors, chats, ads AS ad_touches FROM {o_360}")
def join17_profile_360(spark, sf):
    return _p360(spark, sf).select("profile_key", "n_behaviors", "chats", "ad_touches")


_PB = D.PROFILE_PROBABILITY


def _band(i):
    return "CASE " + " ".join(f"WHEN intent_score >= {e[0]} THEN {O.lit(e[i])}" for e in _PB[:-1]) + f" ELSE {O.lit(_PB[-1][i])} END"


@query("scr19_profile_360", f"""
SELECT profile_key, intent_score, {O.rnd('q', 1)} AS agg_quality, {_band(1)} AS prob_label, {_band(2)} AS prob_pct,
       CASE cluster WHEN 2 THEN 'VIP' WHEN 1 THEN 'Ở thực' ELSE 'Đầu cơ' END AS cluster_label, CASE cluster WHEN 2 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END AS priority,
       least(10e0, 5e0 + (CASE WHEN cluster = 2 AND income >= 40000000 THEN 3e0 ELSE 0e0 END) + (CASE WHEN cluster = 0 AND sector IN ('realestate', 'finance') THEN 2.5e0 ELSE 0e0 END)
             + (CASE WHEN cluster = 1 AND children > 0 THEN 2e0 ELSE 0e0 END) + (CASE WHEN age >= 30 THEN 1e0 ELSE 0e0 END)) AS profile_fit,
       coalesce(nullif(concat_ws('; ', CASE WHEN intent_score >= 8 THEN 'Gọi điện ngay' END, CASE WHEN cluster = 2 THEN 'Chuẩn bị offer VIP' END, CASE WHEN q >= 7 THEN 'Đặt lịch xem nhà mẫu' END,
             CASE WHEN sector = 'realestate' THEN 'Tư vấn đầu tư' END, CASE WHEN ads >= 2 THEN 'Gửi tài liệu dự án' END), ''), 'Nuture qua Messenger') AS actions
FROM {{o_360}}""")
def scr19_profile_360(spark, sf):
    return _p360(spark, sf).select("profile_key", "intent_score", "agg_quality", "prob_label", "prob_pct", "cluster_label", "priority",
                                   "profile_fit", F.array_join("actions", "; ").alias("actions"))
