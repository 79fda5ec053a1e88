"""Test views: the engine's input tables, derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both accept; ``{name}`` stands
for a base table or another view.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from leadloom import dictionaries as D
from leadloom.operators.common import spread

BASE = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()


FACTS = ("orders", "lineitem", "events", "conversations", "pages")


def _pick(index: str, values: list[str]) -> str:
    """The index-th text of a list."""
    joined = "|".join(values).replace("'", "''")
    return f"split_part('{joined}', '|', CAST({index} AS INT) + 1)"


def _phone(key: str) -> str:
    return (f"(substr('091032070086024099', CAST(({key}) % 6 AS INT) * 3 + 1, 3)"
            f" || lpad(CAST((({key}) * 7919) % 10000000 AS STRING), 7, '0'))")


FILE_NAMES = [
    "Techcombank gui tiet kiem quy 3.csv", "Sacombank Priority hoi vien.csv",
    "Biet thu Ecopark cu dan.csv", "Can ho Sunrise City dot 2.csv",
    "CEO giam doc Binh Duong.csv", "Audi Lexus chu xe.csv",
    "Nha dau tu VNDirect chung khoan.csv", "Yoga Fitness hoi vien.csv",
    "TopCV ung vien ke toan.csv", "vinaphone tra truoc HN.csv",
    "mobifone dot 3.csv", "danh sach chua phan loai.csv", "khach cu nhieu nguon.csv",
]
ADDRESSES = ["12 Lê Lợi, Quận 1, TP HCM", "Số 5 Tràng Tiền, Hà Nội", "Nha Trang", "", "  ",
             "Biên Hòa, Đồng Nai", "Quận Hải Châu, Đà Nẵng", "Vinh, Nghệ An", "Thủ Dầu Một, Bình Dương",
             "TP Vũng Tàu", "nan", "Huế"]
KEYWORDS = ["Lịch mở bán đợt hai", "Giữ chỗ căn góc", "Nhà phố ven sông", "Đất vườn giá tốt", "Chung cư gần ga", ""]
PHRASES = [
    "Tôi muốn đặt cọc căn này", "Giá căn 2 phòng bao nhiêu?",
    "Cuối tuần này đến xem dự án được không", "Ngân sách tầm 4 - 5 tỷ",
    "Sổ hồng và pháp lý thế nào", "Diện tích, tiện ích, vị trí ra sao",
    "Đắt quá, để suy nghĩ thêm", "Số của em 0912345678", "Mail của em là a.b@mail.vn",
    "Không quan tâm nữa", "Hỗ trợ vay ngân hàng lãi suất bao nhiêu", "", "Gửi thông tin dự án nhé", "",
]
TIER_NAMES = ["WINNER", "SCALING", "STABLE", "DECLINING", "POOR", "TESTING"]

_ok, _ck, _b = "o_orderkey", "o_custkey", "b"

VIEWS = {
    "v_raw_contacts": f"""
SELECT {_ok} AS row_id,
       {_pick(_ok + ' % 13', FILE_NAMES)} AS file_name,
       {_ok} AS pos,
       CASE WHEN {_ok} % 23 = 0 THEN 'nan' WHEN {_ok} % 19 = 0 THEN ''
            WHEN {_ok} % 4 = 0 THEN 'nguyễn  văn an ' || CAST({_ck} AS STRING)
            WHEN {_ok} % 4 = 1 THEN 'TRẦN THỊ ' || upper(c_name)
            ELSE c_name END AS raw_name,
       CASE WHEN {_ok} % 29 = 0 THEN NULL WHEN {_ok} % 31 = 0 THEN '' WHEN {_ok} % 37 = 0 THEN 'nan'
            ELSE {_pick('fmt', ['0', '84', '+84', '0', '0', '', '', '0', '0', ''])} || substr(b, 2, 2)
                 || {_pick('fmt', ['', '', '', ' ', '-', '', '', '..', '.', '.'])} || substr(b, 4, 7)
                 || {_pick('fmt', ['', '', '', '', ' ', '', '.0', '', '', 'E+07'])} END AS raw_phone,
       CASE WHEN {_ok} % 17 = 0 THEN 'not an address'
            WHEN {_ck} % 5 < 2 AND {_ok} % 3 = 0 THEN ' USER' || CAST({_ck} AS STRING) || '@Mail.Example.com'
            WHEN {_ck} % 5 < 2 THEN 'user' || CAST({_ck} AS STRING) || '@mail.example.com'
            WHEN {_ok} % 11 = 0 THEN 'nan' ELSE '' END AS raw_email,
       {_pick('(n_nationkey + ' + _ok + ' % 2) % 12', ADDRESSES)} AS raw_address,
       CASE WHEN {_ok} % 6 = 0 THEN 'Zalo ads' WHEN {_ok} % 6 = 1 THEN 'facebook' ELSE '' END AS raw_source,
       CASE WHEN {_ok} % 10 = 0 THEN 'Spring' ELSE '' END AS raw_campaign,
       CASE WHEN {_ok} % 7 = 0 THEN 'Quan tâm biệt thự' WHEN {_ok} % 7 = 1 THEN 'cần tư vấn vay'
            WHEN {_ok} % 7 = 2 THEN 'hỏi qua zalo' ELSE '' END AS raw_note,
       CASE WHEN {_ck} % 3 = 0 THEN '1000' || lpad(CAST({_ck} AS STRING), 11, '0') ELSE 'nan' END AS raw_uid,
       CASE WHEN {_ck} % 3 = 0 AND {_ok} % 2 = 0
            THEN 'https://facebook.com/1000' || lpad(CAST({_ck} AS STRING), 11, '0') ELSE '' END AS raw_link,
       CAST(o_orderdate AS DATE) AS file_date
FROM (SELECT o_orderkey, o_custkey, o_orderdate, c_name, n_nationkey, {_phone('o_custkey')} AS b,
             CASE WHEN o_orderkey % 41 = 0 THEN 9 WHEN o_orderkey % 43 = 0 THEN 8 ELSE o_orderkey % 8 END AS fmt
      FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
      JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey) t""",

    # listing of the folder the contact rows come from; it may name files without rows
    "v_contact_files": f"SELECT DISTINCT {_pick(_ok + ' % 13', FILE_NAMES)} AS file_name FROM {{orders}}",

    "v_interactions": f"""
SELECT event_id,
       CASE WHEN event_id % 53 = 0 THEN '' ELSE '1000' || lpad(CAST(user_id AS STRING), 11, '0') END AS uid,
       CASE WHEN event_type = 'purchase' THEN 'comment' WHEN event_type = 'signup' THEN 'tag'
            WHEN event_type = 'click' THEN 'share' WHEN event_type = 'view' THEN 'like'
            ELSE 'other' END AS behavior,
       {_pick('event_id % 6', KEYWORDS)} AS keyword,
       'https://facebook.com/groups/' || CAST(event_id % 50 AS STRING) AS source_url,
       CAST(ts AS TIMESTAMP) AS ts
FROM {{events}}""",

    "v_listings": f"""
SELECT event_id AS id,
       '+84' || substr({_phone('CASE WHEN event_id % 4 = 0 THEN user_id + 1000003 ELSE user_id END')}, 2, 9) AS phone,
       'https://www.' || {_pick('event_id % 9', D.LISTING_DOMAINS + ['example.org', 'm.example.com'])}
           || '/tin/' || CAST(event_id % 400 AS STRING) AS source_url,
       {_pick('event_id % 6', KEYWORDS)} AS keyword,
       CAST(ts AS TIMESTAMP) AS scraped_at
FROM {{events}}""",

    "v_valid_listings": "SELECT * FROM {v_listings} WHERE substr(phone, 4, 1) <> '2'",

    "v_messages": f"""
SELECT conv_id, turn AS idx,
       CASE WHEN role = 'user' THEN 'customer' ELSE 'agent' END AS sender,
       text || ' ' || {_pick('(conv_id * 3 + turn) % 14', PHRASES)} AS text,
       CASE WHEN (conv_id + turn) % 6 = 5 THEN ''
            WHEN conv_id % 3 = 0 THEN '05/01 ' || hh || ':' || mm
            WHEN conv_id % 3 = 1 THEN '2024-01-05T' || hh || ':' || mm || ':00'
            ELSE hh || ':' || mm END AS ts_text
FROM (SELECT *,
             lpad(CAST(CAST(floor(minute_of_day / 60) AS BIGINT) AS STRING), 2, '0') AS hh,
             lpad(CAST(minute_of_day % 60 AS STRING), 2, '0') AS mm
      FROM (SELECT *, 480 + conv_id % 50 + turn * (1 + (conv_id % 7) * 13) AS minute_of_day
            FROM {{conversations}} WHERE role <> 'system') t1) t2""",

    "v_campaigns": f"""
SELECT 'c' || CAST(s.s_suppkey AS STRING) AS campaign_id, s.s_name AS campaign_name,
       s.s_suppkey AS list_order,
       CASE WHEN n.n_nationkey % 8 = 0 THEN 'acc_agent_' ELSE 'acc_' END || n.n_name AS account_id,
       r.r_name AS bm_id, 'p' || CAST(s.s_suppkey % 11 AS STRING) AS page_id,
       {_pick('s.s_suppkey % 6', TIER_NAMES)} AS tier,
       CASE WHEN s.s_suppkey % 10 = 0 THEN 'DELETED' WHEN s.s_suppkey % 10 < 3 THEN 'PAUSED'
            ELSE 'ACTIVE' END AS status,
       CASE WHEN s.s_suppkey % 2 = 0 THEN 'LEAD_GENERATION' ELSE 'MESSAGES' END AS objective,
       {_pick('s.s_suppkey % 29', list(D.CONTENT_TYPES) + ['mystery'])} AS content_type,
       200000 + (s.s_suppkey % 7) * 100000 AS daily_budget
FROM {{supplier}} s JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey""",

    "v_adsets": """
SELECT 'c' || CAST(l_suppkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS adset_id,
       'Adset ' || CAST(l_suppkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS adset_name,
       'c' || CAST(l_suppkey AS STRING) AS campaign_id, CAST(l_linenumber AS BIGINT) AS list_order,
       CASE WHEN (l_suppkey + l_linenumber) % 9 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status,
       100000 + ((l_suppkey * 31 + l_linenumber * 7) % 9) * 50000 AS daily_budget
FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM {lineitem}) t""",

    "v_ads": """
SELECT 'c' || CAST(l_suppkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(k AS STRING) AS ad_id,
       'c' || CAST(l_suppkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS adset_id
FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey % 3 AS k FROM {lineitem}) t""",

    "v_insights": """
SELECT campaign_id, adset_id, ad_id, account_id, bm_id, page_id, tier, content_type, date_start,
       impressions, clicks, leads, spend, frequency,
       CAST(floor(impressions / frequency) AS BIGINT) AS reach,
       floor(clicks * 1e6 / impressions) / 1e4 AS ctr,
       floor(CAST(spend AS DOUBLE) * 1e7 / impressions) / 1e4 AS cpm,
       CASE WHEN clicks > 0 THEN floor(CAST(spend AS DOUBLE) * 1e4 / clicks) / 1e4 ELSE 0e0 END AS cpc
FROM (SELECT 'c' || CAST(l.l_suppkey AS STRING) AS campaign_id,
             'c' || CAST(l.l_suppkey AS STRING) || '_' || CAST(l.l_linenumber AS STRING) AS adset_id,
             'c' || CAST(l.l_suppkey AS STRING) || '_' || CAST(l.l_linenumber AS STRING)
                 || '_' || CAST(l.l_partkey % 3 AS STRING) AS ad_id,
             c.account_id, c.bm_id, c.page_id, c.tier, c.content_type,
             CAST(l.l_shipdate AS DATE) AS date_start,
             CAST(l.l_quantity * 1000 AS BIGINT) AS impressions,
             CAST(floor(l.l_quantity * 1000 * (2e-3 + 8e-3 * (l.l_suppkey % 5) + 5e-2 * l.l_discount)) AS BIGINT) AS clicks,
             CAST(floor(l.l_quantity / 10) AS BIGINT) AS leads,
             CAST(l.l_extendedprice * (2 + 4 * (l.l_suppkey % 7)) AS DECIMAL(18,2)) AS spend,
             floor((1e0 + 25 * l.l_tax * (1 + l.l_suppkey % 4)) * 1e4 + 5e-1) / 1e4 AS frequency
      FROM {lineitem} l JOIN {v_campaigns} c
        ON c.list_order = l.l_suppkey) t""",

    "v_chat_leads": f"""
SELECT 'm_' || CAST(c_custkey AS STRING) AS conversation_id, c_custkey AS lead_no,
       'p' || CAST(c_custkey % 11 AS STRING) AS page_id,
       'c' || CAST(c_custkey % 100 AS STRING) || '_' || CAST(1 + c_custkey % 7 AS STRING)
           || '_' || CAST(c_custkey % 3 AS STRING) AS fb_ad_id,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS sender_name,
       CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE {_phone('c_custkey')} END AS phone,
       CASE WHEN c_custkey % 3 = 0 THEN 'user' || CAST(c_custkey AS STRING) || '@mail.example.com' END AS email,
       c_custkey % 13 AS message_count,
       ((c_custkey * 37) % 101) / 1e1 AS intent_score,
       ((c_custkey * 53) % 101) / 1e1 AS quality_score,
       {_pick('c_custkey % 6', TIER_NAMES)} AS tier
FROM {{customer}}""",

    "v_search_results": f"""
SELECT page_id, url AS page_url,
       'https://www.' || {_pick('page_id % 9', D.LISTING_DOMAINS + ['example.org', 'm.example.com'])}
           || '/tin/' || CAST(page_id AS STRING) AS link,
       'Bán nhà ' || CAST(page_id AS STRING) AS title,
       {_pick('page_id % 3', ['Liên hệ 0', 'Gọi 84x', 'Zalo +84 '])} || substr(b0, 2, 3) || '-'
           || substr(b0, 5, 3) || ' ' || substr(b0, 8, 3) || ' - 0' || substr(b7, 2, 9) AS snippet,
       {_pick('page_id % 6', KEYWORDS)} AS keyword,
       html || '<p>Hotline: ' || b3 || '</p><a class="x" href="tel:+84'
           || substr(b5, 2, 9) || '">call</a><footer>0912345678</footer>' AS html
FROM (SELECT page_id, url, html, {_phone('page_id')} AS b0, {_phone('page_id + 7')} AS b7,
             {_phone('page_id + 3')} AS b3, {_phone('page_id + 5')} AS b5
      FROM {{pages}}) t""",
}

_REF = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view as DataFrame."""
    if name in BASE:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name in FACTS else table
    sql = VIEWS[name]
    return spark.sql(sql, **{ref: load(spark, sf_dir, ref) for ref in set(_REF.findall(sql))})
