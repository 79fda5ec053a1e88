"""Queries over sources and sinks: files are written from the views and read back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import text as T
from leadloom.operators import ads as A
from leadloom.operators import cluster as C
from leadloom.operators import reports as R
from leadloom.operators import resolve as RS
from leadloom.plans import ads as PA
from leadloom.plans import contacts as PC
from leadloom.plans import duck as O
from leadloom.plans import reports as RP
from leadloom.plans.registry import cte, query
from leadloom.plans.views import load
from leadloom.session import new_dir, staged
from leadloom.sources import contact_files as CF
from leadloom.sources import feeds as FD
from leadloom.sources import sinks as SK
from leadloom.store import ContactStore

c = F.col
ROWS_PER_FILE = 2000
# Headers of the seven test layouts; the data columns follow them.
_HEADERS = [
    ("Họ Tên,Số ĐT,Email,Địa Chỉ,Nguồn,Ghi Chú", True), ("khách hàng,sđt,email,địa chỉ,nguồn,note", False), ("Full Name,Phone,Email,Address,Source,Note", True),
    ("KHÁCH HÀNG,ĐIỆN THOẠI,EMAIL,ĐỊA CHỈ,NGUỒN,GHI CHÚ", False), ("họ và tên,số điện thoại,email,location,nguồn,note", True), ("customer name,mobile,email,location,origin,comment", False),
    ("Tên,SĐT,Email,địa chỉ,nguồn khách,nội dung", True),
]
cte("o_file_rows", f"SELECT *, row_id % 7 AS layout, 'layout_' || (row_id % 7) || '_' || CAST(row_id // {ROWS_PER_FILE * 7} AS VARCHAR) AS file_key FROM {{v_raw_contacts}}")


def contact_files(spark, sf):
    """Writes the raw contacts as CSV files of seven layouts, some with title lines."""
    key = c("row_id")
    rows = PC.raw(spark, sf).withColumn("layout", key % 7).withColumn(
        "file_key", F.concat(F.lit("layout_"), key % 7, F.lit("_"), F.floor(key / (ROWS_PER_FILE * 7))))
    body = rows.select("file_key", F.lit(9).alias("part"), "row_id", F.concat_ws(",", *[
        F.concat(F.lit('"'), F.coalesce(x, F.lit("")), F.lit('"')) for x in ("raw_name", "raw_phone", "raw_email", "raw_address", "raw_source", "raw_note")]).alias("line"))
    heads = [F.struct(F.lit(i).alias("layout"), F.lit(p).alias("part"), F.lit(text).alias("line"))
             for i, (header, titled) in enumerate(_HEADERS)
             for p, text in ([(0, "DANH SACH 2024,,,,,")] if titled else []) + [(1, header)]]
    top = (rows.select("file_key", "layout").distinct().withColumn("h", F.explode(F.array(*heads)))
           .filter("h.layout = layout").select("file_key", "h.part", F.lit(0).cast("bigint").alias("row_id"), "h.line"))
    path = new_dir(spark, "contact-files")
    (top.unionByName(body).repartition("file_key").sortWithinPartitions("file_key", "part", "row_id")
     .select("file_key", "line").write.partitionBy("file_key").option("compression", "none").text(path))
    return path


def _key_of(file):
    return F.regexp_extract(file, "file_key=([^/]+)/", 1)


@query("src1_file_listing", """
SELECT file_key, count(*) AS files FROM (SELECT DISTINCT file_key FROM {o_file_rows}) t GROUP BY 1""")
def src1_file_listing(spark, sf):
    listed = CF.file_listing(spark, contact_files(spark, sf))
    return listed.groupBy(_key_of(c("path")).alias("file_key")).agg(F.count("*").alias("files"))


_CELL = "nullif({0}, '')"


@query("src2_contact_csv", f"""
SELECT file_key, {O.filled('raw_name')} AS raw_name, {O.filled('raw_phone')} AS phone_text, nullif(trim(raw_email), '') AS email_text, nullif(trim(raw_address), '') AS address_text,
       nullif(raw_source, '') AS raw_source, nullif(raw_note, '') AS raw_note FROM {{o_file_rows}}""")
def src2_contact_csv(spark, sf):
    rows = CF.read_contact_csv(spark, contact_files(spark, sf))

    def text(name):
        return F.nullif(F.trim(F.col(name)), F.lit(""))

    return rows.select(_key_of(c("file")).alias("file_key"), "raw_name", T.blank_to_null(c("raw_phone")).alias("phone_text"), text("raw_email").alias("email_text"),
                       text("raw_address").alias("address_text"), text("raw_source").alias("raw_source"), text("raw_note").alias("raw_note"))


@query("map1_column_mapping", """
SELECT DISTINCT file_key, 0 AS i_name, 1 AS i_phone, 2 AS i_email, 3 AS i_address, 4 AS i_source, 5 AS i_note FROM {o_file_rows}""")
def map1_column_mapping(spark, sf):
    lines = CF.read_lines(spark, contact_files(spark, sf))
    mapped = CF.map_columns(CF.detect_headers(lines))
    return mapped.select(_key_of(c("file")).alias("file_key"), "i_name", "i_phone", "i_email", "i_address", "i_source", "i_note")


@query("map2_identity_columns", """
SELECT DISTINCT file_key, CAST(NULL AS INTEGER) AS i_uid, CASE WHEN layout IN (0, 2, 4, 5, 6) THEN 0 END AS i_name,
       CASE WHEN layout IN (1, 2, 4, 5, 6) THEN 1 END AS i_phone FROM {o_file_rows}""")
def map2_identity_columns(spark, sf):
    lines = CF.read_lines(spark, contact_files(spark, sf))
    return CF.identity_columns(CF.detect_headers(lines)).select(_key_of(c("file")).alias("file_key"), "i_uid", "i_name", "i_phone")


@query("src3_encoding_fallback", "SELECT doc_id, text FROM {documents}")
def src3_encoding_fallback(spark, sf):
    """Texts encoded in four ways come back whole."""
    docs, k = load(spark, sf, "documents"), c("doc_id") % 4
    bytes_ = (F.when(k == 0, F.encode("text", "UTF-16")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
              .when((k == 2) & c("text").rlike(r"^[\x00-\xFF]*$"), F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", ""), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")))
    return docs.select("doc_id", bytes_.alias("content")).select("doc_id", CF.decode_content(c("content")).alias("text"))


@query("src4_phone_list_txt", "SELECT trim(raw_phone) AS raw_phone, count(*) AS lines FROM {v_raw_contacts} WHERE trim(raw_phone) <> '' GROUP BY 1")
def src4_phone_list_txt(spark, sf):
    path = new_dir(spark, "phones")
    PC.raw(spark, sf).select(F.concat(F.lit(" "), F.coalesce("raw_phone", F.lit("")))).write.option("compression", "none").text(path)
    return CF.read_phone_list(spark, path).groupBy("raw_phone").agg(F.count("*").alias("lines"))


cte("o_social_line", """
SELECT row_id, file_name, CASE WHEN raw_uid = 'nan' THEN '123456789' ELSE raw_uid END AS u, e164, email, regexp_replace(trim(name), '\\s+', ' ', 'g') AS n FROM {o_clean}""")


@query("src5_social_txt", """
SELECT uid, phone, email, name, CASE WHEN uid <> '' THEN 'https://facebook.com/' || uid ELSE '' END AS link, count(*) AS lines
FROM (SELECT u AS uid, coalesce(e164, '') AS phone, coalesce(email, '') AS email, array_to_string(list_filter(string_split(n, ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$'))[1:3], ' ') AS name FROM {o_social_line}) t GROUP BY ALL""")
def src5_social_txt(spark, sf):
    rows = RS.clean(PC.raw(spark, sf))
    uid = F.when(c("raw_uid") == "nan", "123456789").otherwise(c("raw_uid"))
    line = F.concat_ws(" ", uid, "name", F.lit("vi_VN"), "e164", "email", F.lit("https://facebook.com/x"))
    path = new_dir(spark, "social")
    rows.select(line).write.option("compression", "none").text(path)
    return CF.read_social_txt(spark, path).groupBy("uid", "phone", "email", "name", "link").agg(F.count("*").alias("lines"))


@query("src6_binary_phone_scan", """
SELECT doc_id, phone, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT doc_id, unnest(p) AS phone, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text || ' 0' || lpad(CAST((doc_id * 7919) % 1000000000 AS VARCHAR), 9, '0') || 'x+84912345678', '((?:0|\\+84)[0-9]{8,10})', 1) AS p FROM {documents}) t) u""")
def src6_binary_phone_scan(spark, sf):
    tail = F.concat(F.lit(" 0"), F.lpad(((c("doc_id") * 7919) % 1000000000).cast("string"), 9, "0"), F.lit("x+84912345678"))
    docs = load(spark, sf, "documents").select("doc_id", F.concat("text", tail).cast("binary").alias("content"))
    return CF.phones_in_content(docs, "doc_id")


@query("src6_document_files", """
SELECT part, phone AS raw_phone, count(*) AS places FROM (SELECT doc_id % 16 AS part,
  unnest(regexp_extract_all(text || ' 0' || lpad(CAST((doc_id * 7919) % 1000000000 AS VARCHAR), 9, '0') || 'x+84912345678', '((?:0|\\+84)[0-9]{8,10})', 1)) AS phone
  FROM {documents}) t GROUP BY ALL""")
def src6_document_files(spark, sf):
    """The documents as files of many lines, written and scanned in splits."""
    tail = F.concat(F.lit(" 0"), F.lpad(((c("doc_id") * 7919) % 1000000000).cast("string"), 9, "0"), F.lit("x+84912345678"))
    path = new_dir(spark, "documents")
    load(spark, sf, "documents").select((c("doc_id") % 16).alias("part"), F.concat("text", tail).alias("value")).filter(
        "value IS NOT NULL").write.partitionBy("part").text(path)
    found = CF.read_documents(spark, path)
    part = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long")
    return found.groupBy(part.alias("part"), "raw_phone").agg(F.count("*").alias("places"))


@query("src7_interaction_csv", """
SELECT uid, source_url, behavior, keyword, count(*) AS rows FROM (SELECT uid, source_url, CASE WHEN behavior = 'like' AND event_id % 2 = 0 THEN 'like' ELSE behavior END AS behavior, keyword
FROM {v_interactions} WHERE uid <> '') t GROUP BY ALL""")
def src7_interaction_csv(spark, sf):
    path = new_dir(spark, "interactions")
    even = c("event_id") % 2 == 0
    load(spark, sf, "v_interactions").select(
        F.when(even, c("uid")).alias("uid"), F.when(~even, c("uid")).alias("facebook_uid"), F.when(even, c("source_url")).alias("post_url"), c("source_url").alias("url"),
        F.when((c("behavior") == "like") & even, None).otherwise(F.upper("behavior")).alias("behavior"), "keyword", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    ).write.option("header", "true").csv(path)
    return FD.read_interaction_csv(spark, path).groupBy("uid", "source_url", "behavior", "keyword").agg(F.count("*").alias("rows"))


@query("src8_insights_json", f"""
SELECT adset_id, date_start, CAST(sum(leads) AS BIGINT) AS leads, CAST(sum(clicks) AS BIGINT) AS clicks, CAST({O.esum('spend')} AS DOUBLE) AS spend FROM {{v_insights}} GROUP BY 1, 2""")
def src8_insights_json(spark, sf):
    path = new_dir(spark, "insights")
    rows, by_field = PA.insights(spark, sf), c("impressions") % 3000 == 0
    actions = F.array(F.struct(F.lit("link_click").alias("action_type"), c("clicks").alias("value")),
                      F.struct(F.lit("lead").alias("action_type"), c("leads").alias("value")))
    rows.select("campaign_id", "adset_id", "ad_id", c("date_start").cast("string").alias("date_start"), "impressions", "clicks", c("spend").cast("double").alias("spend"),
                "ctr", "reach", F.when(by_field, c("leads")).alias("leads"), F.when(~by_field, actions).alias("actions")).write.option(
        "compression", "gzip").option("maxRecordsPerFile", 500_000).json(path)  # a compressed file is read by one task
    landed = FD.read_insights_json(spark, path)
    return landed.groupBy("adset_id", "date_start").agg(F.sum("leads").alias("leads"), F.sum("clicks").alias("clicks"),
                                                        F.sum(c("spend").cast("decimal(28,6)")).cast("double").alias("spend"))


@query("src11_lead_forms", "SELECT conversation_id AS submission_id, fb_ad_id, sender_name AS name, coalesce(phone, '') AS phone, coalesce(email, '') AS email FROM {v_chat_leads}")
def src11_lead_forms(spark, sf):
    path = new_dir(spark, "forms")
    even = c("lead_no") % 2 == 0

    def field(name, value):
        return F.struct(name.alias("name"), F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value)).alias("values"))

    load(spark, sf, "v_chat_leads").select(
        c("conversation_id").alias("id"), c("fb_ad_id").alias("ad_id"), F.array(
            field(F.when(even, "full_name").otherwise("name"), c("sender_name")), field(F.when(even, "phone").otherwise("phone_number"), c("phone")),
            field(F.lit("email"), c("email"))).alias("field_data")).write.json(path)
    return FD.read_lead_forms(spark, path).select("submission_id", "fb_ad_id", "name", "phone", "email")


@query("src12_conversations_json", "SELECT 'm_' || conv_id AS conversation_id, idx, sender, text FROM {v_messages}")
def src12_conversations_json(spark, sf):
    """Landed pages of at most 50 messages per record."""
    path = new_dir(spark, "conversations")
    rows = load(spark, sf, "v_messages").select(F.concat(F.lit("m_"), "conv_id").alias("id"), F.floor(c("idx") / 50).alias("page"),
                                                F.struct("idx", "sender", c("text").alias("message"), c("ts_text").alias("created_time")).alias("m"))
    rows.groupBy("id", "page").agg(F.collect_list("m").alias("messages")).withColumn("thread_key", F.concat(F.lit("t_"), "id")).drop("page").write.json(path)
    return FD.read_conversations(spark, path).select("conversation_id", "idx", "sender", "text")


@query("src13_search_results", "SELECT title, link, snippet, keyword, length(html) AS html_length FROM {v_search_results}")
def src13_search_results(spark, sf):
    path = new_dir(spark, "search")
    load(spark, sf, "v_search_results").select("title", "link", "snippet", "keyword", "html").write.json(path)
    return FD.read_search_results(spark, path).select("title", "link", "snippet", "keyword", F.length("html").cast("bigint").alias("html_length"))


@query("src14_table_scan", "SELECT lead_key, unified_score, source_tier, source_weight, CAST(source_count AS BIGINT) AS source_count, uid <> '' AS has_uid FROM {o_scored}")
def src14_table_scan(spark, sf):
    path = new_dir(spark, "contacts")
    PC.scored(spark, sf).write.parquet(path)
    return spark.read.parquet(path).select("lead_key", "unified_score", "source_tier", "source_weight", "source_count", (c("uid") != "").alias("has_uid"))


@query("src15_profile_payload", """
SELECT k.profile_key, CASE WHEN p.uid IS NULL THEN k.name ELSE 'Name ' || p.last END AS name, p.uid IS NOT NULL AS synced, 'City ' || (p.last % 7) AS city
FROM {o_known} k LEFT JOIN (SELECT uid, max(event_id) AS last FROM {v_interactions} WHERE uid <> '' GROUP BY uid) p ON p.uid = k.uid""")
def src15_profile_payload(spark, sf):
    path = new_dir(spark, "payloads")
    load(spark, sf, "v_interactions").filter("uid <> ''").select(
        c("uid").alias("fb_uid"), c("event_id").alias("synced_at"), F.struct(F.concat(F.lit("Name "), "event_id").alias("name"), F.concat(F.lit("City "), c("event_id") % 7).alias("city")).alias("profile_data"),
        F.array("keyword").alias("messages")).write.json(path)
    known = RP.E.profiles_of(PC.contacts(spark, sf)).withColumn("note", F.lit('{"old":"1","extension_profile":"stale"}'))
    merged = FD.merge_profile_payloads(known, spark.read.schema(FD.PROFILE_SCHEMA).json(path))
    city = F.get_json_object(F.get_json_object("note", "$.extension_profile"), "$.city")
    return merged.select("profile_key", "name", "synced", F.when(c("synced"), city).alias("city"))


# --- sinks -----------------------------------------------------------------
_LEAD_COLS = ["name", "phone", "email", "address", "province", "source", "campaign", "note", "file_origin"]


def leads(spark, sf):
    return RS.new_leads(RS.mark_status(PC.keyed(spark, sf)))


cte("o_new_leads", f"""
SELECT name, phone, email, address, {O.province('address', 'file_name')} AS province,
       coalesce({O.filled('raw_source')}, {O.source("concat_ws(' ', raw_name, raw_email, raw_address, raw_note, raw_link, file_name)")}) AS source,
       raw_campaign AS campaign, raw_note AS note, file_name AS file_origin FROM {{o_marked}} WHERE status = 'valid'""")


def _nulls(cols):
    return ", ".join(f"nullif({x}, '') AS {x}" for x in cols)


@query("snk1_json_export", f"SELECT {', '.join(_LEAD_COLS)} FROM {{o_new_leads}}")
def snk1_json_export(spark, sf):
    path = new_dir(spark, "json")
    SK.json_export(leads(spark, sf).select(*_LEAD_COLS), path)
    return spark.read.schema(", ".join(f"{x} STRING" for x in _LEAD_COLS)).json(path)


@query("snk2_lead_export", f"SELECT {_nulls(_LEAD_COLS)} FROM {{o_new_leads}}")
def snk2_lead_export(spark, sf):
    path = new_dir(spark, "leads")
    SK.lead_export(leads(spark, sf), path)
    return spark.read.option("header", "true").csv(path)


cte("o_rejects", f"""
SELECT raw_name, raw_phone, file_name AS file_origin, CASE status WHEN 'missing_contact' THEN {O.lit(D.REASON_MISSING)} WHEN 'invalid_phone' THEN {O.lit(D.REASON_INVALID_PHONE)} || raw_phone ELSE {O.lit(D.REASON_DUPLICATE)} END AS reason
FROM {{o_marked}} WHERE status <> 'valid'""")


@query("snk3_rejects_export", "SELECT raw_name, raw_phone, file_origin, reason, run FROM {o_rejects}, (VALUES ('run1'), ('run2')) v(run)")
def snk3_rejects_export(spark, sf):
    path = new_dir(spark, "rejects")
    rows = RS.rejects(RS.mark_status(PC.keyed(spark, sf)))
    for run in ("run1", "run2"):
        SK.rejects_export(rows, path, run)
    return spark.read.parquet(path).select("raw_name", "raw_phone", "file_origin", "reason", c("run_ts").alias("run"))


cte("o_reconciled", """
SELECT file_name, uid, name, phone, CASE WHEN phone IS NULL THEN 'no_phone' WHEN name IS NULL THEN 'no_name' ELSE 'mapped' END AS status
FROM (SELECT file_name, uid, arg_max(name, rn) FILTER (WHERE name <> '') AS name, arg_max(phone, rn) FILTER (WHERE phone IS NOT NULL) AS phone FROM {o_identity} WHERE uid IS NOT NULL GROUP BY 1, 2) t
WHERE name IS NOT NULL OR phone IS NOT NULL""")


@query("snk4_identity_export", "SELECT status, file_name, uid, name, phone FROM {o_reconciled} UNION ALL SELECT 'bridge', 'identity_bridge', uid, name, phone FROM {o_reconciled} WHERE status = 'mapped'")
def snk4_identity_export(spark, sf):
    path = new_dir(spark, "identity")
    SK.identity_export(RS.reconcile(PC.identity_rows(spark, sf)), path)
    back = spark.read.parquet(path)
    bridge = SK.bridge_rows(back).select(F.lit("bridge").alias("status"), "file_name", c("raw_uid").alias("uid"), c("raw_name").alias("name"), c("raw_phone").alias("phone"))
    return back.select("status", "file_name", "uid", "name", "phone").unionByName(bridge)


cte("o_audience", """
SELECT nullif(email, '') AS email, nullif(regexp_replace(coalesce(phone, ''), '^0', '84'), '') AS phone, nullif(words[-1], '') AS fn,
       nullif(CASE WHEN len(words) > 1 THEN array_to_string(words[1:len(words) - 1], ' ') ELSE '' END, '') AS ln,
       nullif(CASE WHEN province = 'Unknown' THEN '' ELSE replace(province, 'TP. ', '') END, '') AS ct, CASE WHEN phone <> '' THEN 'VN' END AS country,
       CAST(score AS VARCHAR) AS score, file_source AS source_file
FROM (SELECT *, string_split(trim(name), ' ') AS words FROM {o_scored} WHERE score >= 8) t""")


@query("snk5_audience_export", "SELECT * FROM {o_audience}")
def snk5_audience_export(spark, sf):
    path = new_dir(spark, "audience")
    SK.audience_export(PC.scored(spark, sf).filter("score >= 8"), path)
    return spark.read.option("header", "true").csv(path)


@query("snk6_sales_list", "SELECT CAST(score AS VARCHAR) AS score, nullif(name, '') AS name, phone, nullif(email, '') AS email, province, nullif(address, '') AS address, file_source AS file_origin FROM {o_scored} WHERE score >= 8")
def snk6_sales_list(spark, sf):
    path = new_dir(spark, "sales")
    SK.sales_list(PC.scored(spark, sf).filter("score >= 8")).write.option("header", "true").csv(path)
    return spark.read.option("header", "true").csv(path)


@query("snk7_priority_sheets", """
SELECT profile_key, lead_score, s AS sheet FROM {o_leads}, (VALUES ('all'), ('vip'), ('social'), ('search')) v(s)
WHERE s = 'all' OR (s = 'vip' AND lead_score >= 8) OR (s = 'social' AND fb_score > 0) OR (s = 'search' AND search_score > 0)""")
def snk7_priority_sheets(spark, sf):
    path = new_dir(spark, "sheets")
    SK.priority_sheets(RP.leads(spark, sf), path)
    back = spark.read.option("header", "true").csv(path)
    return back.select("profile_key", c("lead_score").cast("double").alias("lead_score"), "sheet")


@query("snk8_contact_upsert", """
SELECT lead_key, phone, email, name, uid, source_tier, source_weight, CAST(source_count AS BIGINT) AS source_count, latest_file_date FROM {o_golden}""")
def snk8_contact_upsert(spark, sf):
    """Two halves by file order, the second merged into the buckets of the stored first that it touches: the same as all at once."""
    rows = staged(PC.keyed(spark, sf), "keyed")
    store, base = ContactStore(spark, new_dir(spark, "contacts"), 32), None
    for version, part in (("1", rows.filter("file_name < 'K'")), ("2", rows.filter("file_name >= 'K'"))):
        store.merge(staged(RS.golden(part), "golden"), staged(RS.golden_files(part), "files"), version, base)
        base = version
    return store.contacts().select("lead_key", "phone", "email", "name", "uid", "source_tier", "source_weight", "source_count", "latest_file_date")


@query("snk9_cluster_writeback", "SELECT lead_key, CAST(CASE WHEN unified_score >= 40 THEN source_count % 4 ELSE 0 END AS BIGINT) AS cluster, CASE WHEN unified_score >= 40 THEN 'new' ELSE 'old' END AS persona FROM {o_scored}")
def snk9_cluster_writeback(spark, sf):
    scored = PC.scored(spark, sf)
    stored = scored.select("lead_key", F.lit(0).cast("bigint").alias("cluster"), F.lit("old").alias("persona"))
    fresh = scored.filter("unified_score >= 40").select("lead_key", (c("source_count") % 4).alias("cluster"), F.lit("new").alias("persona"))
    path = new_dir(spark, "clusters")
    SK.cluster_writeback(stored, fresh).write.parquet(path)
    return spark.read.parquet(path)


@query("join16_cluster_update", "SELECT lead_key, CAST(source_count % 4 AS BIGINT) AS cluster FROM {o_scored} WHERE unified_score >= 40")
def join16_cluster_update(spark, sf):
    scored = PC.scored(spark, sf)
    fresh = scored.filter("unified_score >= 40").select("lead_key", (c("source_count") % 4).alias("cluster"))
    return scored.select("lead_key").join(fresh, "lead_key")


@query("win9_latest_snapshot", """
SELECT count(*) AS total_leads, count(*) FILTER (WHERE score >= 8) AS vip_leads, '2024-01-03' AS day FROM {o_scored}""")
def win9_latest_snapshot(spark, sf):
    """Three appended snapshots, the newest one read."""
    scored = PC.scored(spark, sf)
    total = scored.agg(F.count("*").alias("total_leads"), F.count_if(c("score") >= 8).alias("vip_leads"))
    path = new_dir(spark, "snapshots")
    for day in ("2024-01-02", "2024-01-03", "2024-01-01"):
        SK.append(SK.snapshot(total, R.province_counts(scored), day), path)
    return R.latest_snapshot(spark.read.parquet(path)).select("total_leads", "vip_leads", F.date_format("snapshot_time", "yyyy-MM-dd").alias("day"))


@query("snk10_snapshot_latest", """
SELECT d AS day, count(*) AS total_leads, d = '2024-01-02' AS is_latest FROM {o_scored}, (VALUES ('2024-01-01'), ('2024-01-02')) v(d) GROUP BY d""")
def snk10_snapshot_latest(spark, sf):
    scored = PC.scored(spark, sf)
    total = scored.agg(F.count("*").alias("total_leads"))
    path = new_dir(spark, "snapshots")
    for day in ("2024-01-01", "2024-01-02"):
        SK.append(SK.snapshot(total, R.province_counts(scored), day), path)
    rows = spark.read.parquet(path)
    newest = F.max("snapshot_time").over(Window.partitionBy(F.lit(1)))  # one row per snapshot
    return rows.select(F.date_format("snapshot_time", "yyyy-MM-dd").alias("day"), "total_leads",
                       (c("snapshot_time") == newest).alias("is_latest"))


cte("o_log", "SELECT run, rule, action, adset_id, new_budget, reason FROM {o_actions}, (VALUES (1), (2)) v(run)")


def _log(spark, sf):
    path = new_dir(spark, "log")
    rows = PA.actions(spark, sf)
    for day in (1, 2):
        SK.append(A.action_log(rows, f"2024-01-0{day}"), path)
    return spark.read.parquet(path)


@query("snk11_action_log", "SELECT run, rule, action, adset_id, new_budget, reason FROM {o_log}")
def snk11_action_log(spark, sf):
    return _log(spark, sf).select(F.dayofmonth("run_at").alias("run"), "rule", "action", "adset_id",
                                  F.get_json_object("params_json", "$.new_budget").cast("bigint").alias("new_budget"), "reason")


@query("srt4_log_latest", "SELECT run, adset_id, rule FROM {o_log} ORDER BY run DESC, adset_id, rule LIMIT 100")
def srt4_log_latest(spark, sf):
    return (_log(spark, sf).orderBy(F.desc("run_at"), "adset_id", "rule").limit(100)
            .select(F.dayofmonth("run_at").alias("run"), "adset_id", "rule"))


@query("snk12_audit_report", "SELECT file_name, category, size_kb FROM {o_audit}")
def snk12_audit_report(spark, sf):
    path = new_dir(spark, "audit")
    R.audit(RP.files(spark, sf)).write.option("header", "true").csv(path)
    return spark.read.schema("file_name STRING, category STRING, size_kb DOUBLE").option("header", "true").csv(path)


@query("snk13_replace_source", """
SELECT source, seq, hot_score FROM {o_hot} WHERE source = 'google' UNION ALL SELECT source, seq, 0e0 FROM {o_hot} WHERE source = 'facebook'""")
def snk13_replace_source(spark, sf):
    path = new_dir(spark, "hot")
    rows = RP.hot(spark, sf).select("source", "seq", "hot_score")
    SK.replace_source(rows, path)
    SK.replace_source(rows.filter("source = 'facebook'").withColumn("hot_score", F.lit(0.0)), path)
    return spark.read.parquet(path).select("source", "seq", "hot_score")


@query("set1_union_files", "SELECT 'contacts' AS origin, count(*) AS rows, count(raw_email) AS with_email FROM {v_raw_contacts} UNION ALL SELECT 'bridge', count(*), 0 FROM {o_reconciled} WHERE status = 'mapped'")
def set1_union_files(spark, sf):
    """Contact rows and bridge rows of a narrower layout in one frame."""
    bridge = SK.bridge_rows(RS.reconcile(PC.identity_rows(spark, sf)))
    both = PC.raw(spark, sf).unionByName(bridge, allowMissingColumns=True)
    origin = F.when(c("file_name") == "identity_bridge", "bridge").otherwise("contacts")
    return both.groupBy(origin.alias("origin")).agg(F.count("*").alias("rows"), F.count("raw_email").alias("with_email"))


# --- clustering ------------------------------------------------------------
cte("o_features", """
SELECT profile_key, CAST(unified_score AS DOUBLE) AS unified_score,
       CAST(CASE source_tier WHEN 'banking_vip' THEN 8 WHEN 'real_estate_vip' THEN 7 WHEN 'ceo_director' THEN 7 WHEN 'automotive_vip' THEN 5 WHEN 'stock_gold' THEN 5
            WHEN 'fitness_health' THEN 4 WHEN 'education_hr' THEN 3 WHEN 'telecom_mass' THEN 2 ELSE 1 END AS DOUBLE) AS tier_code,
       CAST(least(source_count, 10) AS DOUBLE) AS source_count, CAST(email <> '' AS DOUBLE) AS has_email, CAST(uid <> '' AS DOUBLE) AS has_uid,
       least(fb_score + search_score, 10e0) AS hot_total FROM {o_leads}""")


@query("ml1_feature_matrix", "SELECT * FROM {o_features}")
def ml1_feature_matrix(spark, sf):
    return RP.features(spark, sf)


@query("ml2_impute_scale", "SELECT " + ", ".join(
    f"{O.rnd(f'avg(({x} - m_{x}) / s_{x})', 6)} + 0e0 AS mean_{x}, {O.rnd(f'stddev_samp(({x} - m_{x}) / s_{x})', 6)} AS std_{x}" for x in C.FEATURES)
    + " FROM {o_features}, (SELECT " + ", ".join(f"avg({x}) AS m_{x}, stddev_samp({x}) AS s_{x}" for x in C.FEATURES) + " FROM {o_features}) t")
def ml2_impute_scale(spark, sf):
    features = staged(RP.features(spark, sf), "features")  # read by the medians, the scales and the result
    scaled = C.scaled_values(C.impute_scale(features, C.FEATURES), C.FEATURES)
    z = [(x, c(f"z_{x}")) for x in C.FEATURES]
    return scaled.agg(*[e for x, v in z for e in (
        (F.round(F.avg(v).cast("decimal(38,10)"), 6).cast("double") + F.lit(0.0)).alias(f"mean_{x}"),
        F.round(F.stddev_samp(v).cast("decimal(38,10)"), 6).cast("double").alias(f"std_{x}"))])


@query("ml6_feature_matrix_v3", """
SELECT lead_key, unified_score, CAST(source_weight AS DOUBLE) AS tier_weight, CAST(source_count AS DOUBLE) AS source_count, source_weight,
       CAST(coalesce(k.code, (SELECT code FROM {o_prov_codes} WHERE cat = 'Other')) AS DOUBLE) AS province_code, CAST(uid <> '' AS DOUBLE) AS has_uid
FROM {o_scored} s LEFT JOIN {o_prov_codes} k ON s.province = k.cat""")
def ml6_feature_matrix_v3(spark, sf):
    return C.features_v3(PC.scored(spark, sf), "province")
