"""Queries over contact rows: cleaning, text, resolution, scores and reports."""

from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import dates as DT
from leadloom.functions import numbers as N
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.operators import resolve as R
from leadloom.operators import score as S
from leadloom.operators.common import join_dimension
from leadloom.plans import duck as O
from leadloom.plans.registry import query
from leadloom.plans.views import load

AS_OF = O.CONTACTS_AS_OF


def raw(spark, sf):
    return load(spark, sf, "v_raw_contacts")


def keyed(spark, sf):
    return R.lead_keys(R.clean(raw(spark, sf)))


def contacts(spark, sf):
    return R.golden(keyed(spark, sf), load(spark, sf, "v_contact_files"))  # no contact row is read for the names


def scored(spark, sf):
    return S.rescore(contacts(spark, sf), AS_OF)


def _column(name, oracle_expr, view="v_raw_contacts", key="row_id"):
    """Register one Column function evaluated over every row of a view."""

    def add(make):
        def run(spark, sf):
            return load(spark, sf, view).select(key, make().alias("result"))
        query(name, f"SELECT {key}, {oracle_expr} AS result FROM {{{view}}}")(run)
        return run
    return add


c = F.col
_dial = O.dial("raw_phone", "'[Ee][+-][0-9]+'")
_series = (f"(CASE WHEN regexp_matches({_dial}, '^84[0-9]{{9}}$') THEN '0' || substr({_dial}, 3) "
           f"WHEN regexp_matches({_dial}, '^[3-9][0-9]{{8}}$') THEN '0' || {_dial} ELSE {_dial} END)")
_digits = "regexp_replace(raw_phone, '[^0-9]', '', 'g')"
_loose = f"(CASE WHEN starts_with({_digits}, '84') AND length({_digits}) > 10 THEN '0' || substr({_digits}, 3) ELSE {_digits} END)"
_loose = f"(CASE WHEN length({_loose}) = 9 THEN '0' || {_loose} ELSE {_loose} END)"
_local = f"('0' || substr({O.e164('raw_phone')}, 4))"
_bare = "regexp_replace(trim(coalesce(raw_phone, raw_name)), '[. ]', '', 'g')"
_unplus = f"regexp_replace({_bare}, '^\\+', '')"
_bs = "chr(92)"

_column("cln1_phone_e164", O.e164("raw_phone"))(lambda: P.phone_e164(c("raw_phone")))
_column("cln2_phone_local", _local)(lambda: P.phone_local(c("raw_phone")))
_column("cln3_phone_series", f"CASE WHEN regexp_matches({_series}, '^0[3-9][0-9]{{8}}$') THEN {_series} END")(
    lambda: P.phone_series(c("raw_phone")))
_column("cln4_phone_loose", f"CASE WHEN length({_loose}) >= 10 THEN {_loose} END")(
    lambda: P.phone_loose(c("raw_phone")))
_column("cln5_phone_valid", f"{O.e164('raw_phone')} IS NOT NULL")(lambda: P.phone_valid(c("raw_phone")))
_column("cln6_email_clean", O.email("raw_email"))(lambda: T.email_clean(c("raw_email")))
_column("cln7_name_clean", O.name("raw_name"))(lambda: T.name_clean(c("raw_name")))
_column("cln8_uid_extract", "nullif(regexp_extract(raw_uid || ' ' || raw_link, '([0-9]{9,})', 1), '')")(
    lambda: T.uid_extract(F.concat_ws(" ", "raw_uid", "raw_link")))
_column("cln9_phone_audience", f"regexp_replace(coalesce({_local}, ''), '^0', '84')")(
    lambda: P.phone_audience(P.phone_local(c("raw_phone"))))
_column("cln11_lookup_text",
        f"CASE WHEN regexp_matches({_bare}, '^[0-9]+$') OR starts_with({_bare}, '+') "
        f"THEN {O.with_zero(_unplus)} ELSE {_bare} END")(
    lambda: P.lookup_text(F.coalesce(c("raw_phone"), c("raw_name"))))
_column("map3_name_compose",
        f"coalesce({O.filled('raw_name')}, nullif(trim(concat_ws(' ', {O.filled('raw_note')}, {O.filled('raw_source')})), ''))")(
    lambda: T.name_compose(c("raw_name"), c("raw_source"), c("raw_note")))


@query("txt1_province_text", f"SELECT row_id, {O.province('raw_address', 'file_name')} AS province FROM {{v_raw_contacts}}")
def txt1_province_text(spark, sf):
    return T.with_province(raw(spark, sf), c("raw_address"), c("file_name")).select("row_id", "province")


_column("txt2_province_phone", O.province_phone("raw_phone"))(lambda: P.province_from_phone(c("raw_phone")))
_column("txt3_source_infer", O.source("concat_ws(' ', raw_name, raw_note, raw_source, raw_link, file_name)"))(
    lambda: T.source_from_content(c("raw_name"), c("raw_note"), c("raw_source"), c("raw_link"), c("file_name")))
_column("txt8_keyword_count", O.hits("lower(coalesce(raw_note, ''))", D.INTEREST_WORDS["vip"]))(
    lambda: T.keyword_count(c("raw_note"), D.INTEREST_WORDS["vip"]))
_column("txt12_vip_keyword", O.vip("coalesce(file_name, '') || coalesce(raw_note, '')"))(
    lambda: T.has_vip_word(c("file_name"), c("raw_note")))


@query("cln10_phone_both_keys", f"""
SELECT row_id, CASE WHEN p = '' THEN NULL WHEN starts_with(p, '0') THEN '+84' || substr(p, 2) ELSE p END AS join_key,
       CASE WHEN e IS NULL THEN NULL ELSE e END AS join_key_e164
FROM (SELECT row_id, coalesce(phone, '') AS p, e164 AS e FROM {{o_clean}}) t""")
def cln10_phone_both_keys(spark, sf):
    """0xxx and +84xxx numbers lead to the same join key."""
    rows = R.clean(raw(spark, sf))
    return rows.select("row_id", P.phone_join_key(c("phone")).alias("join_key"),
                       P.phone_join_key(c("e164")).alias("join_key_e164"))


@query("cln12_name_split", """
SELECT row_id, words[-1] AS fn, CASE WHEN len(words) > 1 THEN array_to_string(words[1:len(words) - 1], ' ') ELSE '' END AS ln
FROM (SELECT row_id, string_split(trim(name), ' ') AS words FROM {o_clean}) t""")
def cln12_name_split(spark, sf):
    rows = R.clean(raw(spark, sf))
    return rows.select("row_id", T.name_first(c("name")).alias("fn"), T.name_last(c("name")).alias("ln"))


@query("cln13_record_status", "SELECT row_id, file_name, lead_key, status FROM {o_marked}")
def cln13_record_status(spark, sf):
    return R.mark_status(keyed(spark, sf)).select("row_id", "file_name", "lead_key", "status")


@query("txt4_file_tier", f"""
SELECT row_id, tier, CAST(weight AS DOUBLE) AS weight, label, CAST(n AS INTEGER) AS matched,
       CASE WHEN n = 0 THEN 0e0 ELSE {O.rnd('least(1e0, 0.7e0 + (n - 1) * 0.15e0)', 2)} END AS confidence
FROM {{v_raw_contacts}} JOIN {{o_file_tier}} USING (file_name)""")
def txt4_file_tier(spark, sf):
    rows = raw(spark, sf)
    tiers = T.classify_files(rows.select("file_name").distinct())
    return join_dimension(rows, tiers, "file_name", ["row_id"]).select("row_id", "tier", "weight", "label", "matched", "confidence")


@query("txt6_file_category", f"""
SELECT row_id, CASE {' '.join(f"WHEN {O.any_of('lower(file_name)', w)} THEN {O.lit(k)}" for k, w in D.FILE_CATEGORIES)}
       ELSE {O.lit(D.FILE_UNCATEGORISED)} END AS category FROM {{v_raw_contacts}}""")
def txt6_file_category(spark, sf):
    return raw(spark, sf).select("row_id", T.file_category(c("file_name")).alias("category"))


_VAGUE_NAME = "(CASE WHEN row_id % 3 = 0 THEN CAST(row_id AS VARCHAR) || '.csv' WHEN row_id % 3 = 1 THEN 'a' || CAST(row_id % 50 AS VARCHAR) || '.txt' ELSE file_name END)"


@query("txt7_file_meaningless", f"""
SELECT row_id, NOT ({' OR '.join(O.any_of('lower(fname)', w) for _, w in D.FILE_CATEGORIES)})
       AND ({O.any_of('lower(fname)', D.GENERIC_FILE_WORDS)} OR length(stem) <= 3 OR regexp_matches(stem, '^[0-9]+$')) AS meaningless
FROM (SELECT row_id, fname, regexp_replace(fname, '^(.+)\\.[^.]*$', '\\1') AS stem
      FROM (SELECT row_id, {_VAGUE_NAME} AS fname FROM {{v_raw_contacts}}) a) b""")
def txt7_file_meaningless(spark, sf):
    fname = F.expr(_VAGUE_NAME.replace("VARCHAR", "STRING"))
    return raw(spark, sf).select("row_id", T.file_meaningless(fname).alias("meaningless"))


_age = f"(DATE '{AS_OF}' - file_date)"


@query("dat1_recency_steps", f"""
SELECT row_id, {O.age_steps(_age, [(90, 5.0), (180, 4.5), (365, 4.0), (730, 3.0), (1095, 2.0), (1825, 1.5)], 1.0)} AS rfm_recency,
       {O.age_steps(_age, [(90, 15.0), (180, 12.0), (365, 9.0), (730, 6.0), (1825, 3.0)], 0.0)} AS unified_recency
FROM {{v_raw_contacts}}""")
def dat1_recency_steps(spark, sf):
    return raw(spark, sf).select("row_id", DT.rfm_recency(c("file_date"), AS_OF).alias("rfm_recency"),
                                 DT.unified_recency(c("file_date"), AS_OF).alias("unified_recency"))


@query("mth1_step_bins", "SELECT lead_key, f AS frequency, m AS monetary, s_cross_source AS cross_source FROM {o_parts}")
def mth1_step_bins(spark, sf):
    return contacts(spark, sf).select(
        "lead_key", DT.rfm_frequency(c("source_count")).alias("frequency"),
        DT.rfm_monetary(c("source_weight")).alias("monetary"),
        DT.cross_source(c("source_count")).alias("cross_source"))


@query("mth2_rescale_clip", f"""
SELECT lead_key, s_source_quality AS quality,
       {O.rnd('least(1e0, greatest(0e0, (source_count - 1e0) / 10e0))', 6)} AS rescaled FROM {{o_parts}}""")
def mth2_rescale_clip(spark, sf):
    return contacts(spark, sf).select(
        "lead_key", S.source_quality(c("source_weight")).alias("quality"),
        N.half_up(N.rescale(c("source_count"), 1, 10), 6).alias("rescaled"))


@query("arr1_source_list", """
SELECT lead_key, list_sort(list(DISTINCT file_name))[1] AS first_source, count(DISTINCT file_name) AS n_sources,
       array_to_string(list_sort(list(DISTINCT file_name)), ', ') AS all_sources
FROM {o_keyed} WHERE phone IS NOT NULL AND reject IS NULL GROUP BY lead_key""")
def arr1_source_list(spark, sf):
    lists = R.joined_list(R.golden_files(keyed(spark, sf)), "file_name", "all_sources")
    return lists.select("lead_key", "all_sources", c("all_sources_first").alias("first_source"), c("all_sources_count").alias("n_sources"))


@query("jsn1_json_columns", """
SELECT lead_key, source_tier AS tier_back, CAST(source_count AS BIGINT) AS count_back FROM {o_golden}""")
def jsn1_json_columns(spark, sf):
    """Metadata struct to JSON text and back."""
    packed = contacts(spark, sf).select(
        "lead_key", F.to_json(F.struct("source_tier", "source_count")).alias("metadata"))
    back = F.from_json("metadata", "source_tier STRING, source_count BIGINT")
    return packed.select("lead_key", back["source_tier"].alias("tier_back"), back["source_count"].alias("count_back"))


# --- resolution ------------------------------------------------------------
def history(spark, sf):
    return R.history_keys(load(spark, sf, "v_chat_leads").filter("lead_no % 2 = 0"))


O.cte("o_history", """
SELECT DISTINCT k AS lead_key FROM (SELECT unnest([phone, email]) AS k FROM {v_chat_leads} WHERE lead_no % 2 = 0) t
WHERE coalesce(k, '') <> ''""")


@query("join1_history_anti", """
SELECT row_id, lead_key, 'new' AS side FROM {o_keyed} WHERE lead_key IS NOT NULL AND lead_key NOT IN (SELECT lead_key FROM {o_history})
UNION ALL SELECT row_id, lead_key, 'seen' FROM {o_keyed} WHERE lead_key IN (SELECT lead_key FROM {o_history})""")
def join1_history_anti(spark, sf):
    rows = keyed(spark, sf).filter("lead_key IS NOT NULL").select("row_id", "lead_key")
    old = history(spark, sf)
    return (R.unseen(rows, old, ["row_id"]).select("row_id", "lead_key", F.lit("new").alias("side"))
            .unionByName(R.already_seen(rows, old).select("row_id", "lead_key", F.lit("seen").alias("side"))))


@query("win1_first_seen", """
SELECT row_id, lead_key, status = 'valid' AS is_lead FROM {o_marked} WHERE lead_key IS NOT NULL""")
def win1_first_seen(spark, sf):
    marked = R.mark_status(keyed(spark, sf)).filter("lead_key IS NOT NULL")
    return marked.select("row_id", "lead_key", (c("status") == "valid").alias("is_lead"))


@query("set4_member_minus", """
SELECT DISTINCT lead_key FROM {o_keyed} WHERE lead_key IS NOT NULL EXCEPT SELECT lead_key FROM {o_history}""")
def set4_member_minus(spark, sf):
    keys = keyed(spark, sf).filter("lead_key IS NOT NULL").select("lead_key").distinct()
    return keys.join(history(spark, sf), "lead_key", "left_anti")


O.cte("lead", "SELECT * FROM {o_marked} JOIN {o_file_tier} USING (file_name) WHERE status = 'valid' AND phone IS NOT NULL")
O.cte("dup", "SELECT * FROM {o_marked} JOIN {o_file_tier} USING (file_name) WHERE status = 'duplicate' AND phone IS NOT NULL")


@query("join2_dup_merge", """
SELECT * FROM (WITH e AS (SELECT phone, arg_min(name, rn) FILTER (WHERE name <> '') AS n_name, arg_min(email, rn) FILTER (WHERE email <> '') AS n_email,
             arg_min(uid, rn) FILTER (WHERE uid <> '') AS n_uid, arg_min(link, rn) FILTER (WHERE link <> '') AS n_link,
             arg_min(tier, rn - CAST(weight * 100 AS BIGINT) * 1000000000000) AS n_tier, max(weight) AS n_weight FROM {dup} GROUP BY phone),
m AS (SELECT d.phone, count(DISTINCT d.file_name) AS n FROM {dup} d JOIN {lead} l ON d.phone = l.phone AND d.file_name <> l.file_name GROUP BY d.phone)
SELECT l.phone, coalesce(nullif(l.name, ''), n_name, '') AS name, coalesce(nullif(l.email, ''), n_email, '') AS email,
       coalesce(nullif(l.uid, ''), n_uid, '') AS uid, coalesce(nullif(l.link, ''), n_link, '') AS link,
       CASE WHEN n_weight > l.weight THEN n_tier ELSE l.tier END AS source_tier,
       CAST(CASE WHEN n_weight > l.weight THEN n_weight ELSE l.weight END AS DOUBLE) AS source_weight, 1 + coalesce(m.n, 0) AS source_count
FROM {lead} l LEFT JOIN e ON l.phone = e.phone LEFT JOIN m ON l.phone = m.phone)""")
def join2_dup_merge(spark, sf):
    marked = R.mark_status(keyed(spark, sf))
    stored = R.with_tier(marked.filter("status = 'valid' AND phone IS NOT NULL")).withColumn(
        "source_count", F.lit(1).cast("bigint"))
    return R.merge_duplicates(marked.filter("status = 'duplicate'"), stored, stored.select("phone", "file_name"))


O.cte("o_identity", f"""
SELECT file_name, rn, nullif(regexp_extract(raw_uid || ' ' || raw_link, '([0-9]{{9,}})', 1), '') AS uid, name,
       CASE WHEN length({_loose}) >= 10 THEN {_loose} END AS phone FROM {{o_clean}}""")


@query("join3_uid_reconcile", """
SELECT file_name, uid, name, phone, CASE WHEN phone IS NULL THEN 'no_phone' WHEN name IS NULL THEN 'no_name' ELSE 'mapped' END AS status
FROM (SELECT file_name, uid, arg_max(name, rn) FILTER (WHERE name <> '') AS name, arg_max(phone, rn) FILTER (WHERE phone IS NOT NULL) AS phone
      FROM {o_identity} WHERE uid IS NOT NULL GROUP BY file_name, uid) t
WHERE name IS NOT NULL OR phone IS NOT NULL""")
def join3_uid_reconcile(spark, sf):
    return R.reconcile(identity_rows(spark, sf))


def identity_rows(spark, sf):
    return raw(spark, sf).select(
        "file_name", "pos", T.uid_extract(F.concat_ws(" ", "raw_uid", "raw_link")).alias("uid"),
        T.name_clean(c("raw_name")).alias("name"), P.phone_loose(c("raw_phone")).alias("phone"))


@query("set2_union_keys", """
SELECT uid, count(*) AS files FROM (SELECT DISTINCT file_name, uid FROM {o_identity}
WHERE uid IS NOT NULL AND (name <> '' OR phone IS NOT NULL)) t GROUP BY uid""")
def set2_union_keys(spark, sf):
    rows = identity_rows(spark, sf).filter("uid IS NOT NULL")
    keys = (rows.filter("name <> ''").select("file_name", "uid")
            .union(rows.filter("phone IS NOT NULL").select("file_name", "uid")).distinct())
    return keys.groupBy("uid").agg(F.count("*").alias("files"))


_STAT = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in R.STATUSES)


@query("agg1_ingest_stats", f"""
SELECT file_name, count(*) AS total_rows, {_STAT},
       count(*) FILTER (WHERE status = 'valid' AND {O.province('address', 'file_name')} = 'Unknown') AS unclassified
FROM {{o_marked}} GROUP BY ROLLUP (file_name)""")
def agg1_ingest_stats(spark, sf):
    return R.ingest_stats(R.mark_status(keyed(spark, sf)))


@query("agg2_golden_record", "SELECT * FROM {o_golden}")
def agg2_golden_record(spark, sf):
    return contacts(spark, sf)


@query("agg2_golden_names", "SELECT DISTINCT lead_key, name FROM {o_keyed} WHERE phone IS NOT NULL AND reject IS NULL AND name <> ''")
def agg2_golden_names(spark, sf):
    return R.golden_names(keyed(spark, sf))


# --- scores ----------------------------------------------------------------
@query("scr1_contact_score", "SELECT lead_key, CAST(score AS INTEGER) AS score FROM {o_scored}")
def scr1_contact_score(spark, sf):
    return contacts(spark, sf).select("lead_key", S.contact_score(
        c("phone"), c("email"), c("address"), F.lit("Unknown"), c("file_source"), c("note")).alias("score"))


@query("scr2_completeness", "SELECT lead_key, s_completeness AS completeness FROM {o_parts}")
def scr2_completeness(spark, sf):
    return contacts(spark, sf).select("lead_key", S.completeness(
        c("phone"), c("email"), c("name"), c("address")).alias("completeness"))


@query("scr3_behavioral", f"""
SELECT conversation_id, {O.rnd('least(10e0, least(7e0, intent_score * 0.7e0) + (CASE WHEN phone IS NOT NULL THEN 2e0 ELSE 0e0 END) + (CASE WHEN quality_score >= 7 THEN 1e0 ELSE 0e0 END))', 2)} AS behavioral
FROM {{v_chat_leads}}""")
def scr3_behavioral(spark, sf):
    return load(spark, sf, "v_chat_leads").select("conversation_id", S.behavioral(
        c("intent_score"), c("phone").isNotNull(), c("quality_score")).alias("behavioral"))


@query("scr4_unified_score", """
SELECT lead_key, s_completeness, s_source_quality, s_cross_source, s_recency, 0e0 AS s_behavioral, unified_score, grade
FROM {o_scored}""")
def scr4_unified_score(spark, sf):
    return S.unified_score(contacts(spark, sf), AS_OF).select(
        "lead_key", "s_completeness", "s_source_quality", "s_cross_source", "s_recency",
        "s_behavioral", "unified_score", "grade")


@query("scr5_legacy_score", "SELECT lead_key, legacy_score FROM {o_scored}")
def scr5_legacy_score(spark, sf):
    return scored(spark, sf).select("lead_key", "legacy_score")


@query("scr6_rfm", "SELECT lead_key, rfm_score FROM {o_scored}")
def scr6_rfm(spark, sf):
    return contacts(spark, sf).select("lead_key", S.rfm(
        c("source_count"), c("source_weight"), c("latest_file_date"), AS_OF).alias("rfm_score"))


@query("scr7_rfm_segment", "SELECT rfm_segment, count(*) AS contacts FROM {o_scored} GROUP BY 1")
def scr7_rfm_segment(spark, sf):
    return scored(spark, sf).groupBy("rfm_segment").agg(F.count("*").alias("contacts"))


_SCORED = ["lead_key", "province_phone", "province", "source_tier", "source_weight", "unified_score",
           "grade", "legacy_score", "rfm_score", "rfm_segment", "score"]


@query("scr22_rescore_all", "SELECT " + ", ".join(_SCORED).replace(" score", " CAST(score AS INTEGER) AS score") + " FROM {o_scored}")
def scr22_rescore_all(spark, sf):
    return scored(spark, sf).select(*_SCORED)
