"""Queries over enriched contacts: hot leads, profiles, lead scores, reports."""

from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.functions import dates as DT
from leadloom.operators import cluster as C
from leadloom.operators import enrich as E
from leadloom.operators import reports as R
from leadloom.operators import resolve as RS
from leadloom.operators.common import numbered, top_per_key
from leadloom.plans import duck as O
from leadloom.plans.contacts import contacts, keyed, scored
from leadloom.plans.registry import cte, query
from leadloom.plans.views import load
from leadloom.session import staged

AS_OF = O.EVENTS_AS_OF
c = F.col


def hot(spark, sf):
    return E.social_hot_leads(load(spark, sf, "v_interactions"), AS_OF).unionByName(
        E.listing_hot_leads(load(spark, sf, "v_listings")))


def hot_people(spark, sf):
    """Hot leads reduced to one row per uid and per phone."""
    return E.social_hot_uids(load(spark, sf, "v_interactions"), AS_OF).unionByName(
        E.listing_hot_leads(load(spark, sf, "v_listings")), allowMissingColumns=True)


def profiles(spark, sf, base=None):
    """Profiles and matched hot leads; the matched leads feed both."""
    known = E.profiles_of(contacts(spark, sf) if base is None else base)
    matched = E.match_hot_leads(hot(spark, sf), known)
    return known.unionByName(E.new_profiles(matched)), matched


TEXTS = ("name", "address", "source_url", "note", "keyword", "behavior")


def _table(rows, label, texts):
    """A written table; where nobody reads the ``TEXTS`` of its rows, they are neither made nor written, and empty then."""
    if texts:
        return staged(rows, label)
    return staged(rows.drop(*TEXTS, "seen_at"), label).withColumns({x: F.lit("") for x in TEXTS if x in rows.columns})


def scored_profiles(spark, sf, events=False, texts=True):
    """Profiles with cluster (a fixed rule here), scores and analytics, and the matched leads.

    Scored contacts and matched leads are tables of the stored model, read several
    times: interactions and listings are read once each.  Scores need one matched
    row per uid and phone only; with ``events`` the matched leads are all interactions.
    Without ``texts`` names, addresses, notes, keywords and behaviours are left empty;
    keys, counts and scores are the same.
    """
    base = _table(scored(spark, sf).select(
        "name", "phone", "uid", "email", "address", "source", "note", "source_count", "unified_score",
        "source_tier", "source_weight"), "scored", texts)
    known = E.profiles_of(base)
    matched = _table(E.match_hot_leads(hot_people(spark, sf), known), "matched", texts)
    people = known.unionByName(E.new_profiles(matched))
    full = E.with_contact_analytics(E.with_hot(people, matched), base)
    leads = E.with_lead_score(full.withColumn("cluster", (c("source_count") % 3).cast("int")))
    return leads, E.match_hot_leads(hot(spark, sf), known) if events else matched


def leads(spark, sf):
    return scored_profiles(spark, sf)[0]


def features(spark, sf):
    """The features of all profiles, which hold no text."""
    return E.features(scored_profiles(spark, sf, texts=False)[0])


_W = "(CASE behavior WHEN 'comment' THEN 3.0 WHEN 'tag' THEN 2.5 WHEN 'share' THEN 2.0 ELSE 0.5 END)"
_RECENT = f"(ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)"
cte("o_uid_score", f"""
SELECT uid, {O.rnd(f"least(10, sum({_W} * CASE WHEN {_RECENT} THEN 1.5 ELSE 1.0 END))", 2)} AS hot_score
FROM {{v_interactions}} WHERE uid <> '' GROUP BY uid""")
cte("o_listing", f"""
SELECT phone, {O.rnd('least(8e0, 3e0 + (count(*) - 1) * 0.5e0)', 2)} AS hot_score, count(*) AS listings,
       min(id) AS id, arg_min(keyword, id) AS keyword, arg_min(source_url, id) AS source_url, arg_min(scraped_at, id) AS scraped_at
FROM {{v_valid_listings}} GROUP BY phone""")
cte("o_hot", """
SELECT 'facebook' AS source, event_id AS seq, uid, CAST(NULL AS VARCHAR) AS phone, keyword, behavior, source_url, hot_score
FROM {v_interactions} JOIN {o_uid_score} USING (uid) WHERE hot_score >= 0.3
UNION ALL SELECT 'google', id, NULL, phone, keyword, 'listing', source_url, hot_score FROM {o_listing}""")
cte("o_known", """
SELECT '+84' || substr(phone, 2) AS profile_key, name, phone, uid, email, address, source, note
FROM {o_golden} WHERE phone IS NOT NULL""")
cte("o_match", """
SELECT h.*, coalesce(u.profile_key, p.profile_key) AS profile_key,
       coalesce(u.profile_key, p.profile_key) IS NOT NULL AS is_existing_customer
FROM {o_hot} h LEFT JOIN (SELECT uid, max(profile_key) AS profile_key FROM {o_known} WHERE uid <> '' GROUP BY uid) u ON h.uid = u.uid
LEFT JOIN {o_known} p ON h.phone = p.profile_key""")
cte("o_new", """
SELECT phone AS profile_key, '' AS name, phone, '' AS uid, '' AS email, '' AS address, 'google_scraping' AS source,
       'Thu thập từ Google: ' || keyword || ' | ' || source_url AS note
FROM {o_match} WHERE source = 'google' AND NOT is_existing_customer""")
cte("o_profiles", "SELECT * FROM {o_known} UNION ALL SELECT * FROM {o_new}")
cte("o_hot_agg", """
SELECT profile_key, coalesce(max(hot_score) FILTER (WHERE source = 'facebook'), 0e0) AS fb_score,
       coalesce(max(hot_score) FILTER (WHERE source = 'google'), 0e0) AS search_score,
       coalesce(arg_min(behavior, seq) FILTER (WHERE source = 'facebook' AND behavior <> ''), '') AS behavior,
       coalesce(arg_min(keyword, seq) FILTER (WHERE source = 'google' AND keyword <> ''), '') AS keyword
FROM {o_match} WHERE profile_key IS NOT NULL GROUP BY profile_key""")
cte("o_with_hot", """
SELECT p.*, coalesce(h.fb_score, 0e0) AS fb_score, coalesce(h.search_score, l.hot_score, 0e0) AS search_score, h.behavior, h.keyword
FROM {o_profiles} p LEFT JOIN {o_hot_agg} h USING (profile_key) LEFT JOIN {o_listing} l ON l.phone = p.profile_key""")
cte("o_full", """
SELECT p.*, CAST(coalesce(s.source_count, 1) AS BIGINT) AS source_count, coalesce(s.unified_score, 0e0) AS unified_score,
       coalesce(s.source_tier, 'unknown') AS source_tier, CAST(coalesce(s.source_count, 1) % 3 AS INTEGER) AS cluster
FROM {o_with_hot} p LEFT JOIN (SELECT '+84' || substr(phone, 2) AS k, * FROM {o_scored} WHERE phone IS NOT NULL) s ON p.profile_key = s.k""")
_POINTS = """(CASE WHEN phone <> '' THEN 2e0 ELSE 0e0 END) + (CASE WHEN uid <> '' THEN 1e0 ELSE 0e0 END)
 + (CASE WHEN email <> '' THEN 1e0 ELSE 0e0 END) + cluster
 + least(2e0, fb_score / 5e0) + least(2e0, search_score / 4e0)
 + (CASE WHEN source_count >= 4 THEN 1.5e0 WHEN source_count >= 2 THEN 1e0 ELSE 0e0 END)
 + (CASE WHEN unified_score >= 80 THEN 2e0 WHEN unified_score >= 70 THEN 1.5e0 WHEN unified_score >= 50 THEN 0.5e0 ELSE 0e0 END)
 + (CASE WHEN source_tier IN ('banking_vip', 'real_estate_vip') THEN 2e0 WHEN source_tier IN ('ceo_director', 'automotive_vip') THEN 1.5e0
         WHEN source_tier IN ('stock_gold', 'fitness_health') THEN 1e0 WHEN source_tier IN ('education_hr', 'telecom_mass') THEN 0.5e0 ELSE 0e0 END)"""
cte("o_leads", f"SELECT *, {O.rnd(f'least(10e0, {_POINTS})', 2)} AS lead_score FROM {{o_full}}")
cte("o_files", """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) || '.csv'
            WHEN o_orderkey % 3 = 1 THEN 'a' || CAST(o_orderkey % 50 AS STRING) || '.txt'
            ELSE file_name || CAST(o_orderkey AS STRING) || '.csv' END AS file_name,
       CAST(floor(o_totalprice * 100 + 5e-1) AS BIGINT) AS size_bytes
FROM {orders} JOIN {v_raw_contacts} ON o_orderkey = row_id""")


def files(spark, sf):
    """A file listing: one file name and size per order."""
    rows = load(spark, sf, "orders").join(load(spark, sf, "v_raw_contacts").select("row_id", "file_name"),
                                          c("o_orderkey") == c("row_id"))
    key = c("o_orderkey")
    return rows.select(
        F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit(".csv")))
        .when(key % 3 == 1, F.concat(F.lit("a"), (key % 50).cast("string"), F.lit(".txt")))
        .otherwise(F.concat("file_name", key.cast("string"), F.lit(".csv"))).alias("file_name"),
        F.floor(c("o_totalprice") * 100 + F.lit(0.5)).cast("bigint").alias("size_bytes"))


# --- interactions and listings ---------------------------------------------
@query("dat2_recent_flag", f"SELECT event_id, {_RECENT} AS is_recent FROM {{v_interactions}}")
def dat2_recent_flag(spark, sf):
    return load(spark, sf, "v_interactions").select("event_id", DT.within_days(c("ts"), AS_OF).alias("is_recent"))


@query("agg3_interaction_score", "SELECT uid, hot_score FROM {o_uid_score}")
def agg3_interaction_score(spark, sf):
    return E.interaction_scores(load(spark, sf, "v_interactions").filter("uid <> ''"), AS_OF)


@query("flt4_stale_delete", "SELECT seq, uid, hot_score FROM {o_hot} WHERE source = 'facebook'")
def flt4_stale_delete(spark, sf):
    return E.social_hot_leads(load(spark, sf, "v_interactions"), AS_OF).select("seq", "uid", "hot_score")


@query("agg4_listing_frequency", "SELECT phone, hot_score, listings, id, keyword, source_url FROM {o_listing}")
def agg4_listing_frequency(spark, sf):
    return E.listing_scores(load(spark, sf, "v_listings")).drop("scraped_at")


@query("agg5_listing_dedup", """
SELECT l.phone, l.id, l.keyword, l.source_url FROM {v_valid_listings} l JOIN (SELECT min(id) AS id FROM {v_valid_listings} GROUP BY phone) m ON l.id = m.id""")
def agg5_listing_dedup(spark, sf):
    return E.listing_dedup(load(spark, sf, "v_listings")).drop("scraped_at")


@query("join4_hot_match", "SELECT source, seq, uid, phone, profile_key, is_existing_customer FROM {o_match}")
def join4_hot_match(spark, sf):
    return E.match_hot_leads(hot(spark, sf), E.profiles_of(contacts(spark, sf))).select(
        "source", "seq", "uid", "phone", "profile_key", "is_existing_customer")


@query("join5_new_profiles", "SELECT profile_key, phone, source, note FROM {o_new}")
def join5_new_profiles(spark, sf):
    _, matched = profiles(spark, sf)
    return E.new_profiles(matched).select("profile_key", "phone", "source", "note")


@query("agg6_hot_by_profile", "SELECT * FROM {o_hot_agg}")
def agg6_hot_by_profile(spark, sf):
    _, matched = profiles(spark, sf)
    return E.hot_by_profile(matched)


@query("join6_profile_hot", "SELECT profile_key, fb_score, search_score FROM {o_with_hot}")
def join6_profile_hot(spark, sf):
    people, matched = profiles(spark, sf)
    return E.with_hot(people, matched).select("profile_key", "fb_score", "search_score")


@query("join7_profile_clean", "SELECT profile_key, source_count, unified_score, source_tier FROM {o_full}")
def join7_profile_clean(spark, sf):
    people, _ = profiles(spark, sf)
    return E.with_contact_analytics(people, scored(spark, sf)).select(
        "profile_key", "source_count", "unified_score", "source_tier")


@query("scr8_lead_score", "SELECT profile_key, fb_score, search_score, lead_score FROM {o_leads}")
def scr8_lead_score(spark, sf):
    return leads(spark, sf).select("profile_key", "fb_score", "search_score", "lead_score")


_PHONE_RE = r"'((?:(?:\+84|0084|84)?[3-9][0-9]{8})|(?:0[3-9][0-9]{8}))'"


def _text_phones(expr):
    return (f"list_filter(list_transform(regexp_extract_all(regexp_replace({expr}, '[- ]', '', 'g'), {_PHONE_RE}), "
            f"lambda p: {O.e164('p')}), lambda p: p IS NOT NULL)")


_BODY = "html"
for _tag in ("script", "style", "nav", "footer"):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_TELS = (f"list_filter(list_transform(regexp_extract_all(body, '(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']tel:([^\"'']*)[\"'']', 1), "
         f"lambda p: {O.e164('p')}), lambda p: p IS NOT NULL)")
cte("o_search", f"""
SELECT *, {_text_phones("snippet || ' ' || title")} AS s_phones, {_text_phones("regexp_replace(body, '(?s)<[^>]*>', ' ', 'g')")} AS t_phones, {_TELS} AS l_phones,
       regexp_extract(link, '^https?://(?:www\\.)?([^/]+)', 1) AS domain
FROM (SELECT *, {_BODY} AS body FROM {{v_search_results}}) t""")
_TRUSTED = "domain IN (" + ", ".join(O.lit(d) for d in D.LISTING_DOMAINS) + ")"


def _first_of(expr, key="page_id"):
    """Distinct list values with the position of their first occurrence."""
    return f"(SELECT {key}, p AS phone, min(i) AS i FROM (SELECT {key}, unnest({expr}) AS p, generate_subscripts({expr}, 1) AS i FROM {{o_search}}) x GROUP BY {key}, p)"


@query("txt9_phones_from_text", f"SELECT page_id, phone, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos FROM {_first_of('s_phones')} t")
def txt9_phones_from_text(spark, sf):
    return load(spark, sf, "v_search_results").select("page_id", F.posexplode(
        P.phones_in_text(F.concat_ws(" ", "snippet", "title"))).alias("pos", "phone"))


@query("txt10_phones_from_html", f"""
SELECT page_id, phone, CAST(pos AS INTEGER) AS pos FROM (
  SELECT page_id, phone, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM {_first_of('list_concat(l_phones, t_phones)')} t) u""")
def txt10_phones_from_html(spark, sf):
    rows = load(spark, sf, "v_search_results").select("page_id", P.html_body(c("html")).alias("body"))
    return rows.select("page_id", F.posexplode(P.phones_in_body(c("body"))).alias("pos", "phone"))


@query("txt11_domain", "SELECT page_id, domain FROM {o_search}")
def txt11_domain(spark, sf):
    return load(spark, sf, "v_search_results").select("page_id", T.url_domain(c("link")).alias("domain"))


@query("flt9_trusted_domain", f"SELECT page_id, link FROM {{o_search}} WHERE {_TRUSTED}")
def flt9_trusted_domain(spark, sf):
    return load(spark, sf, "v_search_results").filter(
        T.url_domain(c("link")).isin(D.LISTING_DOMAINS)).select("page_id", "link")


cte("o_page_phones", f"""
SELECT page_id, list(phone ORDER BY i) AS phones FROM {_first_of('list_concat(l_phones, t_phones)')} t GROUP BY page_id""")
cte("o_union_phones", f"""
SELECT link, phone, min(i) AS i FROM (
  SELECT link, unnest(both_lists) AS phone, generate_subscripts(both_lists, 1) AS i
  FROM (SELECT link, list_concat(s_phones, CASE WHEN {_TRUSTED} THEN coalesce(phones, []) ELSE [] END) AS both_lists
        FROM {{o_search}} LEFT JOIN {{o_page_phones}} USING (page_id)) a) b GROUP BY link, phone""")


@query("join9_snippet_page", "SELECT link, phone, CAST(row_number() OVER (PARTITION BY link ORDER BY i) - 1 AS INTEGER) AS pos FROM {o_union_phones}")
def join9_snippet_page(spark, sf):
    return E.search_listings(load(spark, sf, "v_search_results")).select("link", "phone", "pos")


@query("set3_union_distinct_ordered", "SELECT phone, count(*) AS pages, count(*) FILTER (WHERE pos = 0) AS first_on FROM (SELECT phone, row_number() OVER (PARTITION BY link ORDER BY i) - 1 AS pos FROM {o_union_phones}) t GROUP BY phone")
def set3_union_distinct_ordered(spark, sf):
    return E.search_listings(load(spark, sf, "v_search_results")).groupBy("phone").agg(
        F.count("*").alias("pages"), F.count_if(c("pos") == 0).alias("first_on"))


# --- reports ---------------------------------------------------------------
@query("agg7_province_counts", "SELECT province, contacts FROM (" + " UNION ALL ".join(
    f"SELECT {O.lit(p)} AS province, count(*) FILTER (WHERE address ILIKE {O.lit('%' + p + '%')}) AS contacts FROM {{o_golden}}"
    for p in D.SNAPSHOT_PROVINCES) + f" UNION ALL SELECT {O.lit(D.SNAPSHOT_OTHER)}, CAST(greatest(0, count(*)"
    + "".join(f" - count(*) FILTER (WHERE address ILIKE {O.lit('%' + p + '%')})" for p in D.SNAPSHOT_PROVINCES) + ") AS BIGINT) FROM {o_golden}) t")
def agg7_province_counts(spark, sf):
    return R.province_counts(contacts(spark, sf))


@query("agg8_system_counts", """
SELECT 'raw_contacts' AS metric, count(*) AS value FROM {v_raw_contacts} UNION ALL SELECT 'clean_contacts', count(*) FROM {o_golden}
UNION ALL SELECT 'customer_profiles', count(*) FROM {o_leads} UNION ALL SELECT 'hot_leads', count(*) FROM {o_hot} WHERE hot_score > 0
UNION ALL SELECT 'google_leads', count(*) FROM {v_valid_listings} UNION ALL SELECT 'vip_customers', count(*) FROM {o_leads} WHERE lead_score >= 8
UNION ALL SELECT 'warm_leads', count(*) FROM {o_leads} WHERE lead_score >= 5 AND lead_score < 8
UNION ALL SELECT 'with_uid', count(*) FROM {o_leads} WHERE uid <> ''""")
def agg8_system_counts(spark, sf):
    people, score = leads(spark, sf), c("lead_score")
    return R.count_rows({
        "raw_contacts": (load(spark, sf, "v_raw_contacts"), None), "clean_contacts": (contacts(spark, sf), None),
        "customer_profiles": (people, None), "hot_leads": (hot(spark, sf), c("hot_score") > 0),
        "google_leads": (E.valid_listings(load(spark, sf, "v_listings")), None), "vip_customers": (people, score >= 8),
        "warm_leads": (people, (score >= 5) & (score < 8)), "with_uid": (people, c("uid") != "")})


@query("agg9_score_summary", f"""
SELECT count(*) FILTER (WHERE lead_score >= 8) AS vip, count(*) FILTER (WHERE lead_score >= 5 AND lead_score < 8) AS warm,
       count(*) FILTER (WHERE lead_score < 5) AS cold, {O.eavg('lead_score', 2)} AS avg_score, max(lead_score) AS max_score FROM {{o_leads}}""")
def agg9_score_summary(spark, sf):
    return R.score_summary(leads(spark, sf))


@query("agg10_score_describe", f"""
SELECT n AS count, {O.rnd('s / n', 4)} AS mean, {O.rnd('sqrt((q - s * s / n) / (n - 1))', 4)} AS std, mn AS min,
       {O.rnd('p25', 4)} AS p25, {O.rnd('p50', 4)} AS p50, {O.rnd('p75', 4)} AS p75, mx AS max
FROM (SELECT count(*) AS n, CAST(sum(x) AS DOUBLE) AS s, CAST(sum(CAST(x * x AS DECIMAL(28,8))) AS DOUBLE) AS q, min(lead_score) AS mn, max(lead_score) AS mx,
             quantile_cont(lead_score, 0.25) AS p25, quantile_cont(lead_score, 0.5) AS p50, quantile_cont(lead_score, 0.75) AS p75
      FROM (SELECT lead_score, CAST(lead_score AS DECIMAL(18,4)) AS x FROM {{o_leads}}) a) b""")
def agg10_score_describe(spark, sf):
    return R.describe(staged(leads(spark, sf).select("lead_score"), "scores"), "lead_score")


_LABEL = "CASE cluster WHEN 0 THEN 'Standard' WHEN 1 THEN 'Growth' ELSE 'VIP' END"


@query("agg11_cluster_summary", f"SELECT {_LABEL} AS label, count(*) AS contacts, {O.eavg('lead_score', 2)} AS avg_score FROM {{o_leads}} GROUP BY 1")
def agg11_cluster_summary(spark, sf):
    return R.group_summary(leads(spark, sf), C.cluster_label(c("cluster")), "label", "lead_score", 2)


_P = D.PERSONAS
_PERSONA = (f"CASE WHEN unified_score > 65 THEN {O.lit(_P['hnw'])} WHEN unified_score > 45 AND source_weight >= 0.8 THEN {O.lit(_P['business'])} "
            f"WHEN unified_score > 40 AND source_count >= 2 THEN {O.lit(_P['cross'])} WHEN source_weight >= 0.8 THEN {O.lit(_P['finance'])} "
            f"WHEN source_count > 1.5 THEN {O.lit(_P['multichannel'])} ELSE {O.lit(_P['mass'])} END")


@query("agg12_persona_counts", f"""
SELECT persona, n AS contacts, {O.rnd('n * 100e0 / sum(n) OVER ()', 1)} AS share_pct
FROM (SELECT {_PERSONA} AS persona, count(*) AS n FROM {{o_scored}} GROUP BY 1) t""")
def agg12_persona_counts(spark, sf):
    return R.counts_with_share(scored(spark, sf), C.persona(
        c("unified_score"), c("source_weight"), c("source_count")), "persona")


_BUCKET = "CASE grade " + " ".join(f"WHEN '{g}' THEN {O.lit(t)}" for g, t in D.GRADE_BUCKETS.items()) + " END"


@query("agg13_grade_histogram", f"SELECT {_BUCKET} AS bucket, count(*) AS contacts FROM {{o_scored}} GROUP BY 1")
def agg13_grade_histogram(spark, sf):
    return scored(spark, sf).groupBy(R.grade_bucket(c("unified_score")).alias("bucket")).agg(F.count("*").alias("contacts"))


@query("agg14_tier_quality", f"SELECT coalesce(source_tier, 'unknown') AS tier, count(*) AS contacts, {O.eavg('unified_score', 1)} AS avg_score FROM {{o_scored}} GROUP BY 1")
def agg14_tier_quality(spark, sf):
    return R.group_summary(scored(spark, sf), F.coalesce("source_tier", F.lit("unknown")), "tier", "unified_score", 1)


_COV = """SELECT count(*) AS total, count(*) FILTER (WHERE phone <> '') AS has_phone, count(*) FILTER (WHERE email <> '') AS has_email,
 count(*) FILTER (WHERE uid <> '') AS has_uid, count(*) FILTER (WHERE province <> 'Unknown') AS has_province,
 count(*) FILTER (WHERE source_count > 1) AS cross_source, count(*) FILTER (WHERE unified_score >= 70) AS grade_a_plus FROM {o_scored}"""


@query("agg15_coverage", "SELECT *, " + ", ".join(
    f"{O.rate(m, 'total', 2, 100.0)} AS {m}_pct" for m in ("has_phone", "has_email", "cross_source", "grade_a_plus")) + f" FROM ({_COV}) t")
def agg15_coverage(spark, sf):
    return R.coverage(scored(spark, sf))


@query("agg16_province_top", "SELECT province, count(*) AS contacts FROM {o_scored} WHERE province <> 'Unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg16_province_top(spark, sf):
    return R.top_counts(scored(spark, sf).filter("province <> 'Unknown'"), "province", 10)


@query("agg17_source_top", "SELECT file_source, count(*) AS contacts FROM {o_golden} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def agg17_source_top(spark, sf):
    return R.top_counts(contacts(spark, sf), "file_source", 15)


cte("o_listed_tier", """
SELECT f.file_name, size_bytes, coalesce(tier, 'unknown') AS tier, coalesce(weight, 0.25) AS weight, coalesce(label, 'Chua Phan Loai') AS label
FROM {o_files} f LEFT JOIN (SELECT file_name, tier, any_value(weight) AS weight, any_value(label) AS label,
    row_number() OVER (PARTITION BY file_name ORDER BY any_value(weight) DESC, any_value(ord)) AS k
  FROM (SELECT DISTINCT file_name FROM {o_files}) d, {o_tier_rules} WHERE regexp_matches(file_name, '(?i)' || pattern) GROUP BY file_name, tier) b
ON f.file_name = b.file_name AND b.k = 1""")


@query("txt5_file_tier_bulk", f"SELECT file_name, tier, CAST(weight AS DOUBLE) AS weight, {O.rnd('size_bytes / 1048576e0', 2)} AS size_mb FROM {{o_listed_tier}}")
def txt5_file_tier_bulk(spark, sf):
    return T.classify_files(files(spark, sf)).select(
        "file_name", "tier", "weight", F.round((c("size_bytes") / F.lit(1048576.0)).cast("decimal(38,10)"), 2)
        .cast("double").alias("size_mb")).orderBy(F.desc("weight"), "file_name")


@query("agg18_tier_report", f"SELECT label, count(*) AS files, {O.rnd('CAST(sum(size_bytes) AS DOUBLE) / 1048576e0', 1)} AS total_mb, {O.eavg('weight', 2)} AS avg_weight FROM {{o_listed_tier}} GROUP BY label")
def agg18_tier_report(spark, sf):
    return R.tier_report(files(spark, sf))


cte("o_audit", f"""
SELECT file_name, CASE WHEN category = {O.lit(D.FILE_UNCATEGORISED)} AND ({O.any_of('lower(file_name)', D.GENERIC_FILE_WORDS)} OR length(stem) <= 3 OR regexp_matches(stem, '^[0-9]+$'))
       THEN {O.lit(D.FILE_MEANINGLESS)} ELSE category END AS category, {O.rnd('size_bytes / 1024e0', 2)} AS size_kb
FROM (SELECT *, regexp_replace(file_name, '^(.+)\\.[^.]*$', '\\1') AS stem,
      CASE {' '.join(f"WHEN {O.any_of('lower(file_name)', w)} THEN {O.lit(k)}" for k, w in D.FILE_CATEGORIES)} ELSE {O.lit(D.FILE_UNCATEGORISED)} END AS category
      FROM {{o_files}}) t""")


@query("agg19_audit_counts", "SELECT category, count(*) AS files FROM {o_audit} GROUP BY 1")
def agg19_audit_counts(spark, sf):
    return R.audit(files(spark, sf)).groupBy("category").agg(F.count("*").alias("files"))


# --- filters, sorts, ranks -------------------------------------------------
@query("flt1_leads_filter", "SELECT profile_key, lead_score FROM {o_leads} WHERE lead_score >= 5 AND cluster = 2")
def flt1_leads_filter(spark, sf):
    return leads(spark, sf).filter((c("lead_score") >= 5) & (c("cluster") == 2)).select("profile_key", "lead_score")


# Phones as typed, an e-mail, parts of names, phones as some files write them, and 500 numbers.
_PHONES = [f"0{910000000 + 7919 * n:09d}" for n in range(500)]
_WRITTEN = ["10 0023757", "032 0007919", "32-0015838"]
_LOOKUPS = ["091.0000000", "+84320007919", "user7@mail.example.com", "Customer#00000012", "10023757", *_WRITTEN, *_PHONES]
_Q = O.values([[q, n] for q, n in zip(_LOOKUPS, ["0910000000", "0320007919", "user7@mailexamplecom", "Customer#00000012", "10023757",
                                                 "0100023757", "0320007919", "32-0015838", *_PHONES], strict=True)])


@query("flt2_contact_lookup", f"""
SELECT query, lead_key, phone, email, name FROM {{o_golden}}, {_Q} v(query, q)
WHERE phone = q OR email = lower(q) OR contains(lower(name), lower(q))
UNION SELECT DISTINCT k.raw_phone, g.lead_key, g.phone, g.email, g.name FROM {{o_golden}} g JOIN {{o_keyed}} k USING (lead_key)
WHERE g.phone IS NOT NULL AND k.reject IS NULL AND trim(k.raw_phone) IN ({', '.join(O.lit(x) for x in _LOOKUPS)})""")
def flt2_contact_lookup(spark, sf):
    texts = spark.createDataFrame([(q,) for q in _LOOKUPS], "query STRING")
    return R.lookup_texts(contacts(spark, sf), texts, RS.golden_phones(keyed(spark, sf)))


@query("flt2_lookup_keys", """
SELECT DISTINCT l.phone AS query, g.lead_key, g.phone, g.email, g.name FROM {v_chat_leads} l JOIN {o_golden} g ON g.phone = l.phone""")
def flt2_lookup_keys(spark, sf):
    return R.lookup_keys(contacts(spark, sf), load(spark, sf, "v_chat_leads").filter(
        "phone IS NOT NULL").select(c("phone").alias("query")))


@query("flt3_profile_search", """
SELECT profile_key, name, lead_score FROM {o_leads} WHERE contains(phone, '77') OR contains(name, '77') OR contains(uid, '77')
ORDER BY lead_score DESC, profile_key LIMIT 20""")
def flt3_profile_search(spark, sf):
    return R.profile_search(leads(spark, sf), "77").select("profile_key", "name", "lead_score")


@query("flt5_hot_threshold", "SELECT source, count(*) FILTER (WHERE hot_score > 0) AS hot, count(*) FILTER (WHERE hot_score >= 1) AS hot_1 FROM {o_hot} GROUP BY source")
def flt5_hot_threshold(spark, sf):
    return hot(spark, sf).groupBy("source").agg(F.count_if(c("hot_score") > 0).alias("hot"),
                                                F.count_if(c("hot_score") >= 1).alias("hot_1"))


@query("flt8_vip_filter", "SELECT lead_key, CAST(score AS INTEGER) AS score, unified_score FROM {o_scored} WHERE score >= 8 AND unified_score >= 70")
def flt8_vip_filter(spark, sf):
    return scored(spark, sf).filter("score >= 8 AND unified_score >= 70").select("lead_key", "score", "unified_score")


@query("srt1_leads_page", "SELECT profile_key, lead_score FROM {o_leads} ORDER BY lead_score DESC, profile_key LIMIT 50 OFFSET 100")
def srt1_leads_page(spark, sf):
    return R.page(leads(spark, sf).select("profile_key", "lead_score"), [F.desc("lead_score"), "profile_key"], 3, 50)


@query("srt1_leads_after", """
SELECT profile_key, lead_score FROM {o_leads} WHERE lead_score < 8.5 OR (lead_score = 8.5 AND profile_key > '+84350000000') ORDER BY lead_score DESC, profile_key LIMIT 50""")
def srt1_leads_after(spark, sf):
    """The page that follows a given lead, without the rows before it."""
    return R.page_after(leads(spark, sf).select("profile_key", "lead_score"), [("lead_score", False), ("profile_key", True)], (8.5, "+84350000000"), 50)


@query("srt2_hot_top100", "SELECT source, seq, hot_score FROM {o_hot} WHERE hot_score >= 1 ORDER BY hot_score DESC, source, seq LIMIT 100")
def srt2_hot_top100(spark, sf):
    return hot(spark, sf).filter("hot_score >= 1").select("source", "seq", "hot_score").orderBy(
        F.desc("hot_score"), "source", "seq").limit(100)


@query("srt5_vip_top100", "SELECT lead_key, name, phone, uid, unified_score FROM {o_scored} WHERE unified_score >= 70 ORDER BY unified_score DESC, lead_key LIMIT 100")
def srt5_vip_top100(spark, sf):
    return scored(spark, sf).filter("unified_score >= 70").select(
        "lead_key", "name", "phone", "uid", "unified_score").orderBy(F.desc("unified_score"), "lead_key").limit(100)


@query("win6_rank_number", "SELECT profile_key, lead_score, row_number() OVER (ORDER BY lead_score DESC, profile_key) AS stt FROM {o_leads}")
def win6_rank_number(spark, sf):
    return numbered(leads(spark, sf).select("profile_key", "lead_score"), [F.desc("lead_score"), F.asc("profile_key")], "stt")


@query("win7_top_hot_per_profile", """
SELECT profile_key, source, seq, hot_score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_key ORDER BY hot_score DESC, source, seq) AS r FROM {o_match} WHERE profile_key IS NOT NULL) t WHERE r <= 10""")
def win7_top_hot_per_profile(spark, sf):
    _, matched = profiles(spark, sf)
    rows = matched.filter("profile_key IS NOT NULL").select("profile_key", "source", "seq", "hot_score")
    return top_per_key(rows, "profile_key", [F.desc("hot_score"), "source", "seq"], 10, c("seq"))


cte("o_prov_codes", """
SELECT cat, dense_rank() OVER (ORDER BY cat) - 1 AS code FROM (
  SELECT province AS cat FROM (SELECT province, count(*) AS n FROM {o_scored} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t
  UNION SELECT 'Other') u""")


@query("win8_top_values", """
SELECT lead_key, CAST(coalesce(k.code, (SELECT code FROM {o_prov_codes} WHERE cat = 'Other')) AS INTEGER) AS province_code
FROM {o_scored} s LEFT JOIN {o_prov_codes} k ON s.province = k.cat""")
def win8_top_values(spark, sf):
    return R.top_values_code(scored(spark, sf).select("lead_key", "province"), "province", "province_code").drop("province")
