"""SQL fragments of the oracles (DuckDB dialect)."""

from leadloom import dictionaries as D
from leadloom.plans.registry import cte

CONTACTS_AS_OF = "2001-09-01"
EVENTS_AS_OF = "2024-01-31"


def lit(text):
    if text is None:
        return "NULL"
    if isinstance(text, (int, float)):
        return str(text)
    return "'" + text.replace("'", "''") + "'"


def values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(lit(c) for c in r) + ")" for r in rows) + ")"


def rnd(expr, n):
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def safe(num, den):
    return f"(CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0e0 END)"


def rate(num, den, n, scale=1):
    return rnd(f"{safe(num, den)} * {int(scale)}e0", n)


def esum(expr):
    return f"sum(CAST({expr} AS DECIMAL(28,6)))"


def eavg(expr, n):
    return rnd(safe(esum(expr), f"count({expr})"), n)


def any_of(text, words):
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def hits(text, words):
    return "(" + " + ".join(f"CAST(contains({text}, {lit(w)}) AS INTEGER)" for w in words) + ")"


NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def dial(expr, when):
    t = f"trim({expr})"
    n = (f"CASE WHEN regexp_matches({t}, {when}) AND regexp_matches({t}, {NUMBER}) "
         f"THEN CAST(CAST(trunc(try_cast({t} AS DOUBLE)) AS HUGEINT) AS VARCHAR) ELSE {t} END")
    return f"regexp_replace(regexp_replace({n}, '[^0-9+]', '', 'g'), '^\\+', '')"


PREFIXES = "(" + ", ".join(lit(p) for p in D.MOBILE_PREFIXES) + ")"


def with_zero(d):
    return (f"(CASE WHEN starts_with({d}, '84') AND length({d}) = 11 THEN '0' || substr({d}, 3) "
            f"WHEN length({d}) = 9 THEN '0' || {d} ELSE {d} END)")


def e164(expr):
    n = with_zero("(" + dial(expr, "'[eE.]'") + ")")
    return (f"(CASE WHEN regexp_matches({n}, '^0[0-9]{{9}}$') AND substr({n}, 1, 3) IN {PREFIXES} "
            f"THEN '+84' || substr({n}, 2) END)")


def filled(expr):
    return f"(CASE WHEN trim({expr}) <> '' AND lower(trim({expr})) <> 'nan' THEN trim({expr}) END)"


EMAIL = r"'^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$'"


def email(expr):
    return f"(CASE WHEN regexp_matches(trim({expr}), {EMAIL}) THEN lower(trim({expr})) END)"


def name(expr):
    words = f"string_split(trim(regexp_replace(coalesce({expr}, ''), '\\s+', ' ', 'g')), ' ')"
    nulls = ", ".join(lit(w) for w in D.NULL_NAME_WORDS)
    return (f"(CASE WHEN lower(coalesce({expr}, '')) IN ({nulls}) THEN '' ELSE array_to_string("
            f"list_transform({words}, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END)")


def province(address, file_name):
    t = f"lower(coalesce({address}, '') || ' ' || coalesce({file_name}, ''))"
    whens = [f"WHEN {any_of(t, words)} THEN {lit(label)}" for label, words in D.PROVINCE_PRIORITY]
    whens += [f"WHEN contains({t}, {lit(n.lower())}) THEN {lit(D.PROVINCE_ALIASES.get(n, n))}"
              for n in D.PROVINCE_NAMES]
    return "(CASE " + " ".join(whens) + " ELSE 'Unknown' END)"


def province_phone(expr):
    d = f"regexp_replace(coalesce({expr}, ''), '[^0-9]', '', 'g')"
    d = f"(CASE WHEN starts_with({d}, '84') AND length({d}) = 11 THEN '0' || substr({d}, 3) ELSE {d} END)"
    d = f"(CASE WHEN starts_with({d}, '0') THEN {d} ELSE '0' || {d} END)"
    four = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in D.LANDLINE_PROVINCE.items() if len(k) == 4)
    three = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in D.LANDLINE_PROVINCE.items() if len(k) == 3)
    return (f"coalesce(CASE substr({d}, 1, 4) {four} END, CASE substr({d}, 1, 3) {three} END, 'Unknown')")


def source(text):
    t = f"lower({text})"
    return "(CASE " + " ".join(f"WHEN {any_of(t, w)} THEN {lit(s)}" for s, w in D.SOURCE_WORDS) + " ELSE 'Unknown' END)"


def vip(text):
    return any_of(f"lower({text})", D.VIP_WORDS)


def age_steps(days, table, older):
    return "(CASE " + " ".join(f"WHEN {days} <= {b} THEN {s}e0" for b, s in table) + f" ELSE {older}e0 END)"


def ge_steps(x, table, below):
    def const(v):
        return f"{v}e0" if isinstance(v, float) else lit(v)

    return ("(CASE " + " ".join(f"WHEN {x} >= {b} THEN {const(s)}" for b, s in table)
            + f" ELSE {const(below)} END)")


def grade(x):
    return ge_steps(x, [(b, g) for b, g, _ in D.GRADES[:-1]], "D")


cte("o_tier_rules", "SELECT * FROM " + values(
    [(t, i, w, label, p) for i, (t, w, label, _, ps) in enumerate(D.TIERS) for p in ps])
    + " v(tier, ord, weight, label, pattern)")

cte("o_clean", f"""
SELECT *, '0' || substr(e164, 4) AS phone,
       {email('raw_email')} AS email, {name('raw_name')} AS name,
       coalesce({filled('raw_address')}, '') AS address, coalesce({filled('raw_uid')}, '') AS uid,
       coalesce({filled('raw_link')}, '') AS link,
       row_number() OVER (ORDER BY file_name, pos) AS rn
FROM (SELECT *, {e164('raw_phone')} AS e164 FROM {{v_raw_contacts}}) r""")
cte("o_keyed", f"""
SELECT *, CASE WHEN reject IS NULL THEN coalesce(phone, email) END AS lead_key
FROM (SELECT *, CASE WHEN {filled('raw_phone')} IS NOT NULL AND phone IS NULL THEN 'invalid_phone'
                     WHEN {filled('raw_phone')} IS NULL AND email IS NULL THEN 'missing_contact' END AS reject
      FROM {{o_clean}}) c""")
cte("o_marked", """
SELECT *, coalesce(reject, CASE WHEN row_number() OVER (PARTITION BY lead_key ORDER BY rn) = 1
                                THEN 'valid' ELSE 'duplicate' END) AS status
FROM {o_keyed}""")
cte("o_file_tier", """
SELECT file_name, coalesce(tier, 'unknown') AS tier, coalesce(weight, 0.25) AS weight,
       coalesce(label, 'Chua Phan Loai') AS label, coalesce(n, 0) AS n
FROM (SELECT DISTINCT file_name FROM {v_raw_contacts}) f
LEFT JOIN (SELECT * FROM (
    SELECT file_name, tier, any_value(weight) AS weight, any_value(label) AS label, count(*) AS n,
           row_number() OVER (PARTITION BY file_name ORDER BY any_value(weight) DESC, any_value(ord)) AS k
    FROM (SELECT DISTINCT file_name FROM {v_raw_contacts}) d, {o_tier_rules}
    WHERE regexp_matches(file_name, '(?i)' || pattern) GROUP BY file_name, tier) w WHERE k = 1) b
USING (file_name)""")
cte("o_golden", """
SELECT lead_key, max(phone) AS phone,
       coalesce(arg_min(coalesce(email, ''), rn) FILTER (WHERE phone IS NULL OR email <> ''), '') AS email,
       coalesce(arg_min(name, rn) FILTER (WHERE phone IS NULL OR name <> ''), '') AS name,
       coalesce(arg_min(uid, rn) FILTER (WHERE phone IS NULL OR uid <> ''), '') AS uid,
       coalesce(arg_min(link, rn) FILTER (WHERE phone IS NULL OR link <> ''), '') AS link,
       CASE WHEN max(phone) IS NULL THEN arg_min(address, rn)
            ELSE arg_min(address, rn - length(address) * 1000000000000) END AS address,
       CASE WHEN max(phone) IS NULL THEN arg_min(tier, rn)
            ELSE arg_min(tier, rn - CAST(weight * 100 AS BIGINT) * 1000000000000) END AS source_tier,
       CAST(CASE WHEN max(phone) IS NULL THEN arg_min(weight, rn) ELSE max(weight) END AS DOUBLE) AS source_weight,
       CASE WHEN max(phone) IS NULL THEN 1 ELSE count(DISTINCT file_name) END AS source_count,
       max(file_date) AS latest_file_date, arg_min(file_name, rn) AS file_source,
       coalesce(arg_min(raw_note, rn), '') AS note, coalesce(arg_min(raw_source, rn), '') AS source
FROM {o_keyed} JOIN {o_file_tier} USING (file_name)
WHERE lead_key IS NOT NULL GROUP BY lead_key""")

# fixed values repeated here on purpose: the oracle states the expected steps itself
_DAYS = f"(DATE '{CONTACTS_AS_OF}' - latest_file_date)"
cte("o_parts", f"""
SELECT *,
  (CASE WHEN phone <> '' THEN 20e0 ELSE 0e0 END) + (CASE WHEN contains(email, '@') THEN 5e0 ELSE 0e0 END)
   + (CASE WHEN lower(trim(name)) NOT IN ('', 'none', 'nan', 'unknown', 'n/a', '-') THEN 3e0 ELSE 0e0 END)
   + (CASE WHEN length(trim(address)) > 4 THEN 2e0 ELSE 0e0 END) AS s_completeness,
  {rnd('(source_weight - 0.25e0) / 0.75e0 * 25e0', 2)} AS s_source_quality,
  {ge_steps('source_count', [(6, 20.0), (5, 18.0), (4, 15.0), (3, 10.0), (2, 6.0)], 2.0)} AS s_cross_source,
  {age_steps(_DAYS, [(90, 15.0), (180, 12.0), (365, 9.0), (730, 6.0), (1825, 3.0)], 0.0)} AS s_recency,
  {age_steps(_DAYS, [(90, 5.0), (180, 4.5), (365, 4.0), (730, 3.0), (1095, 2.0), (1825, 1.5)], 1.0)} AS r,
  {ge_steps('source_count', [(7, 5.0), (5, 4.5), (4, 4.0), (3, 3.0), (2, 2.0)], 1.0)} AS f,
  {ge_steps('source_weight', [(0.95, 5.0), (0.85, 4.5), (0.75, 4.0), (0.60, 3.0), (0.45, 2.0), (0.35, 1.5)], 1.0)} AS m
FROM {{o_golden}}""")
cte("o_scored", f"""
SELECT *, {grade('unified_score')} AS grade, {rnd('unified_score / 10e0', 1)} AS legacy_score,
       {ge_steps('rfm_score', [(9.0, 'Champions'), (7.5, 'Loyal'), (6.0, 'Potential Loyalist'), (4.5, 'At Risk'), (3.0, 'Hibernating')], 'Lost')} AS rfm_segment,
       {province_phone('phone')} AS province_phone, {province('address', 'file_source')} AS province,
       least(10, (CASE WHEN phone <> '' THEN 5 ELSE 0 END) + (CASE WHEN email <> '' THEN 3 ELSE 0 END)
             + (CASE WHEN address <> '' THEN 2 ELSE 0 END)
             + (CASE WHEN {vip("file_source || note")} THEN 2 ELSE 0 END)) AS score
FROM (SELECT *, {rnd('least(100e0, s_completeness + s_source_quality + s_cross_source + s_recency)', 1)} AS unified_score,
             {rnd('(CAST(r AS DECIMAL(10,4)) * 0.3 + CAST(f AS DECIMAL(10,4)) * 0.4 + CAST(m AS DECIMAL(10,4)) * 0.3) * 2', 2)} AS rfm_score
      FROM {{o_parts}}) p""")
