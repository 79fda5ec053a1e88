"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from pyspark.sql import functions as F

from leadloom.llm import (alignment, decontaminate, exact_dedup, html_extract, jaccard_join, licenses, packing, ppm, quality, sharding,
                          toxicity, url_reputation, variants)
from leadloom.llm.labels import remainder

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS place,
                  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
""")
def op1(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@query("op2_quality_ranking")
def op2(spark, sf_dir):
    known = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    out = quality.score(table(spark, sf_dir, "documents"), known)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op3_binary_packing")
def op3(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"), special=True)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_site_templates")
def op4(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '[^\x20\x09-\x0D]+')"


@query("op5_jaccard_join", rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
     links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
     reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
     least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)
""")
def op5(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


FOLDED = rf"translate(coalesce(text, ''), '{url_reputation.UPPER}', '{url_reputation.LOWER}')"


@query("op6_decontaminate", rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     iw AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     item AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
     wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
              FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
     sizes AS (SELECT DISTINCT n FROM wins),
     hits AS (SELECT doc_id, p, n, item_id FROM
              (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM
                (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes)) JOIN wins USING (n, win)),
     spots AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id),
     found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids
               FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def op6(spark, sf_dir):
    out = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_hit = decontaminate.hit_words("runs")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


RULES = [url_reputation.Rule("allow", "org", "/"), url_reputation.Rule("block", "example.org", "/es/"),
         url_reputation.Rule("block", "example.org", "/en/1"), url_reputation.Rule("allow", "com", "/fr/"),
         url_reputation.Rule("block", "com", "/de/")]


def _strength(table):
    return f"""
    (SELECT CASE WHEN rho > 1 / 1001.0::double THEN greatest(1.0::double, 1 / rho - 1) ELSE 1000.0::double END FROM (
       SELECT CASE WHEN bottom > 0 THEN (spread - chance * (m - 1)) / bottom END AS rho FROM (
         SELECT m, kk - k * (k / n) AS spread, (k / n) * (1 - k / n) AS chance,
                (k / n) * (1 - k / n) * (n - nn / n - (m - 1)) AS bottom FROM (
           SELECT count(*)::double AS m, sum(n)::double AS n, sum(k)::double AS k, sum(n * n)::double AS nn,
                  sum((k * k)::double / n) AS kk FROM {table} WHERE n > 0))))"""


@query("op7_url_reputation", rf"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
                  '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
     r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
        ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
     judged AS (SELECT p.*, (SELECT struct_pack(rule := rhost || rpath, verdict := verdict) FROM r
                  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
                  ORDER BY length(rhost || rpath) DESC LIMIT 1) AS hit FROM p),
     hosts AS (SELECT host, count(hit.verdict) AS n, count(*) FILTER (hit.verdict = 'block') AS k,
                  string_split(host, '.') AS parts FROM judged GROUP BY host),
     named AS (SELECT host, n, k, CASE WHEN array_to_string(parts[-2:], '.') IN ('co.uk', 'com.au', 'co.jp', 'com.br') THEN 2 ELSE 1 END AS s,
                  parts FROM hosts),
     placed AS (SELECT host, n, k, array_to_string(parts[-s:], '.') AS suffix, array_to_string(parts[-(s + 1):], '.') AS domain FROM named),
     domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM placed GROUP BY ALL),
     suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
     strengths AS (SELECT {_strength('suffixes')} AS s1, {_strength('domains')} AS s2, {_strength('placed')} AS s3,
                  (SELECT (sum(k) + 0.5::double) / (sum(n) + 1) FROM suffixes) AS p),
     at_suffix AS (SELECT suffix, (k + s1 * p) / (n + s1) AS suffix_mean FROM suffixes, strengths),
     at_domain AS (SELECT domain, (k + s2 * suffix_mean) / (n + s2) AS domain_mean FROM domains JOIN at_suffix USING (suffix), strengths),
     ab AS (SELECT host, k + s3 * domain_mean AS a, n - k + s3 * (1 - domain_mean) AS b FROM placed JOIN at_domain USING (domain), strengths),
     known AS (SELECT host, a / (a + b) - 1.645::double * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS lower FROM ab)
SELECT page_id, url, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN lower > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN known USING (host)
""")
def op7(spark, sf_dir):
    return url_reputation.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "url", "host", "path", "rule", "verdict")


@query("op8_toxicity")
def op8(spark, sf_dir):
    known = table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    out = toxicity.score(table(spark, sf_dir, "documents"), known)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op9_ppm_score")
def op9(spark, sf_dir):
    out = ppm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def _crc_table():
    """The 256 remainders of the checksum's polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


#: crc32 of UTF-8 text in SQL, byte by byte; ``x`` is the list of the hexadecimal digits of the text.
CRC32 = f"""
xor(4294967295::bigint, list_reduce(
    list_transform(range(0, len(x) // 2), lambda i: 16 * instr('123456789ABCDEF', x[2 * i + 1]) + instr('123456789ABCDEF', x[2 * i + 2])),
    lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b::bigint) & 255) + 1]::bigint), 4294967295::bigint))"""


@query("op10_interleaved_shards", f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS source, strlen(coalesce(text, '')) + 1 AS size, string_split(hex(coalesce(text, '')), '') AS x,
                  CAST('0x' || substr(md5('0|' || coalesce(doc_id::varchar, 'null')), 1, 15) AS bigint) AS hash FROM documents),
     c AS (SELECT doc_id, source, size, hash, CASE WHEN size = 1 THEN 0 ELSE {CRC32} END AS crc,
                  CAST('0x' || substr(md5('0|source|' || source), 1, 15) AS bigint)::double / 1152921504606846976::double AS shift FROM d),
     r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id, crc, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total FROM c),
     p AS (SELECT *, row_number() OVER (ORDER BY (rank + shift) / total, source, hash, doc_id, crc, size) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size::bigint AS size, crc::bigint AS text_crc32, 'rows' AS law, (place * 8 // n)::integer AS shard,
       (place - ((place * 8 // n) * n + 7) // 8)::bigint AS slot, NULL::integer AS grown_shard FROM p
""")
def op10(spark, sf_dir):
    out = sharding.interleave(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _rows(rows):
    """A list of tuples as the rows of SQL's VALUES."""
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


PERCENT, SLACK = 90, 25
_SHAPES = [(k, label, *licenses.shape(notice, PERCENT, SLACK)) for k, (label, notice) in enumerate(licenses.TEMPLATES)]
_PHRASES = [(k, label, phrase, len(phrase.split())) for k, (label, phrase) in enumerate(licenses.PHRASES)]


@query("op11_license_scan", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     phrase(pid, label, phrase, n) AS (VALUES {_rows(_PHRASES)}),
     base AS (SELECT doc_id, label, p - 1 AS place FROM
                (SELECT doc_id, w, pid, label, phrase, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, phrase)
              WHERE w[p:p + n - 1] = string_split(phrase, ' ')),
     bases AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM base GROUP BY doc_id),
     notice(tid, label, m, need, width) AS (VALUES {_rows([(k, label, len(t), need, width) for k, label, t, need, width in _SHAPES])}),
     token(tid, word) AS (VALUES {_rows([(k, w.decode()) for k, _, t, _, _ in _SHAPES for w in t])}),
     member AS (SELECT doc_id, tid, p, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) JOIN token USING (word)),
     many AS (SELECT doc_id, tid FROM member JOIN notice USING (tid) GROUP BY doc_id, tid, need HAVING count(DISTINCT word) >= need),
     able AS (SELECT member.* FROM member JOIN many USING (doc_id, tid)),
     held AS (SELECT a.doc_id, a.tid, a.p, count(DISTINCT b.word) AS k FROM able a JOIN notice USING (tid)
              JOIN able b ON b.doc_id = a.doc_id AND b.tid = a.tid AND b.p >= a.p AND b.p < a.p + width GROUP BY ALL),
     block AS (SELECT doc_id, label, k / m::double AS share FROM held JOIN notice USING (tid) WHERE k >= need),
     scores AS (SELECT doc_id, max(share) AS score FROM block GROUP BY doc_id),
     base_list AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id),
     list AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM
                (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM block) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(score, 0)::double END AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN scores USING (doc_id) LEFT JOIN base_list USING (doc_id) LEFT JOIN list USING (doc_id)
""")
def op11(spark, sf_dir):
    out = licenses.scan(table(spark, sf_dir, "documents"), percent=PERCENT, slack=SLACK, carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")


@query("op12_token_alignment")
def op12(spark, sf_dir):
    out = alignment.link_scores(table(spark, sf_dir, "documents"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("op13_spelling_variants", rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS n FROM
                       (SELECT doc_id, unnest(regexp_extract_all({FOLDED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
     sums AS (SELECT run, n, {CRC32} AS h FROM (SELECT run, n, string_split(hex(coalesce(doc_id::varchar, '') || ':' || run), '') AS x FROM r)),
     cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums),
     v AS (SELECT word, sum(n)::bigint AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     less AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM v)),
     pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b USING (p, rest) WHERE a.word <> b.word
               UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON b.word = a.rest
               UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON b.word = a.rest),
     near AS (SELECT word, count(*) AS n_near, max(m) AS most FROM pairs GROUP BY word),
     best AS (SELECT word, n_near, most, min(other) AS other FROM pairs JOIN near USING (word) WHERE m = most GROUP BY ALL),
     formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN other END AS form,
                       CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
     walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL),
     ends AS (SELECT w.word, w.at AS root FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
""")
def op13(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))
