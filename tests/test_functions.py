import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.functions import dates as DT
from leadloom.functions import numbers as N
from leadloom.functions import phones as P
from leadloom.functions import sql
from leadloom.functions import text as T
from leadloom.operators import intent as I
from leadloom.operators import score as S


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r["r"] for r in rows.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_phone_e164(spark):
    cases = {"0912345678": "+84912345678", "84912345678": "+84912345678", "+84912345678": "+84912345678",
             "912345678": "+84912345678", "0281234567": None, "01234567890": None, "090 1234 567": "+84901234567",
             "0961 234 567": "+84961234567", "9.12345678E+08": "+84912345678", "912345678.0": "+84912345678",
             "0912.345678": None, "0912.345.678": "+84912345678", "": None, "841234567": "+84841234567", "8412345678": None}
    assert apply(spark, P.phone_e164, list(cases)) == list(cases.values())
    assert apply(spark, P.phone_local, ["+84912345678", "x"]) == ["0912345678", None]


def test_phone_is_idempotent(spark):
    once = [p for p in apply(spark, P.phone_e164, ["0912345678", "+84 32 123 45 67", "70-1234567"]) if p]
    assert once and apply(spark, P.phone_e164, once) == once


def test_other_phone_variants(spark):
    assert apply(spark, P.phone_series, ["0512345678", "84512345678", "9.1e8", "9.1E+08", "0212345678", None]) == [
        "0512345678", "0512345678", None, "0910000000", None, None]
    assert apply(spark, P.phone_loose, ["84912345678", "912345678", "0912 345 678 9", "12345"]) == [
        "0912345678", "0912345678", "09123456789", None]
    assert apply(spark, P.lookup_text, [" 84938 000.111 ", "+84938000111", "938000111", "An Nguyen"]) == [
        "0938000111", "0938000111", "0938000111", "AnNguyen"]


def test_province_of_phone(spark):
    assert apply(spark, P.province_from_phone, ["0912345678", "02812345678", "02412345678", "023612345", "", None, "0290123456", "842612345"]) == [
        "Unknown", "TP. Ho Chi Minh", "Ha Noi", "Da Nang", "Unknown", "Unknown", "Ca Mau", "Unknown"]


def test_phones_in_text_and_html(spark):
    assert apply(spark, P.phones_in_text, ["Gọi 0912-345 678 hoặc +84912345678, 032 1234567"]) == [["+84912345678", "+84321234567"]]
    page = '<script>0912345678</script><a href="tel:0987654321">x</a> <b>0912 345 679</b><footer>0911111111</footer>'
    assert apply(spark, lambda c: P.phones_in_body(P.html_body(c)), [page]) == [["+84987654321", "+84912345679"]]


def test_names_and_emails(spark):
    assert apply(spark, T.name_clean, ["  nguyễn  VĂN\tan ", "NaN", None, "None"]) == ["Nguyễn Văn An", "", "", ""]
    assert apply(spark, T.email_clean, [" A.b@X.com ", "a@b", "", None]) == ["a.b@x.com", None, None, None]
    assert apply(spark, T.name_first, ["Nguyen Van A"]) == ["A"] and apply(spark, T.name_last, ["Nguyen Van A", "A"]) == ["Nguyen Van", ""]


# fixed values: file names and the tiers they must get
FILES = [("DSKH NGAN HANG HSBC TIET KIEM.xls", "banking_vip"), ("KH VPBank Priority Banking 2024.xlsx", "banking_vip"),
         ("100 Villa Sai Gon Pearl Vinhomes.xls", "real_estate_vip"), ("Chung Cu Masteri The Tresor.xlsx", "real_estate_vip"),
         ("DS CEO GIAM DOC HCM 2000 KH.xlsx", "ceo_director"), ("BMW Mercedes Lexus Owner List.xls", "automotive_vip"),
         ("CHUNG KHOAN SSI Top NHA DAU TU.xlsx", "stock_gold"), ("King Fitness InBody 500 KH.xlsx", "fitness_health"),
         ("Vietnamwork DS Ung Vien Senior.xlsx", "education_hr"), ("viettel-tphcm-tra-sau-2023.xls", "telecom_mass"),
         ("mobifone_MOBI_HCM.xlsx", "telecom_mass"), ("random file khong ro nguon.xls", "unknown"), ("50 khach hang chuyen nghiep.xls", "unknown")]


def test_file_tiers(spark):
    got = {r["file_name"]: r for r in T.classify_files(spark.createDataFrame([(f,) for f, _ in FILES], "file_name STRING")).collect()}
    assert {f: got[f]["tier"] for f, _ in FILES} == dict(FILES)
    assert got["DSKH NGAN HANG HSBC TIET KIEM.xls"]["confidence"] == 0.85
    assert got["random file khong ro nguon.xls"]["confidence"] == 0.0


def _scored(spark, weight, count, days, email="a@b.com", name="Nguyen Van A", address="123 Nguyen Hue", **more):
    as_of = "2024-06-01"
    latest = None if days is None else datetime.date(2024, 6, 1) - datetime.timedelta(days=days)
    rows = spark.createDataFrame([("0912345678", email, name, address, weight, count, latest)],
                                 "phone STRING, email STRING, name STRING, address STRING, source_weight DOUBLE, source_count INT, latest_file_date DATE")
    return S.unified_score(rows, as_of, **more).first()


def test_unified_scores(spark):
    vip = _scored(spark, 1.0, 6, 30)
    assert (vip["s_completeness"], vip["s_source_quality"], vip["s_cross_source"], vip["s_recency"]) == (30.0, 25.0, 20.0, 15.0)
    assert vip["unified_score"] == 90.0 and vip["grade"] == "S"
    mass = _scored(spark, 0.40, 1, 500, "", "", "")
    assert mass["unified_score"] == 33.0 and mass["grade"] == "D"
    assert _scored(spark, 0.5, 1, None)["s_recency"] == 5.0
    plain, chat = _scored(spark, 0.5, 2, 60), _scored(spark, 0.5, 2, 60, intent=F.lit(8.0), chat_phone=F.lit(True))
    assert chat["unified_score"] == pytest.approx(plain["unified_score"] + 7.6)
    assert _scored(spark, 0.5, 1, 60)["unified_score"] > _scored(spark, 0.5, 1, 2500)["unified_score"]


def test_rfm(spark):
    rows = spark.createDataFrame([(6, 1.0, 30), (1, 0.25, 2000), (3, 0.65, 200)], "n BIGINT, w DOUBLE, days INT").withColumn(
        "d", F.date_sub(F.lit("2024-06-01").cast("date"), F.col("days")))
    got = [r["s"] for r in rows.orderBy(F.desc("n")).select(S.rfm(F.col("n"), F.col("w"), F.col("d"), "2024-06-01").alias("s")).collect()]
    assert got == [9.6, 6.6, 2.0]


def test_half_up_and_ratios(spark):
    row = spark.range(1).select(N.half_up(F.lit(2.675), 2).alias("a"), N.half_up(F.lit(0.125), 2).alias("b"),
                                N.rate(F.lit(5), F.lit(0), 2).alias("c"), N.rate(F.lit(1), F.lit(3), 2, 100).alias("d")).first()
    assert tuple(row) == (2.68, 0.13, 0.0, 33.33)


def test_chat_timestamps(spark):
    got = apply(spark, lambda c: F.unix_timestamp(DT.chat_timestamp(c)), ["05/01 09:30", "09:30", "2024-01-05T09:30:00", "soon", ""])
    assert got[0] - got[1] == 4 * 86400 and got[2] == 1704447000 and got[3] is None and got[4] is None


def test_signal_snippet_takes_ten_before_and_twenty_after(spark):
    rows = spark.createDataFrame([(1, 0, "customer", "x" * 30 + " đặt cọc " + "y" * 30, "")], "conv_id INT, idx INT, sender STRING, text STRING, ts_text STRING")
    hit = I.extract_signals(rows).filter("label = 'Hỏi đặt cọc'").first()
    assert hit["snippet"] == "..." + "x" * 9 + " đặt cọc " + "y" * 19 + "..."


def test_sql_functions(spark):
    names = sql.register(spark)
    spark.createDataFrame([("84912345678",), ("9.12345678E+08",), ("02812345678",), (" A@b.vn",), ("fb/100012345678",), (None,)], "v STRING").createOrReplaceTempView("sql_values")
    for name, fn in (("phone_e164", P.phone_e164), ("phone_local", P.phone_local), ("phone_valid", P.phone_valid), ("email_clean", T.email_clean),
                     ("uid_extract", T.uid_extract), ("phone_province", P.province_from_phone)):
        assert name in names
        got = spark.sql(f"SELECT v, {name}(v) AS r FROM sql_values").collect()
        want = spark.table("sql_values").select("v", fn(F.col("v")).alias("r")).collect()
        assert got == want, name


def test_short_cuts_of_cleaning_change_nothing(spark):
    """Texts that need no regular expression are told by cheaper tests, with the same results."""
    from leadloom import dictionaries as D
    from leadloom.functions import phones as P

    odd = [None, "", " ", "nan", "NaN ", " nan\n", "nan\r\n", "nan\u2028", "nanx", "nan nan", "  a  b ", "a\tb", "a\nb\x0bc\fd\re", "\u00a0a\u00a0 b", "N/A", "none", "İ", "Lê  Văn",
           "9.1E+08", "910000000.0", "+84.5e3", "84 910 000 000", "0910-000.000", "1e5", "E5", ".5", "5.", "09e", "0910000000"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id INT, t STRING")
    t, raw = F.col("t"), F.coalesce(F.col("t"), F.lit(""))
    blank = F.nullif(F.regexp_replace(F.trim(t), "(?i)^nan$", ""), F.lit(""))
    name = F.when(F.lower(raw).isin(D.NULL_NAME_WORDS), F.lit("")).otherwise(F.initcap(F.trim(F.regexp_replace(raw, r"\s+", " "))))
    whole = F.coalesce(t.try_cast("double").try_cast("bigint").cast("string"), F.lit(""))
    want = rows.select("id", blank, name, *[F.when(t.rlike(form), whole).otherwise(t) for form in (P._FLOAT_TEXT, P._SIGNED_EXPONENT)])
    got = rows.select("id", T.blank_to_null(t), T.name_clean(t), *[P._whole_number(t, form) for form in (P._FLOAT_TEXT, P._SIGNED_EXPONENT)])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [tuple(r) for r in want.orderBy("id").collect()]


def test_province_is_the_first_name_of_the_list(spark):
    from leadloom import dictionaries as D

    def plain(place):
        for label, words in D.PROVINCE_PRIORITY:
            if any(w in place for w in words):
                return label
        return next((D.PROVINCE_ALIASES.get(n, n) for n in D.PROVINCE_NAMES if n.lower() in place), "Unknown")

    places = ["", "12 lê lợi", "tp hcm", *[n.lower() for n in D.PROVINCE_NAMES], *[f"{a.lower()}, {b.lower()}" for a, b in zip(D.PROVINCE_NAMES, D.PROVINCE_NAMES[7:] + D.PROVINCE_NAMES[:7])]]
    rows = spark.createDataFrame([(p,) for p in places], "p STRING")
    assert {r[0]: r[1] for r in rows.select("p", T.province_in("p")).collect()} == {p: plain(p) for p in places}
    assert rows.select(T.province_in("p"))._jdf.queryExecution().optimizedPlan().toString().count("Contains") <= 1
