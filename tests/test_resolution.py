"""Resolution against a plain Python account of the rules, on a small skewed fixture."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import resolve as R

SCHEMA = ("file_name STRING, pos BIGINT, raw_name STRING, raw_phone STRING, raw_email STRING, raw_address STRING, raw_source STRING, "
          "raw_campaign STRING, raw_note STRING, raw_uid STRING, raw_link STRING, file_date DATE")


def fixture_rows(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        phone = "0912345678" if i % 3 == 0 else rng.choice(["", None, "nan", "0281234567", f"09{rng.randint(10, 14)}000000", f"+8432{rng.randint(1000000, 1000009)}"])
        email = rng.choice(["", "nan", "bad", f"u{rng.randint(0, 9)}@x.vn"])
        rows.append((rng.choice(["Vinhomes a.csv", "random b.csv", "HSBC c.csv"]), i, rng.choice(["", "an b", "NGUYEN C"]), phone, email,
                     rng.choice(["", "Hà Nội", "12 Lê Lợi, Huế"]), "", "", "", rng.choice(["", "100012345678901"]), "", None))
    return rows


def expected(rows):
    seen, status, groups = set(), {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        phone_text = (row[3] or "").strip()
        has_phone = phone_text not in ("", "nan")
        phone = None
        if has_phone:
            digits = phone_text.replace("+84", "0")
            phone = digits if digits[:3] in ("091", "032") and len(digits) == 10 else None
        email = row[4] if "@" in row[4] else None
        if has_phone and not phone:
            status[row[1]] = "invalid_phone"
        elif not has_phone and not email:
            status[row[1]] = "missing_contact"
        else:
            key = phone or email
            status[row[1]] = "duplicate" if key in seen else "valid"
            seen.add(key)
            groups.setdefault(key, []).append((row, phone, email))
    golden = {}
    for key, members in groups.items():
        merged = members if members[0][1] else members[:1]
        golden[key] = (next((m[2] for m in merged if m[2]), ""), next((m[0][2].title() for m in merged if m[0][2]), ""),
                       len({m[0][0] for m in merged}), max((m[0][5] for m in merged), key=len))
    return status, golden


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_against_plain_python(spark, partitions):
    rows = fixture_rows()
    status, golden = expected(rows)
    shuffled = rows[:]
    random.Random(int(partitions)).shuffle(shuffled)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        keyed = R.lead_keys(R.clean(spark.createDataFrame(shuffled, SCHEMA).repartition(int(partitions) % 7 + 1)))
        got = {r["pos"]: r["status"] for r in R.mark_status(keyed).select("pos", "status").collect()}
        contacts = {r["lead_key"]: (r["email"], r["name"], r["source_count"], r["address"]) for r in R.golden(keyed).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == status
    assert contacts == golden


def test_leads_and_rejects_are_all_rows(spark):
    marked = R.mark_status(R.lead_keys(R.clean(spark.createDataFrame(fixture_rows(), SCHEMA))))
    assert R.new_leads(marked).count() + R.rejects(marked).count() == 240
    total = R.ingest_stats(marked).filter("file_name IS NULL").first()
    assert total["total_rows"] == 240 == sum(total[s] for s in R.STATUSES)


def test_history_makes_first_rows_duplicates(spark):
    keyed = R.lead_keys(R.clean(spark.createDataFrame(fixture_rows(), SCHEMA)))
    history = spark.createDataFrame([("0912345678",)], "lead_key STRING")
    marked = R.mark_status(keyed, history).filter("lead_key = '0912345678'")
    assert {r["status"] for r in marked.select("status").distinct().collect()} == {"duplicate"}


def test_upsert_of_parts_equals_one_ingest(spark):
    keyed = R.lead_keys(R.clean(spark.createDataFrame(fixture_rows(), SCHEMA)))
    old, new = keyed.filter("file_name < 'R'"), keyed.filter("file_name >= 'R'")
    merged = R.upsert(R.golden(old), R.golden_files(old), R.golden(new), R.golden_files(new))
    cols = ["lead_key", "phone", "email", "name", "uid", "address", "source_tier", "source_count"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert key(merged) == key(R.golden(keyed))


def test_long_lists_keep_their_members(spark):
    names = spark.range(50).select(F.lit("a").alias("lead_key"), F.concat(F.lit("n"), "id").alias("name")).union(
        spark.createDataFrame([("b", "x"), ("b", "y")], "lead_key STRING, name STRING"))
    got = {r["lead_key"]: (r["all_names_count"], r["all_names"]) for r in R.joined_list(names, "name", "all_names", limit=10).collect()}
    assert got == {"a": (50, None), "b": (2, "x, y")}


def test_reconcile_across_files(spark):
    rows = spark.createDataFrame([("f1", 1, "u1", "An", None), ("f2", 1, "u1", "", "0912345678"), ("f1", 2, "u2", "Bo", None), ("f1", 3, "u2", "Be", None)],
                                 "file_name STRING, pos INT, uid STRING, name STRING, phone STRING")
    assert {(r["file_name"], r["uid"], r["name"], r["status"]) for r in R.reconcile(rows).collect()} == {
        ("f1", "u1", "An", "no_phone"), ("f2", "u1", None, "no_name"), ("f1", "u2", "Be", "no_phone")}
    assert {(r["uid"], r["status"]) for r in R.reconcile(rows, per=[]).collect()} == {("u1", "mapped"), ("u2", "no_phone")}


def test_a_listed_number_is_judged_once(spark):
    """Validity is computed after the listings of a number are counted, and changes no result."""
    from leadloom.operators import enrich as E

    rows = spark.createDataFrame([(i, p, f"k{i}", "u", None) for i, p in enumerate(["+84912345678"] * 3 + ["+84212345678", "junk", None, "+84912345679"])],
                                 "id long, phone string, keyword string, source_url string, scraped_at timestamp")
    scores = E.listing_scores(rows)
    assert sorted((r["phone"], r["hot_score"], r["listings"], r["id"], r["keyword"]) for r in scores.collect()) == [
        ("+84912345678", 4.0, 3, 0, "k0"), ("+84912345679", 3.0, 1, 6, "k6")]
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan.split("Aggregate", 1)[1].split("\n", 1)[1]  # nothing below the aggregate reads phones


def test_rows_are_not_moved_to_their_files(spark):
    """Files are classified first; rows meet the few of them where they are."""
    rows = spark.range(1_000_000).selectExpr(
        "concat('file ', id % 7, '.csv') AS file_name", "id AS pos", "concat('an ', id) AS raw_name", "concat('09100', id % 90000 + 10000) AS raw_phone",
        "'' AS raw_email", "'Huế' AS raw_address", "'' AS raw_source", "'' AS raw_campaign", "'' AS raw_note", "'' AS raw_uid", "'' AS raw_link",
        "CAST(NULL AS DATE) AS file_date")
    plan = R.golden(R.lead_keys(R.clean(rows)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(_key" not in plan


def test_ties_of_values_within_and_between_files(spark):
    rows = [("b.csv", 1, "an", "0912345678", "", "12 Huế", "s1", "", "n1", "", "", None), ("b.csv", 2, "binh", "0912345678", "b@x.vn", "34 Huế", "s2", "", "n2", "", "l2", None),
            ("a.csv", 9, "", "0912345678", "a@x.vn", "56 Huế", "s3", "", "n3", "u3", "", None), (None, 3, "", "0912345678", "", "", "", "", "", "", "", None),
            ("c.csv", 1, "", "", "only@x.vn", "", "", "", "", "", "", None), ("a.csv", 5, "sau", "", "only@x.vn", "", "", "", "", "", "", None)]
    got = {r["lead_key"]: r.asDict() for r in R.golden(R.lead_keys(R.clean(spark.createDataFrame(rows, SCHEMA)))).collect()}
    one = got["0912345678"]
    assert (one["name"], one["email"], one["uid"], one["link"], one["address"]) == ("An", "a@x.vn", "u3", "l2", "56 Huế")
    assert (one["source_count"], one["file_source"], one["note"]) == (2, None, "")  # a row without a file is none more
    assert (got["only@x.vn"]["name"], got["only@x.vn"]["source_count"], got["only@x.vn"]["file_source"]) == ("Sau", 1, "a.csv")


def test_leads_read_interactions_once(spark, sf_dir):
    """Matched leads are written once, not computed for each of their uses."""
    from leadloom.plans import reports as RP

    assert "event_id" not in RP.leads(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_people_scores_equal_those_of_all_interactions(spark):
    from leadloom.operators import enrich as E

    rows = [(i, str(i % 7), [None, "", "comment", "like", "share"][i * 3 % 5], "k", "u", f"2024-01-{1 + i % 30:02d}") for i in range(200)] + [(900, "", "tag", "k", "u", "2024-01-30"), (901, "8", None, "k", "u", "2024-01-30")]
    table = spark.createDataFrame(rows, "event_id LONG, uid STRING, behavior STRING, keyword STRING, source_url STRING, ts STRING").withColumn("ts", F.col("ts").cast("timestamp"))
    people = spark.createDataFrame([(f"+8491000000{i}", str(i)) for i in range(9)], "profile_key STRING, uid STRING")
    pad = {"keyword": F.lit(None).cast("string")}
    every, one = (E.hot_by_profile(E.match_hot_leads(hot, people)) for hot in (E.social_hot_leads(table, "2024-01-31"), E.social_hot_uids(table, "2024-01-31").withColumns(pad)))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, one.collect())) and every.count() == 8


def test_contacts_are_merged_in_one_shuffle(spark, monkeypatch):
    """Rows go to their key once, with their files as numbers; many files, or more than one word of them, give the same contacts."""
    files = [f"file {i * 37 % 101:03d} {w}.csv" for i, w in zip(range(101), ["Techcombank", "Audi Lexus", "gym", "mobifone"] * 26)]
    rows = [(files[i * 29 % 101] if i % 50 else None, i, ["", "an", "binh  le", "nan"][i % 4], f"09123456{i % 40 + 10}" if i % 9 else "", f"u{i % 13}@x.vn" if i % 3 else "",
             ["", "Huế", "12 Lê Lợi, Huế"][i % 3], f"s{i}", "", f"n{i}", ["", f"u{i}"][i % 2], "", None) for i in range(1500)]
    keyed = R.lead_keys(R.clean(spark.createDataFrame(rows, SCHEMA)))
    once = R.golden(keyed)
    assert once._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning(lead_key") == 1
    monkeypatch.setattr(R, "COUNTED_FILES", 0)
    by_file = R.golden(keyed)
    assert by_file._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning(lead_key") == 2
    assert once.dtypes == by_file.dtypes
    assert sorted(map(repr, once.collect())) == sorted(map(repr, by_file.collect()))
    assert max(r["source_count"] for r in once.collect()) > 20
    monkeypatch.undo()
    assert R.golden(keyed.filter("false")).collect() == []


def test_scoring_contacts_stays_below_the_compiled_size(spark, sf_dir):
    """Java compiles no method of more than 8,000 bytes."""
    import re

    from leadloom.plans import contacts as PC

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = PC.scored(spark, sf_dir).select("lead_key", "unified_score", "source_tier", "source_count", "source_weight", "province", "uid")
        code = spark._jvm.PythonSQLUtils.explainString(scored._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_feature_tables_hold_no_texts(spark, sf_dir):
    """The features of profiles are those of the whole leads, but no name, note or keyword is written for them."""
    from leadloom.operators import enrich as E
    from leadloom.plans import reports as RP

    few = RP.features(spark, sf_dir)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, E.features(RP.leads(spark, sf_dir)).collect()))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "phone" in plan and not any(f"{x}#" in plan for x in ("name", "address", "note", "keyword", "source_url", "seen_at"))
