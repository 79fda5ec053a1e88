"""Search texts by an inverted index, against the comparison of every text with every contact."""

import random

from pyspark.sql import functions as F

from leadloom.operators import reports as R

SCHEMA = "lead_key string, phone string, email string, name string"


def contacts(spark, n=300):
    r = random.Random(4)
    rows = [(f"k{i}", f"09{i:08d}" if i % 5 else None, f"u{i}@x.vn" if i % 3 else "", "".join(r.choice("abÁđ C") for _ in range(r.randrange(9))).strip() or None)
            for i in range(n)]
    return spark.createDataFrame([*rows, ("a", None, "", "Anna Maria"), ("b", None, "", "ANNA"), ("c", None, "", "")], SCHEMA)


def test_table_of_texts_equals_the_list(spark):
    r = random.Random(5)
    texts = ["anna", "NNA", "a", "Áđ", "0900000007", "+84900000008", "u7@x.vn", "nothing like it", "an", "áđ", "maria anna"]
    texts += ["".join(r.choice("abÁđC") for _ in range(r.randrange(1, 6))) for _ in range(80)]
    table = spark.createDataFrame([(t,) for t in [*texts, *texts[:5], "", "  ", None]], "query string")
    df = contacts(spark)
    written = spark.createDataFrame([("a", "09 0000"), ("k3", "nothing")], "lead_key string, raw_phone string")
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    got = rows(R.lookup_texts(df, table, written))
    assert got == rows(R.lookup(df, list(dict.fromkeys(texts)), written).distinct()) and len(got) > 200
    assert rows(R.lookup_texts(df, table.limit(0))) == [] and rows(R.lookup_texts(df.limit(0), table)) == []


def test_no_text_meets_all_names(spark):
    """20,000 texts and 20,000 names: the candidates stay near the matches."""
    names = spark.range(20_000).select(F.concat(F.lit("lead "), F.md5(F.col("id").cast("string"))).alias("name"))
    texts = spark.range(20_000).select(F.substring(F.md5(F.col("id").cast("string")), 5, 8).alias("q"))
    df = names.select(F.col("name").alias("lead_key"), F.lit(None).cast("string").alias("phone"), F.lit("").alias("email"), "name")
    found = R.name_matches(df, texts)
    assert found.count() >= 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pages_by_key_cover_all_rows_once(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(f"k{i:03d}", float(r.randrange(5))) for i in range(137)], "key string, score double")
    order, seen, after = [("score", False), ("key", True)], [], None
    while rows := [tuple(x) for x in R.page_after(df, order, after, 20).select("score", "key").collect()]:
        seen += rows
        after = rows[-1]
    assert seen == sorted(seen, key=lambda x: (-x[0], x[1])) and len(seen) == 137
    plan = R.page_after(df, order, (3.0, "k001"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Filter" in plan
