from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.operators import common as C


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def skewed(spark, n=3000):
    """A third of the rows hold one key, some hold none."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 17 == 0, None).otherwise(F.concat(F.lit("k"), i % 200))
    return spark.range(n).withColumn("k", key)


def test_join_dimension_equals_plain_join(spark):
    big = skewed(spark)
    small = big.groupBy("k").agg(F.max("id").alias("m")).filter("k <> 'k7'")
    for how in ("left", "inner"):
        assert rows_of(C.join_dimension(big, small, "k", ["id"], how).select("id", "k", "m")) == rows_of(big.join(small, "k", how).select("id", "k", "m"))
    assert rows_of(C.join_dimension(big, small.select("k"), "k", ["id"], "left_anti")) == rows_of(big.join(small, "k", "left_anti").select("id", "k"))
    numbers = big.select("id", (F.col("id") % 5).alias("k"))
    assert C.join_dimension(numbers, numbers.groupBy("k").agg(F.count("*").alias("m")), "k", ["id"]).filter("m = 600").count() == 3000


def test_rows_without_key_are_spread(spark):
    big = spark.range(3000).select("id", F.lit(None).cast("string").alias("k"))
    small = spark.createDataFrame([("a", 1)], "k STRING, m INT")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = C.join_dimension(big, small, "k", ["id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3000 and max(sizes) < 1000


def test_joins_are_lazy(spark):
    from leadloom.operators import enrich as E
    from leadloom.plans.views import load

    sf, tracker = "/root/testdata/sf0.001", spark.sparkContext.statusTracker()
    interactions, listings = load(spark, sf, "v_interactions"), load(spark, sf, "v_listings")
    people = spark.createDataFrame([("+84912345678", "1")], "profile_key STRING, uid STRING")
    spark.sparkContext.setJobGroup("lazy", "plan building")
    try:
        hot = E.social_hot_leads(interactions, "2024-01-31").unionByName(E.listing_hot_leads(listings))
        E.hot_by_profile(E.match_hot_leads(hot, people))
        assert not tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_blocked_windows_equal_plain_windows(spark):
    rows = skewed(spark, 900).filter("k IS NOT NULL").withColumn("v", F.col("id") * 7 % 11)
    plain = Window.partitionBy("k").orderBy("id")
    want = rows.select("id", F.lag("v").over(plain).alias("p"), F.row_number().over(plain).alias("n"))
    for block in (7, 100, 10000):
        lagged = C.blocked_lag(rows, "k", "id", F.struct("v"), "p", block).select("id", F.col("p.v").alias("p"))
        numbered = C.blocked_row_number(rows, "k", "id", "n", block).select("id", "n")
        assert rows_of(lagged.join(numbered, "id").select("id", "p", "n")) == rows_of(want)


def test_numbered_and_top_per_key(spark):
    rows = skewed(spark, 600).filter("k IS NOT NULL").withColumn("s", F.col("id") % 5)
    numbered = C.numbered(rows, [F.desc("s"), F.asc("id")], "n")
    want = rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("s"), "id")))
    assert rows_of(numbered.select("id", "n")) == rows_of(want.select("id", "n"))
    top = C.top_per_key(rows, "k", [F.desc("s"), "id"], 3, F.col("id"), salts=5)
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "id"))).filter("rank <= 3")
    assert rows_of(top.select("id", "rank")) == rows_of(plain.select("id", "rank"))


def test_computed_once_keeps_filters_above(spark):
    rows = C.computed_once(spark.range(10), {"h": F.sha2(F.col("id").cast("string"), 256)}).filter("h LIKE 'a%'")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1


def test_chat_text_in_chunks_equals_joined_text(spark):
    from leadloom.operators import intent as I

    words = ["căn", "hộ", "giá", "bao nhiêu", "5", "tỷ", "", "x" * 30, "số 0912345678", "a@b.vn"]
    texts = [(c, i, "customer" if i % 2 else "agent", words[(c * 3 + i * 7 + i // 5) % len(words)]) for c in range(6) for i in range(40 + c)]
    rows = spark.createDataFrame(texts, "conv_id INT, idx INT, sender STRING, text STRING")
    want = {}
    for c in range(6):
        joined = " ".join(t[3] for t in texts if t[0] == c)
        row = spark.createDataFrame([(joined,)], "t STRING").select(I.T.chat_intent(F.col("t")).alias("s")).first()
        want[c] = (joined[:100], row["s"])
    sparse = rows.withColumn("idx", F.col("idx") * 100_003)
    for block, rows in ((3, rows), (1000, rows), (3, sparse)):
        chunks = I.chat_chunks
        I.chat_chunks = lambda m, k, b=block: chunks(m, k, b)
        try:
            got = {r["conv_id"]: (r["full_text"], r["intent_score"]) for r in I.chat_leads(rows, stored_chars=100).collect()}
        finally:
            I.chat_chunks = chunks
        assert got == want, block
