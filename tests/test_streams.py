"""Streaming jobs: late rows, bounded state, repeated batches."""

import datetime as dt

from pyspark.sql import functions as F

from leadloom.streaming import jobs as J

START = dt.datetime(2024, 1, 1)


def interactions(spark, rows):
    return spark.createDataFrame([(u, b, START + dt.timedelta(hours=h)) for u, b, h in rows], "uid string, behavior string, ts timestamp")


def windows(spark, path):
    return {(r["uid"], r["window_start"].day if r["window_start"].month == 1 else r["window_start"].day - 31): (r["hot_score"], r["events"])
            for r in J.rolling_interactions(spark.read.parquet(f"{path}/panes")).collect()}


def test_panes_add_up_and_late_rows_are_counted(spark, tmp_path):
    path, write = str(tmp_path), J.pane_batch(str(tmp_path))
    write(interactions(spark, [("a", "comment", 1), ("a", "share", 30), ("", "tag", 2), ("b", "tag", 5)]), 0)
    second = interactions(spark, [("a", "comment", 24 * 9 + 1), ("a", "tag", 26), ("b", "like", 3)])
    for _ in range(2):  # a repeated batch replaces its own rows and counts
        write(second, 1)
    write(interactions(spark, [("a", "comment", 40), ("b", "tag", 24 * 7 + 5), ("b", "tag", 24 * 8 + 5)]), 2)
    counts = {r["batch"]: (r["accepted"], r["late"]) for r in J.pane_counts(spark, path).collect()}
    # newest before batch 1: hour 30, so days that ended before hour 6 are closed: none; before batch 2: day 9, so days up to 7 (hour 192) are closed
    assert counts == {0: (3, 0), 1: (3, 0), 2: (1, 2)}
    got = windows(spark, path)
    assert got["a", 1] == (7.5, 3) and got["a", 2] == (4.5, 2) and got["b", 1] == (3.0, 2)
    assert got["a", 10] == (3.0, 1) and got["b", 9] == (2.5, 1) and ("b", 8) in got and got["b", 8] == (2.5, 1)


def test_an_empty_batch_of_panes(spark, tmp_path):
    write = J.pane_batch(str(tmp_path))
    write(interactions(spark, []), 0)
    write(interactions(spark, [("a", "tag", 1)]), 1)
    assert [(r["batch"], r["accepted"], r["late"]) for r in J.pane_counts(spark, str(tmp_path)).orderBy("batch").collect()] == [(0, 0, 0), (1, 1, 0)]


def test_state_of_sessions_does_not_grow(spark, tmp_path):
    """Thirty days of chats are landed one by one: closed sessions leave the state."""
    schema = "conv_id long, sender string, ts timestamp"
    state = []
    for day in range(30):
        rows = [(100 * day + i, "customer", START + dt.timedelta(days=day, minutes=i)) for i in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
        if day % 3 < 2:
            continue
        stream = J.chat_sessions(J.read_stream(spark, f"{tmp_path}/landing", spark.createDataFrame([], schema).schema))
        reports = J.run_available(stream, f"{tmp_path}/checkpoint", J.batch_writer(f"{tmp_path}/out"))
        state.append(reports[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(state) <= 5 * 20 and state[-1] <= state[0] + 20  # 600 conversations were seen
    closed = spark.read.parquet(f"{tmp_path}/out")
    totals = J.conversation_totals(closed)
    assert closed.count() == totals.count() >= 500 and totals.agg(F.sum("messages")).first()[0] == closed.count()


def test_a_key_of_long_ago_is_still_known(spark, tmp_path):
    write = J.fresh_keys(str(tmp_path), 8)
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "lead_key string")
    write(keys("old", "x", "x", None), 0)  # 400 days before the next batch, for all the store knows
    write(keys("old", "new", "new"), 1)
    write(keys("old", "new", "new"), 1)
    write(keys(), 2)
    write(keys("x", "y"), 3)
    fresh = {(r["batch"], r["lead_key"]) for r in spark.read.parquet(f"{tmp_path}/fresh").collect()}
    assert fresh == {(0, "old"), (0, "x"), (1, "new"), (3, "y")}
