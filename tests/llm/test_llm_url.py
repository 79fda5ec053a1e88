import pytest

from leadloom.llm.url_reputation import Rule, host_and_path, judge, reputation

RULES = [Rule("allow", "org", "/"), Rule("block", "a.org", "/x/"), Rule("allow", "a.org", "/x/y")]


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "h", 1.0, "v") for r in rows], "page_id long, url string, bad boolean, host string, n double, verdict string")


def test_host_and_path(spark):
    urls = {None: ("", ""), "": ("", ""), "nothing": ("", ""), "http://A.Org": ("a.org", ""), "x://H.de/P/q?x#y": ("h.de", "/P/q"),
            "http://h?q=http://other/": ("h", ""), "h://Ü.EU#z": ("Ü.eu", ""), "http://a://b/c": ("a:", "//b/c")}
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = host_and_path("url")
    assert {r[0]: (r[1], r[2]) for r in frame.select("url", host.alias("h"), path.alias("p")).collect()} == urls


def test_longest_rule_wins(pages):
    rows = [(1, "http://b.org/", None), (2, "http://s.a.org/x/1", None), (3, "http://a.org/x/y1", None), (4, "http://ba.org/x/", None),
            (5, "http://a.org", None), (6, None, None), (6, None, None), (None, "odd", None)]
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in judge(pages(rows), RULES).collect()}
    assert got == {(1, "org/", "allow"), (2, "a.org/x/", "block"), (3, "a.org/x/y", "allow"), (4, "org/", "allow"),
                   (5, None, "allow"), (6, None, "allow"), (None, None, "allow")}
    assert judge(pages(rows), RULES).count() == len(rows) and judge(pages([]), RULES).collect() == []


def test_reputation_shrinks_and_blocks_on_evidence(pages):
    rows, i = [], 0
    for host, bad, good, unknown in (("www.spam.net", 80, 0, 20), ("few.spam.net", 2, 0, 3), ("fresh.spam.net", 0, 0, 4), ("fine.com", 1, 300, 10), ("new.com", 0, 0, 3)):
        for k in range(bad + good + unknown):
            rows.append((i := i + 1, f"http://{host}/{k}", True if k < bad else False if k < bad + good else None))
    frame = pages(rows)
    got = {r["host"]: r for r in judge(frame, [], bad="bad").collect()}
    assert got["www.spam.net"]["verdict"] == "block" and got["fine.com"]["verdict"] == got["new.com"]["verdict"] == "allow"
    assert got["fresh.spam.net"]["bad_rate"] > got["new.com"]["bad_rate"]
    host, _ = host_and_path("url")
    known = {r["host"]: r for r in reputation(frame.select(host.alias("host"), "bad")).collect()}
    assert known["few.spam.net"]["upper"] - known["few.spam.net"]["lower"] > known["www.spam.net"]["upper"] - known["www.spam.net"]["lower"]
    assert (known["fine.com"]["n"], known["fine.com"]["k"], known["fine.com"]["n_pages"], known["fine.com"]["domain"]) == (301, 1, 311, "fine.com")


def test_hot_and_cold_hosts_agree(pages):
    rows = [(i, f"http://{'hot.net' if i % 3 else f'h{i}.com'}/{i}", i % 2 == 0) for i in range(600)]
    a = judge(pages(rows), RULES, bad="bad", hot_share=2).collect()
    b = judge(pages(rows), RULES, bad="bad", hot_share=100_000).collect()
    assert sorted(a) == sorted(b)
