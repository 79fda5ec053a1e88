import random
import re

import pytest

from leadloom.llm import decontaminate


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, bench, width):
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for name, text in bench:
            b = words(text)
            n = min(width, len(b))
            for s in range(len(b) - n + 1 if b else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == b[s:s + n]:
                        hit.update(range(p, p + n))
                        items.add(name)
        out.append((i, len(w), len(hit), sorted(x for x in items if x is not None)))
    return sorted(out, key=str)


def frames(spark, docs, rows, bench):
    return docs(rows), spark.createDataFrame(bench, "item_id string, text string")


@pytest.fixture
def planted(odd_rows):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "Älpha", "beta", "x1", "y", "z"] + [f"w{i}" for i in range(12)])
    bench = [(f"i{k}", " ".join(word() for _ in range(rng.randrange(3, 30)))) for k in range(25)]
    bench += [("short", "Zeta-Omega"), ("empty", " .,"), ("none", None), (None, "one two three four five six"), ("i0", "the of the of the of"),
              ("words", " ".join(f"word{i}" for i in range(300, 340)))]
    rows = list(odd_rows)
    for k in range(60):
        text = [word() for _ in range(rng.randrange(0, 80))]
        if k % 3 == 0:
            cut = words(rng.choice(bench[:25])[1])
            text[len(text) // 2:len(text) // 2] = [*cut, *cut[::-1], *cut]
        rows.append((100 + k, ", ".join(text) if k % 2 else " ".join(text).upper()))
    rows.append((300, "zeta omega zeta"))
    return [r for r in rows if r[0] != 8], bench


@pytest.mark.parametrize("width,block", [(5, 16 << 20), (10, 16 << 20), (5, 200)])
def test_hits_equal_brute_force(spark, docs, planted, width, block):
    d, b = frames(spark, docs, *planted)
    out = decontaminate.search(d, b, width=width, carry=["doc_id"], block_bytes=block)
    got = out.select("doc_id", "n_words", decontaminate.hit_words().alias("n"), decontaminate.items().alias("i")).collect()
    assert sorted([(r[0], r[1], r[2], r[3]) for r in got], key=str) == brute(*planted, width)


@pytest.mark.parametrize("width,block", [(5, 8 << 20), (10, 8 << 20), (5, 200), (1, 8 << 20)])
def test_runs_and_items_equal_brute_force(spark, docs, planted, width, block):
    d, b = frames(spark, docs, *planted)
    out = decontaminate.hits(d, b, width=width, carry=["doc_id"], block_bytes=block)
    got = out.select("doc_id", "n_words", decontaminate.hit_words("runs").alias("n"), "items").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(*planted, width)


def test_many_items_in_many_places():
    items = [(f"i{i}", b"word") for i in range(2000)]
    shard = decontaminate.Shard([b"word " * 2000, b"other word"], decontaminate.Windows(items, 10))
    runs, found = shard.hits()
    assert runs == [[(0, 2000)], [(1, 1)]] and [len(f) for f in found] == [2000, 2000]


def test_a_block_of_items_is_packed():
    rng = random.Random(5)
    items = [(str(i), " ".join(f"w{rng.randrange(20000)}" for _ in range(150)).encode()) for i in range(1000)]
    windows = decontaminate.Windows(items, 10)
    arrays = sum(x.nbytes for x in vars(windows).values() if hasattr(x, "nbytes"))
    assert len(windows.low) == 141 * 1000 and arrays < 60 * 150 * 1000  # 60 bytes a word


def test_matches_are_verbatim_and_maximal(spark, docs, planted):
    rows, bench = planted
    d, b = frames(spark, docs, rows, [x for x in bench if x[0] != "i0"])
    items, seen = dict(bench[1:]), 0
    for r in decontaminate.search(d, b, width=6, carry=["doc_id", "text"]).collect():
        w = words(r["text"])
        assert [m["length"] for m in r["matches"]] == sorted((m["length"] for m in r["matches"]), reverse=True)
        for m in r["matches"]:
            item, s, p, n = words(items[m["item_id"]]), m["item_start"], m["doc_start"], m["length"]
            assert w[p:p + n] == item[s:s + n]
            assert not (s and p and w[p - 1] == item[s - 1]) and w[p + n:p + n + 1] != item[s + n:s + n + 1] or not w[p + n:] or not item[s + n:]
            seen += 1
    assert seen > 20


def test_decontaminate_keeps_clean_rows_unchanged(spark, docs, planted):
    rows, bench = planted
    d, b = frames(spark, docs, rows, bench)
    clean = {str(x[0]) for x in brute(rows, bench, 10) if not x[2]}
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and {str(r["doc_id"]) for r in kept.collect()} == clean and kept.first()["n_words"] == 7


def test_empty_tables(spark, docs, odd_rows):
    d, none = docs(odd_rows), spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.decontaminate(d, none).count() == len(odd_rows)
    assert decontaminate.search(docs([]), none).collect() == []


def test_names_of_extra_columns_change_nothing(spark):
    from leadloom.llm import jaccard_join

    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, "a", "b", 3, "m", "g", 1), (2, "clean words only", "a", "b", 3, "m", "g", 1), (3, None, "a", "b", 3, "m", "g", 1)],
                                 "doc_id long, text string, _own_n_words string, _more string, n_words int, matches string, gone string, t int")
    item = spark.createDataFrame([("x", text)], "item_id string, text string")
    left = decontaminate.decontaminate(docs, item)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    left = jaccard_join.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == 3
