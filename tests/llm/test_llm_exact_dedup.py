import hashlib
import random
import re
from collections import Counter, defaultdict

from leadloom.llm import exact_dedup


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for plain, group in by.items():
        sha, best, used = hashlib.sha256(plain.encode()).hexdigest(), min(group), False
        for row in sorted(group):
            out.append((row[3], best[3], len(group), row == best and not used, sha))
            used = True
    return Counter(out)


def test_groups_equal_brute_force(docs, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, rng.choice(["a b", "ab", "a  b", "c", "A b", "a\u00a0b", "d e\f"])) for i in range(300)]
    for runs, bits in ((1, 1), (4, 1), (64, 3)):
        got = exact_dedup.groups(docs(rows), runs=runs, fan_in_bits=bits).collect()
        assert Counter(tuple(r) for r in got) == brute(rows)


def test_deduplicate_keeps_one_row_of_each_group(docs, odd_rows):
    kept = exact_dedup.deduplicate(docs(odd_rows))
    assert kept.columns == docs(odd_rows).columns
    want = Counter((i, sha) for (i, keep, n, k, sha), c in brute(odd_rows).items() if k)
    got = Counter((r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()) for r in kept.collect())
    assert got == want


def test_empty_table(docs):
    assert exact_dedup.groups(docs([])).collect() == [] and exact_dedup.deduplicate(docs([])).collect() == []


def test_of_one_id_the_longest_spelling_stays(spark):
    """Rows that share an id are judged by their text; names of extra columns change nothing."""
    clash = "doc_id long, text string, _keep_id string, _digest int, d string, n long, i int, row string, no_id boolean, kept string"
    rows = [(1, t, "k", 1, "d", 2, 3, "r", True, "x") for t in ("a b c", "a  b   c", "abc", "a  b   c")] + [(2, "ab c", "k", 1, "d", 2, 3, "r", True, "x")]
    df = spark.createDataFrame(rows, clash)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [rows[1]]
