import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.llm import ppm


def tokens(t):
    return (t or "").encode().lower().split()


def brute(rows, trained, order):
    train = [t for (i, t) in rows if trained(i)]
    count, tries = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    body = lambda t: b"\n" * order + b" ".join(tokens(t)) + b"\n"
    for t in train:
        count.update([*tokens(t), None])
        s = body(t)
        for p in range(order, len(s)):
            for k in range(order + 1):
                tries[k][s[p - k:p]][s[p]] += 1
    total = sum(count.values())
    norm = total + 0.1 * (len(count) + 1)

    def log(s, p):
        out, seen = 0.0, {}
        for k in range(order, -1, -1):
            here = tries[k].get(s[p - k:p])
            if not here:
                continue
            n, kinds = sum(c for b, c in here.items() if b not in seen), sum(b not in seen for b in here)
            if s[p] in here and s[p] not in seen:
                return out + math.log10(here[s[p]] / (n + kinds))
            out += math.log10(kinds / (n + kinds)) if kinds else 0.0
            seen = here
        return out - math.log10(256 - len(seen))

    for i, t in rows:
        w = [*tokens(t), None]
        yield i, len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 0.1) / norm) for x in w), sum(log(body(t), p) for p in range(order, len(body(t))))


@pytest.mark.parametrize("order,suffix,block", [(5, 2, 24 << 20), (3, 1, 700), (4, 3, 5000)])
def test_scores_equal_brute_force(docs, odd_rows, order, suffix, block):
    rng = random.Random(6)
    rows = [(i, t if t is None or len(t) < 60_000 else t[:4000]) for i, t in odd_rows if i is not None]
    rows += [(50 + k, " ".join(rng.choice(["the", "of", "Ähnlich", "aaaa", f"w{rng.randrange(30)}", "banana"]) for _ in range(rng.randrange(40)))) for k in range(60)]
    trained = lambda i: i % 4 != 0
    got = ppm.score(docs(rows).coalesce(2), F.col("doc_id") % 4 != 0, order=order, suffix=suffix, block_bytes=block).collect()
    want = sorted(brute(rows, trained, order))
    assert len(got) == len(want)
    for a, b in zip(sorted(tuple(r) for r in got), want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-5, abs=1e-5)


def test_a_null_id_or_condition_is_no_training_row(docs):
    got = ppm.score(docs([(None, "a b"), (1, "a")]), F.col("doc_id") > 0).collect()
    assert {r["train_tokens"] for r in got} == {2} and sorted(r["n_known"] for r in got) == [2, 2]


def test_without_training_rows_or_documents(docs, odd_rows):
    got = ppm.score(docs([(1, "abc"), (2, None)]), F.lit(False)).collect()
    assert sorted(r["score"] for r in got) == pytest.approx([-4 * math.log10(256), -math.log10(256)], rel=1e-6)
    assert {r["base_score"] for r in got} == {0.0}
    assert ppm.score(docs([]), F.lit(True)).collect() == []
