import re

import pytest
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import text as T

PATTERNS = [s[1] for s in D.INTENT_SIGNALS]


@pytest.mark.parametrize(("pattern", "needed"), [
    (r"(red|blue)\s*car", ["car"]), (r"(red|blue).{0,3}(a|b)", ["red", "blue"]), (r"(?:dark\s+)?green", ["green"]),
    (r"(red|\d+)", []), (r"red*", ["re"]), (r"(?i)red", []), (r"\p{L}red", []), (r"(?:red)+x", ["red"]), ("", [])])
def test_literals_that_a_match_needs(pattern, needed):
    assert T.needed_literals(pattern) == needed


def test_every_match_holds_a_needed_literal():
    words = sorted({w for p in PATTERNS for w in re.findall(r"[^\W\d_]+", p)})
    texts = [f"{a} {b} {c}" for a in words[::3] for b in words[::2] for c in ("", "này", "5 tỷ")] + [a + b for a in words for b in words[::5]]
    for p in PATTERNS:
        needed = T.needed_literals(p)
        assert needed
        assert all(any(x in t for x in needed) for t in texts if re.search(p, t))


def test_same_hits_as_the_pattern_alone(spark):
    texts = ["", None, "muốn  mua căn này", "không chắc, lo ngại", "gửi thông tin dự án ở đâu", "tầm 3.5 tỷ", "THÔI", "vợ chưa chịu"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = [F.count_if(T.found(F.col("t"), p).eqNullSafe(F.col("t").rlike(p))).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    assert set(df.agg(*same).first()) == {len(texts)}
