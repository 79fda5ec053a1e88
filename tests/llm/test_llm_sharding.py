import random
import zlib
from collections import Counter

import pytest

from leadloom.llm import sharding


def check(rows, got, n_shards):
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    counts = [sizes[s] for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(n_shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source, n in Counter(s for _, _, s in rows).items():
        per = Counter(r["shard"] for r in got if r["source"] == source)
        assert all(abs(per[s] - n / n_shards) <= 2 for s in range(n_shards))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_every_shard_holds_the_mixture(spark, n_shards):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "a", "bö" * rng.randrange(50)]), rng.choice(["hot"] * 6 + ["b", "c", None, ""])) for i in range(1500)]
    frame = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, source string, shard string, _rank double")
    check(rows, sharding.interleave(frame, n_shards).collect(), n_shards)


def test_order_is_a_seeded_shuffle(spark):
    frame = spark.createDataFrame([(i, "t", "s") for i in range(200)], "doc_id long, text string, source string")
    order = lambda seed, parts: [r[0] for r in sharding.interleave(frame.repartition(parts), 2, seed).orderBy("place").collect()]
    assert order(0, 1) == order(0, 5) != order(1, 1) and order(0, 1) != list(range(200))


def test_few_repeated_and_no_rows(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, "a", "s"), (1, "a", "s"), (None, None, None)]
    check(rows, sharding.interleave(spark.createDataFrame(rows, schema), 8).collect(), 8)
    assert sharding.interleave(spark.createDataFrame([], schema)).collect() == []
