"""The pipeline's stages against plain versions of what they decide, over the small documents."""

import re
from collections import Counter

import corpus_pipeline
from leadloom.llm import queries
from leadloom.session import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_llm_decontaminate import brute as leaks
    from test_llm_jaccard import brute as near

    docs = queries.table(spark, SF, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = staged(stage(spark, docs, SF), name)
        if name == "packing":
            break
        assert docs.columns == columns and all(rows[r["doc_id"]] == r for r in docs.collect())
        seen[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
    toxic = {r[0] for r in queries.table(spark, SF, "labels").filter("toxic = 1").collect()}
    clean = {r[0] for r in queries.table(spark, SF, "labels").filter("toxic = 0").collect()}
    assert clean <= seen["toxicity"][1].keys() and len(toxic & seen["toxicity"][1].keys()) < len(toxic) / 2
    before, after = seen["exact_dedup"]
    groups = Counter(re.sub(r"[\x20\x09-\x0D]", "", t) for t in after.values())
    assert set(groups) == {re.sub(r"[\x20\x09-\x0D]", "", t) for t in before.values()} and max(groups.values()) == 1
    before, after = seen["jaccard_join"]
    assert after.keys() == {i for i, _, c in near(list(before.items())) if i == c}
    before, after = seen["decontaminate"]
    bench = [(str(r[0]), r[1]) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert after.keys() == {x[0] for x in leaks(list(before.items()), bench, 10) if not x[2]}
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == after.keys()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_no_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        queries.table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    queries.table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
