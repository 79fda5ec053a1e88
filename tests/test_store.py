"""The bucketed contact store: what a batch touches, what it leaves, and what a version holds."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadloom.operators import resolve as R
from leadloom.store import ContactStore, merge_batch

SCHEMA = ("file_name string, pos int, raw_name string, raw_phone string, raw_email string, raw_address string, raw_source string, "
          "raw_campaign string, raw_note string, raw_uid string, raw_link string, file_date date")


def batch(spark, rows):
    return spark.createDataFrame([(f, p, n, t, e, "a", None, None, None, None, None, None) for p, (f, n, t, e) in enumerate(rows)], SCHEMA)


def files(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def content(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def many(spark):
    return batch(spark, [("a.csv", f"Lead {i}", f"09100{i:05d}", f"l{i}@x.vn" if i % 3 else None) for i in range(400)])


def test_a_small_batch_leaves_other_buckets_as_they_are(spark, tmp_path, many):
    store = ContactStore(spark, str(tmp_path), 16)
    merge_batch(store, many, "1")
    first, manifest = files(tmp_path), store._manifest("1")
    small = batch(spark, [("b.csv", "Lead new", "0910000007", None), ("b.csv", "One more", "0999999999", "q@x.vn")])
    merge_batch(store, small, "2")
    after = files(tmp_path)
    assert {k: after[k] for k in first} == first  # written files never change
    later, touched = store._manifest("2"), {str(b) for b in store.touched(R.lead_keys(R.clean(small)))}
    for table in ("contacts", "files"):
        changed = {b for b in later["folders"][table] if later["folders"][table][b] != manifest["folders"][table].get(b)}
        assert changed == touched and len(changed) <= 2 < len(later["folders"][table])
    added = set(after) - set(first)
    assert {p.split("_bucket=")[1].split("/")[0] for p in added if p.startswith("contacts/")} == touched
    both = R.lead_keys(R.clean(many.unionByName(small)))
    assert content(store.contacts()) == content(R.golden(both)) and content(store.contacts("1")) == content(R.golden(R.lead_keys(R.clean(many))))
    assert content(store.rows("files")) == content(R.golden_files(both))


def test_rows_lie_in_the_bucket_of_their_key(spark, tmp_path, many):
    store = ContactStore(spark, str(tmp_path), 8)
    merge_batch(store, many, "1")
    placed = 0
    for b in range(8):
        rows = store.rows("contacts", "1", [b])
        assert rows.filter(store.bucket() != b).isEmpty()
        placed += rows.count()
    assert placed == 400 and store.rows("contacts", "1", []).count() == 0
    assert ContactStore(spark, str(tmp_path), 99).buckets == 8  # fixed by what is stored


def test_known_keys_of_touched_buckets_serve_the_anti_join(spark, tmp_path, many):
    store = ContactStore(spark, str(tmp_path), 16)
    assert store.contacts() is None and store.known_keys(many.withColumn("lead_key", F.col("raw_phone")), None) is None
    merge_batch(store, many, "1")
    keyed = R.lead_keys(R.clean(batch(spark, [("b", "x", "0910000001", None), ("b", "y", "", "l1@x.vn"), ("b", "z", "", "new@x.vn"), ("b", "", "12", None)])))
    known = store.known_keys(keyed, "1")
    assert known.count() < store.rows("keys").count()
    full = R.history_keys(store.contacts())
    status = lambda h: {(r["pos"], r["status"]) for r in R.mark_status(keyed, h).collect()}
    assert status(known) == status(full) == {(0, "duplicate"), (1, "duplicate"), (2, "valid"), (3, "invalid_phone")}


def test_repeated_and_unfinished_versions(spark, tmp_path, many):
    store = ContactStore(spark, str(tmp_path), 4)
    merge_batch(store, many, "1")
    small = batch(spark, [("b.csv", "New", "0999999999", None)])
    merge_batch(store, small, "2")
    once = content(store.contacts())
    merge_batch(store, small, "2")
    assert content(store.contacts()) == once and store.versions() == ["1", "2"]
    (tmp_path / "manifest" / "version=2" / "_SUCCESS").unlink()  # as if the run had died before it was published
    assert store.versions() == ["1"] and store.contacts().count() == 400
    merge_batch(store, small, "2")
    assert content(store.contacts()) == once
    assert store.vacuum() > 0 and content(store.contacts()) == once and store.vacuum() == 0 and store.contacts("1").count() == 400


def test_empty_batches(spark, tmp_path, many):
    store = ContactStore(spark, str(tmp_path), 4)
    merge_batch(store, many.limit(0), "1")
    assert store.contacts().count() == 0
    merge_batch(store, many, "2")
    merge_batch(store, many.limit(0), "3")
    assert content(store.contacts("3")) == content(store.contacts("2"))


def test_a_batch_stages_only_what_is_merged(spark, tmp_path, many, monkeypatch):
    from leadloom import store as S

    seen = {}
    monkeypatch.setattr(S, "staged", lambda df, label: seen.setdefault(label, df))
    S.merge_batch(ContactStore(spark, str(tmp_path / "s"), 4), many, "1")
    assert set(seen["keyed"].columns) == set(R.MERGED) and not {"raw_phone", "raw_name", "raw_email"} & set(seen["keyed"].columns)
    assert seen["keyed"].filter("lead_key IS NULL").count() == 0


def test_contact_rows_are_made_once_for_all_landings(spark, monkeypatch):
    from leadloom.plans import streams as ST

    made, raw = spark.sparkContext.accumulator(0), ST.PC.raw

    def counted(spark, sf):
        rows = raw(spark, sf)

        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch
        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(ST.PC, "raw", counted)
    stored = ST.str1_incremental_ingest(spark, "/root/testdata/sf0.001").count()
    assert stored and made.value == raw(spark, "/root/testdata/sf0.001").count()
