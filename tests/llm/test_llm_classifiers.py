import numpy as np
import pytest

from leadloom.llm import quality, queries, toxicity
from leadloom.llm.labels import sample

SF = "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def quantities(spark, name, label):
    got = queries.QUERIES[name](spark, SF)
    rows = got.join(queries.table(spark, SF, "labels"), "doc_id").filter("held_out").select("predicted", label, "score").collect()
    assert got.count() == queries.table(spark, SF, "documents").count() and all(0 <= r[2] <= 1 for r in rows)
    return np.array([(r[0], r[1]) for r in rows])


def test_quality_on_held_out_labels(spark):
    p = quantities(spark, "op2_quality_ranking", "quality")
    assert (p[:, 0] == p[:, 1]).mean() > 0.98


def test_toxicity_on_held_out_labels(spark):
    p = quantities(spark, "op8_toxicity", "toxic")
    assert (p[p[:, 1] == 0, 0] == 0).mean() > 0.995 and (p[p[:, 1] == 1, 0] == 1).mean() > 0.75


@pytest.fixture
def toy(odd_rows):
    rows = [(1000 + i, f"some plain text number {i} about the idle weather of day {i * 7}") for i in range(60)]
    bad = [(2000 + i, f"you vekwu{i} and vekwu{i + 1} !!! %%% $$$ &&& you you you you {i}") for i in range(40)]
    return odd_rows + rows + bad, [(i, 1, 0) for i, _ in rows[:40]] + [(i, 0, 1) for i, _ in bad[:30]] + [(99999, 0, 1), (None, 1, 1), (1001, None, None)]


def test_odd_rows_are_scored(spark, docs, toy):
    rows, known = toy
    for got in (toxicity.score(docs(rows), labels(spark, known)).collect(),
                quality.score(docs(rows), labels(spark, known)).collect()):
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    by = {r["doc_id"]: r for r in toxicity.score(docs(rows), labels(spark, known)).collect()}
    assert by[2035]["predicted"] == 1 and by[1055]["predicted"] == 0 and by[1]["score"] == by[2]["score"]
    by = {r["doc_id"]: r for r in quality.score(docs(rows), labels(spark, known)).collect()}
    assert by[2035]["predicted"] == 0 and by[1055]["predicted"] == 1
    assert by[2035]["score"] < 0.3 <= by[1055]["score"]


def test_drop_keeps_clean_rows_unchanged(spark, docs, toy):
    rows, known = toy
    kept = toxicity.drop(docs(rows), labels(spark, known))
    assert kept.columns == docs(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in rows if i is None or not 2000 <= i < 2100) and kept.first()["score"] == 1.5


def test_without_labels_or_documents(spark, docs, odd_rows):
    for module, value in ((toxicity, 0.5), (quality, 0.3)):
        got = module.score(docs(odd_rows), labels(spark, [])).collect()
        assert {round(r["score"], 9) for r in got} == {value}
        assert module.score(docs([]), labels(spark, [(1, 1, 0)])).collect() == []
    one = toxicity.score(docs(odd_rows), labels(spark, [(4, 1, 1), (5, 1, 1)])).collect()
    assert {r["predicted"] for r in one} == {1}


def test_sample_is_bounded_and_repeatable(spark):
    frame = labels(spark, [(i, i % 2, 0) for i in range(100)])
    a = sample(frame, "doc_id", "quality", 10).collect()
    assert len(a) == 10 and sorted(a) == sorted(sample(frame.repartition(7), "doc_id", "quality", 10).collect())
    assert {r["label"] for r in sample(frame, "doc_id", "quality", 10, 1).collect()} == {1}


def test_ngrams_do_not_cross_texts_and_long_texts_are_whole(monkeypatch):
    alone = [set(toxicity.presence([t])[0].tolist()) for t in ("abcd ef", "", "ghi", "日本語テスト")]
    codes, owners = toxicity.presence(["abcd ef", "", "ghi", "日本語テスト"])
    assert [set(codes[owners == k].tolist()) for k in range(4)] == alone
    long = "".join(chr(97 + i * i % 23) for i in range(3000))
    whole = set(toxicity.presence([long])[0].tolist())
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert set(toxicity.presence(["x", long])[0].tolist()) - set(toxicity.presence(["x"])[0].tolist()) <= whole == set(toxicity.presence([long])[0].tolist())
    text = " abcd ef "
    assert len(alone[0]) == sum(len({text[i:i + n] for i in range(len(text) - n + 1)}) for n in toxicity.ORDERS)


def test_quality_with_a_heavily_repeated_id(spark, docs):
    """Copies of one labelled document, or many texts under its id, do not crowd out the other class."""
    good, bad = "some plain text about the idle weather of the day", "you you !!! %%% $$$ &&& you you"
    known = labels(spark, [(1, 1, 0), (2, 0, 0)])
    want = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(docs([(1, good), (2, bad)]), known, max_labelled=2).collect()}
    assert want[1][1] == 1 and want[2][1] == 0
    got = quality.score(docs([(1, good)] + [(2, bad)] * 100), known, max_labelled=2).collect()
    assert len(got) == 101 and {(r["doc_id"], r["score"], r["predicted"]) for r in got} == {(i, *w) for i, w in want.items()}
    got = quality.score(docs([(1, good)] + [(2, f"{bad} {'!' * n}") for n in range(100)]), known, max_labelled=2).collect()
    assert {(1, 1), (2, 0)} <= {(r["doc_id"], r["predicted"]) for r in got}


def test_a_labelled_id_on_many_rows_counts_once(spark):
    """What the driver collects is bounded by ``per_class``, and copies of a document do not shift the classes."""
    from leadloom.llm import toxicity

    few = [(1, "you awful nasty fool " * 3), (2, "a calm and friendly day " * 3)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, toxic int")
    many = spark.range(20_000).selectExpr("2L AS doc_id", "repeat('a calm and friendly day ', 3) AS text", "'x' AS _toxicity")
    once = toxicity.fit(spark.createDataFrame(few, "doc_id long, text string"), labels, per_class=1, least=1)
    often = toxicity.fit(spark.createDataFrame([few[0]], "doc_id long, text string").unionByName(many.drop("_toxicity")), labels, per_class=1, least=1)
    assert once.bias == often.bias and once.weights.tolist() == often.weights.tolist()
    left = toxicity.drop(many.limit(5), labels, per_class=1, least=1)
    assert left.columns == many.columns and {r["_toxicity"] for r in left.collect()} <= {"x"}


def test_every_label_is_learnt_from(spark, docs, monkeypatch):
    """A label past any fixed number, and rows of a rare class in every block, count in means, pairs and threshold."""
    rng = np.random.default_rng(1)
    rows = [(i, "plain words " * (2 + i % 7) + "! " * int(n)) for i, n in enumerate(rng.integers(0, 9, 600))]
    known = [(i, int(t.count("!") < 8 and i % 50 > 0), 0) for i, t in rows]
    seen = []
    monkeypatch.setattr(quality, "sample", lambda *a: (seen.append(a[3]), sample(*a))[1])
    quality.score(docs(rows[:9]), labels(spark, known[:9])).collect()
    assert seen == [None]
    monkeypatch.setattr(quality, "BLOCK", 64)
    frame = spark.createDataFrame([(i, int(i % 50 > 0), 1, [float(i + j) for j in range(12)]) for i in range(600)], "id long, label int, n long, _features array<double>")
    parts, good, few = quality.blocks(frame)
    assert parts.count() == 9 and (good, few) == (588, 12)
    own = quality.total(parts, lambda x, good, weight, own: np.array([own.sum(), x[own, 0].sum(), float((~good).sum() == 12)]))
    assert own.tolist() == [600, sum(range(600)), 9]
    model = quality.fit(frame)
    assert model == quality.fit(frame.repartition(11))
    assert frame.filter(model.strength("_features") >= 0).count() == 588
