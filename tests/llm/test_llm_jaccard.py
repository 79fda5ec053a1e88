import random
from itertools import combinations

import numpy as np
import pytest

from leadloom.llm import jaccard_join
from leadloom.llm.jaccard_join import Trie, prefix_length, similar


def brute(rows, width=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


@pytest.fixture
def near(odd_rows):
    """Chains of edits from a few texts, a shared passage, exact copies, and odd rows."""
    rng, rows = random.Random(4), list(odd_rows)
    passage = [f"p{k}" for k in range(25)]
    for base in range(12):
        text = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.randrange(4, 120))]
        for copy in range(rng.randrange(1, 25)):
            edited = list(text)
            for _ in range(rng.randrange(0, max(1, len(text) // 18) + 1)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10_000)}"
            if rng.random() < 0.3:
                text = edited
            if rng.random() < 0.2:
                edited = passage + edited
            rows.append((1000 * base + 100 + copy, " ".join(edited).title() if copy % 2 else "\n".join(edited)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell,block", [(8192, 24 << 20), (3, 20_000)])
def test_components_equal_brute_force(spark, docs, near, cell, block):
    got = jaccard_join.join(docs(near).coalesce(2), cell=cell, block_bytes=block).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(near)


def test_one_document_of_each_group_stays(spark, docs, near):
    rows = [r for r in near if r[0] is not None]
    kept = jaccard_join.deduplicate(docs(rows).coalesce(1))
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in brute(rows) if i == c}


def test_trie_finds_all_components():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sets = []
        for _ in range(rng.integers(2, 40)):
            if sets and rng.random() < 0.7:
                s = set(sets[rng.integers(len(sets))].tolist())
                s = {x for x in s if rng.random() > 0.12} | set(rng.integers(60, size=rng.integers(0, 4)).tolist())
            else:
                s = set(rng.integers(60, size=rng.integers(1, 25)).tolist())
            sets.append(np.array(sorted(s), np.int64))
        sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
        links = Trie(sets, sizes, np.arange(len(sets))).join()

        def roots(pairs, n=len(sets)):
            label = list(range(n))
            for a, b in pairs:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        ok = lambda a, b: similar(len(np.intersect1d(sets[a], sets[b])), sizes[a], sizes[b])  # noqa: E731, B023
        assert all(ok(a, b) for a, b in links)
        assert roots(links) == roots([p for p in combinations(range(len(sets)), 2) if ok(*p)])


def test_prefix_bound():
    for n in range(1, 200):
        for m in range(n, 2 * n):
            need = next((o for o in range(n + 1) if similar(o, n, m)), n + 1)
            assert need > n or prefix_length(n) >= n - need + 1


def test_empty_table(docs):
    assert jaccard_join.join(docs([])).collect() == []
