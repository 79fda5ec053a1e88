"""Token alignment against a plain walk over token bytes."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from leadloom.llm import alignment
from leadloom.llm.packing import byte_letters
from leadloom.llm.queries import table

LETTERS = byte_letters()


def tokens(texts):
    """(ids, bytes) of A and B for every text, by the libraries alone."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        yield ([(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in x],
               [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in y])


def brute(pairs):
    """The operator's columns of (id, text) rows."""
    rows, counts = [], Counter()
    for (i, text), (x, y) in zip(pairs, tokens([t or "" for _, t in pairs]), strict=True):
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            rows.append((i, 0, 0, None, [], []))
            continue
        ends = []
        for side in (x, y):
            at, out = 0, []
            for n, t in side:
                at += len(t)
                out.append((at, n))
            ends.append(out)
        both = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        split = []  # of each side, its ids by the group they lie in
        for side in ends:
            parts, k = [[] for _ in both], 0
            for end, n in side:
                parts[k].append(n)
                k += end == both[k]
            split.append(parts)
        groups = [",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in zip(*split, strict=True)]
        links = [(ga[-1], gb[-1]) for ga, gb in zip(*split, strict=True)]
        counts.update(links)
        rows.append((i, len(x), len(y), groups, links, []))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((i is None, i, a, b, len(g or []), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
                    "" if g is None else hashlib.sha256(";".join(g).encode()).hexdigest()) for i, a, b, g, k, _ in rows), key=str)


def result(docs):
    return sorted(((r["doc_id"] is None, *r) for r in alignment.link_scores(docs).collect()), key=str)


def test_odd_rows(docs, odd_rows):
    pairs = [*odd_rows, (20, "a <|endoftext|> b <s> </s> <unk> <0x41>"), (21, "under▁score"), (22, "  two  spaces \n\n\t tabs "),
             (23, "é é ﬁ Ａ １ ™ ‍﻿\u0000z"), (24, "日本語の文章 한국어 🙂🙂🙂👩‍👩‍👧"), (25, "don't 1234567 ....... ========")]
    assert result(docs(pairs)) == brute(pairs)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert result(docs) == brute([tuple(r) for r in docs.collect()])


def test_empty_table(docs):
    assert alignment.link_scores(docs([])).collect() == []


def test_runs_are_skipped_to_the_same_places():
    r = random.Random(3)
    for length in (1, 2, 5, 40, 200):
        for keep in (0.05, 0.5, 0.95, 1.0):
            for _ in range(20):
                a = sorted({length, *(i for i in range(1, length) if r.random() < keep)})
                b = sorted({length, *(i for i in range(1, length) if r.random() < keep or (keep > 0.9 and i in a))})
                sizes = [bytes(y - x for x, y in zip([0, *ends], ends)) for ends in (a, b)]
                left, right = alignment.align(*sizes)
                assert [a[i] for i in left] == [b[j] for j in right] == sorted(set(a) & set(b))


def test_pairs_are_bounded_by_the_vocabularies(docs):
    a, b = [b"", b"ab", b"b", b"x"], [b"ab", b"cab", b"b", b"b", b"y"]
    pairs = {(int(p) // len(b), int(p) % len(b)) for p in alignment.possible_pairs(a, b)}
    assert pairs == {(x, y) for x, s in enumerate(a) for y, t in enumerate(b) if s and t and (s.endswith(t) or t.endswith(s))}
    table = alignment.pair_table(docs([(1, "the cat"), (2, "the hat"), (2, "the hat")])).collect()
    assert all(r["n"] > 0 for r in table) and max(r["n"] for r in table) >= 3
