from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leadloom.llm import packing


def exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_round_trip_and_lengths_are_powers_of_two(spark, docs, odd_rows):
    rows = [*odd_rows, (20, "It's <|endoftext|> don't\t\t x  \n\n y "), (21, "1234567 ½ ² ٣ é e\u0301 \u200d 🙂")]
    got = packing.pack(docs(rows), size=256).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r["length"] == 1 << r["bucket"] <= 256 and len(r["ids"]) == 4 * r["length"] and r["offset"] == 0
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    assert len({r["sequence_id"] for r in got}) == len(got)
    tokenizer = exact()
    for i, text in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        copies = sum(j == i for j, _ in rows)
        if i is None:
            continue
        parts = sorted(pieces[i], key=lambda p: p[0])[::copies]
        assert [x for _, ids, _ in parts for x in ids] == want and {n for _, _, n in parts} == {len(want)}
        rest = [len(ids) for _, ids, _ in parts if len(ids) < 256]
        assert rest == sorted(set(rest), reverse=True)


def test_encoder_equals_the_tokenizer_on_documents(spark, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    fast, tokenizer = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), exact()
    assert fast(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_piece_lengths_and_empty_table(docs):
    assert packing.piece_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1] and packing.piece_lengths(1, 2048) == [1]
    assert packing.pack(docs([])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs([]), size=1000)


def test_added_tokens_are_their_ids_as_by_default(spark, docs, tmp_path):
    from leadloom.llm import queries

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext", "  <|endoftext|>\n\n it's", "", "none"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.encoder(path, True)(texts) == want != packing.encoder(path)(texts)
    docs(list(enumerate(texts))).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op3_binary_packing"](spark, str(tmp_path)).select("doc_id", "doc_tokens").distinct().collect()
    assert {tuple(r) for r in got} == {(i, len(ids) + 1) for i, ids in enumerate(want)}
