"""Packing by power-of-two decomposition: no sequence crosses documents."""

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from leadloom.llm.batches import column, ship, slices

PROBE = "Don't  stop,\n\n\tit's <|endoftext|> 12 für ½ 日本 ‍🙂 "


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes stand for themselves, the rest follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def encoder(path: str, special: bool = False):
    """Function from a list of texts to their ids, for a byte-level BPE file of ``tokenizers``.

    The file's vocabulary is handed to a faster engine with the same merges;
    a probe text is encoded by both, and a difference is an error.  Strings of
    added tokens are ordinary text, or with ``special`` their own ids, as
    ``tokenizers`` encodes by default.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, added = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    if special and any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path} has added tokens that take in what stands around them")
    fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = not special
    cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if special and added else None

    def encode(text: str) -> list[int]:
        if cut is None or not cut.search(text):
            return fast.encode_ordinary(text)
        ids = []
        for part in cut.split(text):
            ids.extend([added[part]] if part in added else fast.encode_ordinary(part))
        return ids

    probe = PROBE + "".join(f"a {t}{t} b" for t in added)
    if encode(probe) != exact.encode(probe, add_special_tokens=False).ids:
        raise ValueError(f"{path} is not a byte-level BPE that can be encoded by rank")
    return lambda texts: [encode(t) for t in texts]


def piece_lengths(n: int, size: int) -> list[int]:
    """``n`` as whole sequences of ``size`` (a power of two), then its binary digits from the largest down."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end: int = 1, id: str = "doc_id",
         text: str = "text", special: bool = False) -> DataFrame:
    """One row per sequence: id, start, length, bucket, ids, doc_tokens, sequence_id, offset.

    A document's token ids and ``end`` are cut into pieces of ``size`` and then
    into the powers of two of the rest.  Every piece is a sequence of its own, so
    no padding is ever added and no sequence crosses documents; sequences of
    equal length share a ``bucket`` (log2 of the length) and are batched
    together, for example by ``write.partitionBy("bucket")``.  ``ids`` are
    little-endian unsigned 32-bit numbers.

    With ``special``, strings of the file's added tokens in a text are their ids, as
    ``tokenizers`` encodes by default; else they are ordinary text.

    Null and empty texts are the end token alone, one sequence of length 1.
    Repeated rows are packed once each.  An empty table gives no rows.  Other
    columns are ignored.  ``sequence_id`` is unique, not dense: numbering needs no
    shuffle, and the one pass over the texts keeps one slice of them in memory.
    """
    import public_tokenizers

    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    source = ship(docs).select(column(id).alias("i"), column(text).cast("string").alias("t"))
    schema = StructType([StructField("i", docs.schema[id].dataType), StructField("start", LongType()),
                         StructField("length", LongType()), StructField("bucket", IntegerType()),
                         StructField("ids", BinaryType()), StructField("doc_tokens", LongType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                rows, lengths, starts, ids, totals = [], [], [], [], []
                for r, got in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    got.append(end)
                    data, at = np.array(got, "<u4").tobytes(), 0
                    for n in piece_lengths(len(got), size):
                        rows.append(r)
                        starts.append(at)
                        lengths.append(n)
                        ids.append(data[4 * at:4 * (at + n)])
                        totals.append(len(got))
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([n.bit_length() - 1 for n in lengths], pa.int32()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                    names=["i", "start", "length", "bucket", "ids", "doc_tokens"])

    out = source.mapInArrow(run, schema)
    return out.select(F.col("i").alias(id), "start", "length", "bucket", "ids", "doc_tokens",
                      F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
