"""Token alignment between two tokenizers by diagonal run skipping."""

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from leadloom.llm.batches import column, ship, slices
from leadloom.llm.common import staged
from leadloom.llm.packing import byte_letters, encoder

SLICE_BYTES = 1 << 20


def align(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the tokens that end together.

    Both are the tokens' lengths, of the same sum: the distances between their
    ends, which are compared from the last common end on.  Along a diagonal (a
    constant index shift) stretches of equal ends are probed with doubling lengths
    and jumped over; where a probe fails, its length is halved until the stretch
    is known.  What follows is an irregular group: the side that is behind moves on
    until both ends meet, which sets the next shift.
    """
    begins, shifts, counts, i, j, n = [], [], [], 0, 0, len(a)
    begin = 0
    while i < n:
        step = 1
        while a[i:i + step] == b[j:j + step] and i + step <= n:
            i += step
            j += step
            step += step
        while step > 1:
            step >>= 1
            if i + step <= n and a[i:i + step] == b[j:j + step]:
                i += step
                j += step
        if i > begin:
            begins.append(begin)
            shifts.append(j - i)
            counts.append(i - begin)
        if i == n:
            break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x += a[i]
            else:
                j += 1
                y += b[j]
        begin = i  # the group's last tokens are the first of the next stretch
        i += 1
        j += 1
        if i == n:
            begins.append(begin)
            shifts.append(j - i)
            counts.append(1)
    counts = np.array(counts, np.int64)
    left = np.repeat(np.array(begins, np.int64) - np.concatenate([[0], np.cumsum(counts)[:-1]])[:len(counts)], counts) + np.arange(counts.sum())
    return left, left + np.repeat(np.array(shifts, np.int64), counts)


class Pieces:
    """Bytes of every token id of a tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        if self.lengths.max() > 255:
            raise ValueError("a token of more than 255 bytes")
        self.pool = pa.array(tokens, pa.large_binary())

    def joined(self, ids: np.ndarray) -> memoryview:
        """The bytes of all tokens, one after another."""
        return raw(self.pool.take(pa.array(ids)))


def offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[:len(strings) + 1]


def raw(strings: pa.Array) -> memoryview:
    """The bytes of a freshly taken array of large strings, one after another."""
    return memoryview(strings.buffers()[2] or b"").cast("B")[:offsets(strings)[-1]]


def byte_level_tokens(path: str) -> list[bytes]:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocabulary = byte_letters(), spec["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    tokens = [b""] * (1 + max([*vocabulary.values(), *added]))
    for token, i in vocabulary.items():
        if i not in added:
            tokens[i] = bytes(letters[c] for c in token)
    return tokens  # added tokens are ordinary text, so that their ids never come up


def piece_tokens(model) -> list[bytes]:
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else
                      b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return tokens


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs (id of a, id of b) that can end together, as sorted numbers id of a * len(b) + id of b.

    Of two tokens whose byte ranges end together, one is a suffix of the other.
    So there are at most as many pairs as the vocabularies' suffixes that are
    tokens: a bound that the two files set, whatever the corpus.
    """
    def by_bytes(tokens):
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                out.setdefault(t, []).append(i)
        return out

    of_a, of_b, found = by_bytes(a), by_bytes(b), set()
    for own, other, swap in ((of_a, of_b, False), (of_b, of_a, True)):
        for token, ids in own.items():
            for k in range(len(token)):
                for y in other.get(token[k:], ()):
                    found.update((y, x) if swap else (x, y) for x in ids)
    return np.array(sorted(x * len(b) + y for x, y in found), np.int64)


@functools.lru_cache(2)
def tokenizers(a_path: str, b_path: str):
    """Encoders of A and B, their token bytes, the possible pairs, and ids written in decimal with what may follow."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    a, b = Pieces(byte_level_tokens(a_path)), Pieces(piece_tokens(model))
    ids = max(len(a.tokens), len(b.tokens))
    written = pa.array([f"{i}{after}" for after in ",|;" for i in range(ids)], pa.large_string())  # after an id: one more, B's ids, the next group
    return (lambda texts: encoder(a_path)([" " + t for t in texts]), lambda texts: model.encode(texts, num_threads=1),
            a, b, possible_pairs(a.tokens, b.tokens), written, ids)


def default_paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and where each list of them ends, after a 0."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])


def gives_back(pieces: Pieces, ids: np.ndarray, ends: np.ndarray, whole: list[bytes]) -> bool:
    """Whether the tokens of every text are its bytes."""
    sizes = np.concatenate([[0], np.cumsum(pieces.lengths[ids])])[ends]
    return np.array_equal(np.diff(sizes), [len(w) for w in whole]) and pieces.joined(ids) == b"".join(whole)


def aligned_slice(texts: list[str], tools) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """n_a, n_b, n_groups and groups_sha256 of every text, and the links (places in the possible pairs) of all, one after another."""
    encode_a, encode_b, a, b, pairs, written, ids = tools
    whole = [(" " + t).encode() if t else b"" for t in texts]
    got_a, got_b = [x if t else [] for t, x in zip(texts, encode_a(texts), strict=True)], encode_b(texts)
    (all_a, end_a), (all_b, end_b) = flat(got_a), flat(got_b)
    if not (gives_back(a, all_a, end_a, whole) and gives_back(b, all_b, end_b, whole)):
        for k, w in enumerate(whole):
            if any(p.joined(np.array(x[k], np.int64)) != w for p, x in ((a, got_a), (b, got_b))):
                got_a[k], got_b[k] = [], []
        (all_a, end_a), (all_b, end_b) = flat(got_a), flat(got_b)
    left, right = align(a.lengths[all_a].astype(np.uint8).tobytes(), b.lengths[all_b].astype(np.uint8).tobytes())
    links = np.searchsorted(pairs, all_a[left] * len(b.tokens) + all_b[right]).astype(np.int32)
    # a group's ids of A and then of B: an id stands behind its own side's and the other side's earlier ones
    last_a, last_b = np.zeros(len(all_a), np.int64), np.zeros(len(all_b), np.int64)
    last_a[left] = last_b[right] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    codes = np.empty(len(all_a) + len(all_b), np.int64)
    codes[np.arange(len(all_a)) + np.concatenate([[0], right + 1])[group_a]] = all_a + ids * last_a
    codes[np.arange(len(all_b)) + (left + 1)[group_b]] = all_b + 2 * ids * last_b
    text = written.take(pa.array(codes))
    at, data = offsets(text)[end_a + end_b].tolist(), raw(text)
    hashes = [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]  # without the last ;
    return np.diff(end_a), np.diff(end_b), np.diff(np.searchsorted(left, end_a)), hashes, links


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, groups_sha256 and links (places in ``possible_pairs``) of every document.

    A encodes a space and the text with the byte-level file, B the text with the
    piece model, which adds the space.  Groups reach from one byte offset where
    tokens of both end to the next.  Null and empty texts, and texts whose
    tokens do not give back the bytes, have no tokens: zeros, '' and no links.
    """
    paths = default_paths(a_path, b_path)
    schema = StructType([StructField("i", docs.schema[id].dataType), *[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups")],
                         StructField("groups_sha256", StringType()), StructField("links", ArrayType(IntegerType()))])

    def run(batches):
        tools = tokenizers(*paths)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                n_a, n_b, n_groups, sha, links = aligned_slice([t or "" for t in part.column(1).to_pylist()], tools)
                ends = np.concatenate([[0], np.cumsum(n_groups)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(sha, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links))],
                    names=["i", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    source = ship(docs).select(column(id).alias("i"), column(text).cast("string").alias("t"))
    return source.mapInArrow(run, schema).withColumnRenamed("i", id)


def pair_counts(links: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links hold each possible pair: a sum per task, then per pair; at most one row per possible pair reaches the driver."""

    def run(batches):
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    found = links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_pairs, np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts


def pair_table(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """a_id, b_id, n and best (n is the highest of the B id) for every pair linked in the corpus.

    A map from ids of one vocabulary to the other's, for example to carry
    embeddings or distillation targets over.
    """
    paths = default_paths(a_path, b_path)
    a, b, pairs = tokenizers(*paths)[2:5]
    counts = pair_counts(staged(aligned(docs, *paths, id, text).select("links"), "links"), len(pairs))
    best = best_of_b(pairs % len(b.tokens), counts, len(b.tokens))
    at = np.flatnonzero(counts)
    rows = pa.table({"a_id": pairs[at] // len(b.tokens), "b_id": pairs[at] % len(b.tokens), "n": counts[at], "best": best[at]})
    return docs.sparkSession.createDataFrame(rows)


def best_of_b(b_ids: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Whether a pair's count is the highest of its B id, ties included."""
    highest = np.zeros(n, np.int64)
    np.maximum.at(highest, b_ids, counts)
    return counts == highest[b_ids]


def link_scores(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A link is a token of A and a token of B that end together; its count is the
    number of links of the corpus between the same two ids.  ``n_best`` counts the
    links whose count is the highest of their B id, ``count_sum`` sums the counts.

    The alignment is made once and its links are written (four bytes a link,
    compressed); their counts over the corpus are summed per task, then per pair.
    The table of counts that goes to all tasks has one number per possible pair
    of the two vocabularies, a bound that does not depend on the corpus.

    Null and empty texts and texts that the tokens do not give back count zero,
    with '' as hash.  A very long text is one row and worked on as a whole.
    Repeated rows and rows without id are aligned and counted each.  An empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    paths = default_paths(a_path, b_path)
    rows = staged(aligned(docs, *paths, id, text), "links")
    b, pairs = tokenizers(*paths)[3:5]
    counts = pair_counts(rows, len(pairs))
    best = best_of_b(pairs % len(b.tokens), counts, len(b.tokens))
    shared = docs.sparkSession.sparkContext.broadcast((counts, best))
    schema = StructType([*[f for f in rows.schema if f.name != "links"], *[StructField(c, LongType()) for c in ("n_links", "n_best", "count_sum")]])

    def run(batches):
        counts, best = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("links"))
            links, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            per_row = [np.concatenate([[0], np.cumsum(x[links])])[ends] for x in (best, counts)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i, f in enumerate(batch.schema) if f.name != "links"], pa.array(np.diff(ends), pa.int64()),
                 *[pa.array(np.diff(x), pa.int64()) for x in per_row]], names=schema.names)

    found = rows.select(*[c for c in rows.columns if c != "links"], "links").mapInArrow(run, schema)
    return found.select(id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
