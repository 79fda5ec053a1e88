"""Language-model scoring by prediction by partial matching: a byte-context trie, sharded, with escapes and symbol exclusion."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from leadloom.llm.batches import column, ship, slices, text_bytes
from leadloom.llm.common import power_of_two, staged

END = b"\n"
GRAM, WORD, TOTAL = 0, 1, 2
UNSEEN = -0.5  # log10(0.1) is the weight of a token that was not seen, log10(1.1) the least of the others
PART = StructType([StructField("kind", IntegerType()), StructField("shard", IntegerType()), StructField("block", LongType()),
                   StructField("keys", BinaryType()), StructField("values", BinaryType())])


def packed(keys: np.ndarray) -> bytes:
    """Rising numbers as compressed differences."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u8"), dtype=np.uint64)


def numbers(n) -> bytes:
    return zlib.compress(np.asarray(n, "<i8").tobytes(), 1)


def read_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def tokens(text: bytes) -> list[bytes]:
    """Words of the A-Z lower-cased text; its end is one more token."""
    return text.lower().split()


def codes(token_lists: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of the texts (words parted by a space, closed by the end byte): the byte with the ``order`` bytes before it, as one number.

    Before a text stand end bytes.  The second array has the bytes of every text.
    """
    bodies = [b" ".join(words) + END for words in token_lists]
    sizes = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"".join(END * order + b for b in bodies), np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(data) - order), np.uint64)
    for j in range(order + 1):
        h = (h << np.uint64(8)) | data[j:j + len(h)]
    own = np.ones(len(data), bool)
    ends = np.cumsum(sizes + order)
    own[(ends[:, None] - 1 - np.arange(order)).ravel()] = False
    return h[own[:len(h)]], sizes


def shard_of(grams: np.ndarray, suffix: int, shards: int) -> np.ndarray:
    """Shard by the last ``suffix`` bytes of the context: all longer contexts that end so are together."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * suffix) - 1)
    mixed = context * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


class Level:
    """Counts of one order: keys (context and symbol) with n, and per context the total, the symbols, and what they have one order lower."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.contexts, self.of = np.unique(keys >> np.uint64(8), return_inverse=True)
        self.total = np.bincount(self.of, n, minlength=len(self.contexts))
        self.symbols = np.bincount(self.of, n > 0, minlength=len(self.contexts))
        self.below = np.zeros(len(self.contexts))

    def lower(self, n_below: np.ndarray) -> None:
        """``n_below``: per key, the count of the key without its oldest byte."""
        self.below = np.bincount(self.of, n_below * (self.n > 0), minlength=len(self.contexts))

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """For keys that need not be here: n, total, symbols, below."""
        if not len(self.keys):
            return (np.zeros(len(keys)),) * 4
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        context = keys >> np.uint64(8)
        c = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[c] == context
        return (np.where(self.keys[i] == keys, self.n[i], 0), *(np.where(known, x[c], 0) for x in (self.total, self.symbols, self.below)))


def low_levels(keys: np.ndarray, n: np.ndarray, suffix: int) -> list[Level]:
    """Orders 0 to ``suffix`` - 1 from the counts of the strings of ``suffix`` bytes."""
    out, order = [], np.argsort(keys)
    keys, n = keys[order], n[order].astype(float)
    for j in range(suffix - 1, -1, -1):
        level = Level(keys, n)
        keys, back = np.unique(keys & np.uint64((1 << 8 * j) - 1), return_inverse=True) if j else (keys[:0], None)
        if j:
            n = np.bincount(back, n)
            level.lower(n[back])
        out.insert(0, level)
    return out


def log_probabilities(grams: np.ndarray, n: np.ndarray, order: int, low: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context; ``grams`` are distinct, and hold all trained ones of their shard.

    From the longest context that was ever seen down: a byte seen there has its
    share of total + symbols, an escape has symbols of it; bytes seen in a longer
    context are excluded from both.  Below order 0 all bytes not seen are even.
    """
    place = np.argsort(grams)
    grams, n = grams[place], n[place].astype(float)
    levels: dict[int, Level] = dict(enumerate(low))
    keys = grams
    for j in range(order, len(low) - 1, -1):
        level = levels[j] = Level(keys, n)
        keys, back = np.unique(keys & np.uint64((1 << 8 * j) - 1), return_inverse=True)
        if j > len(low):
            n = np.bincount(back, n, minlength=len(keys))
        else:
            n = low[j - 1].at(keys)[0]
        level.lower(n[back])
    result, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    excluded_n, excluded_symbols = np.zeros(len(grams)), np.zeros(len(grams))
    for j in range(order, -1, -1):
        here, total, symbols, below = levels[j].at(grams & np.uint64((1 << 8 * (j + 1)) - 1))
        x, y = total - excluded_n, symbols - excluded_symbols
        seen = open_ & (total > 0)
        hit = seen & (here > 0)
        escape = seen & ~hit & (y > 0)
        result[hit] += np.log10(here[hit] / (x + y)[hit])
        result[escape] += np.log10(y[escape] / (x + y)[escape])
        open_ &= ~hit
        excluded_n = np.where(total > 0, below, 0)
        excluded_symbols = np.where(total > 0, symbols, 0)
    result[open_] -= np.log10(256 - excluded_symbols[open_])
    out = np.empty_like(result)
    out[place] = result
    return out


def _requests(batches, order: int, suffix: int, shards: int):
    """Per block and shard, the distinct grams and words of the block with their counts in training texts."""
    block, grams, words = None, [], Counter()

    def merged():
        keys = np.concatenate([g for g, _ in grams])
        found, back = np.unique(keys, return_inverse=True)
        return found, np.bincount(back, np.concatenate([n for _, n in grams])).astype(np.int64)

    def flush():
        found, n = merged()
        shard = shard_of(found, suffix, shards)
        by = np.argsort(shard, kind="stable")
        rows, cuts = [], np.searchsorted(shard[by], np.arange(shards + 1))
        for s in np.unique(shard).tolist():
            part = by[cuts[s]:cuts[s + 1]]
            rows.append((GRAM, s, block, packed(found[part]), numbers(n[part])))
        bins: dict[int, list] = {}
        for w, c in words.items():
            bins.setdefault(zlib.crc32(w) % shards, []).append((w, c))
        for s, part in bins.items():
            part.sort()
            rows.append((WORD, s, block, zlib.compress(b"\n".join(w for w, _ in part), 1), numbers([c for _, c in part])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
            pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=PART.names)

    for batch in batches:
        ids = np.array(batch.column(0).to_pylist(), np.int64)
        cuts = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids))
        start = 0
        for stop in cuts.tolist():
            if stop == start:
                continue
            if block is not None and ids[start] != block:
                yield flush()
                grams, words = [], Counter()
            block = int(ids[start])
            for part in slices(batch.slice(start, stop - start), 2, 1 << 21):
                lists = [tokens(t) for t in text_bytes(part.column(2))]
                train = np.array(part.column(1).to_pylist(), bool)
                found, sizes = codes(lists, order)
                weight = np.repeat(train, sizes).astype(np.int64)
                found, back = np.unique(found, return_inverse=True)
                grams.append((found, np.bincount(back, weight).astype(np.int64)))
                for known, t in zip(lists, train.tolist(), strict=True):
                    if t:
                        words.update(known)
                for known, t in zip(lists, train.tolist(), strict=True):
                    if not t:
                        for w in known:
                            words[w] += 0
            if len(grams) > 8:
                grams = [merged()]
            start = stop
    if block is not None:
        yield flush()


def _answers(table: pa.Table, order: int, low: list[Level]) -> pa.Table:
    """For one shard: log-probabilities of the grams, or counts of the words, for every block that asked."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    blocks, keys, values = (table.column(c).to_pylist() for c in ("block", "keys", "values"))
    counts = [read_numbers(v) for v in values]
    rows = []
    if kind == GRAM:
        asked = [unpacked(k) for k in keys]
        found, back = np.unique(np.concatenate(asked), return_inverse=True)
        logs = log_probabilities(found, np.bincount(back, np.concatenate(counts), minlength=len(found)), order, low).astype("<f4")
        at = 0
        for b, k, a in zip(blocks, keys, asked, strict=True):
            rows.append((GRAM, shard, b, k, logs[back[at:at + len(a)]].tobytes()))
            at += len(a)
    else:
        total: Counter = Counter()
        lists = [zlib.decompress(k).split(b"\n") for k in keys]
        for words, n in zip(lists, counts, strict=True):
            for w, c in zip(words, n.tolist(), strict=True):
                total[w] += c
        for b, k, words in zip(blocks, keys, lists, strict=True):
            rows.append((WORD, shard, b, k, numbers([total[w] for w in words])))
        seen = [c for c in total.values() if c]
        rows.append((TOTAL, shard, None, b"", numbers([sum(seen), len(seen)])))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
        pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=PART.names)


def _score(docs: pa.Table, answers: pa.Table, order: int, ends: int, names: list[str]) -> pa.Table:
    """Sums over whole texts of a block, with the block's own answers."""
    grams, logs, weight = [], [], {}
    for kind, keys, values in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "values")), strict=True):
        if kind == GRAM:
            grams.append(unpacked(keys))
            logs.append(np.frombuffer(values, "<f4"))
        elif kind == WORD:
            weight.update(zip(zlib.decompress(keys).split(b"\n"), np.log10(read_numbers(values) + 0.1).tolist(), strict=True))
    if not docs.num_rows:
        return pa.table([pa.array([], f.type) for f in docs.schema][1:2] + [pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * 2, names=names)
    grams, logs = np.concatenate(grams), np.concatenate(logs).astype(float)
    place = np.argsort(grams)
    grams, logs = grams[place], logs[place]
    end = float(np.log10(ends + 0.1))
    out = []
    for batch in docs.combine_chunks().to_batches():
        for part in slices(batch, 2, 1 << 20):
            lists = [tokens(t) for t in text_bytes(part.column(2))]
            asked, sizes = codes(lists, order)
            i = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
            if not (grams[i] == asked).all():
                raise RuntimeError("a block has other texts than when it was counted; write the documents to a table first")
            score = np.add.reduceat(logs[i], np.cumsum(sizes) - sizes)
            facts = [[weight[w] for w in words] + [end] for words in lists]
            out.append(pa.table([part.column(1), pa.array([len(f) for f in facts], pa.int64()), pa.array([sum(x > UNSEEN for x in f) for f in facts], pa.int64()),
                                 pa.array([sum(f) for f in facts], pa.float64()), pa.array(score)], names=names))
    return pa.concat_tables(out)


def score(docs: DataFrame, train: Column, order: int = 5, suffix: int = 2, id: str = "doc_id", text: str = "text",
          block_bytes: int = 24 << 20) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score.

    A text is its A-Z lower-cased words, parted by single spaces and closed by
    an end byte.  ``score`` is the log10 probability of these bytes under a PPM
    model of ``order`` bytes of context trained on the rows where ``train`` holds;
    ``base_score`` is the smoothed unigram probability of the words and the end.
    Null and empty texts are the end alone.  Repeated rows are scored each and
    train each.  Without training rows every byte has probability 1/256 and the
    base is 0.  Any column names may occur; only id and text are read.

    The trie grows with the corpus, so no task and not the driver holds it:

    1. Every block of documents (consecutive rows of a scan, ``block_bytes`` on
       average) sends its distinct grams and words with their training counts.
       No text is moved.
    2. Grams meet by the last ``suffix`` bytes of their context, words by a hash;
       a shard adds up, computes the probability of each gram once and answers
       the blocks that asked.  Orders below ``suffix`` come from at most
       256**``suffix`` counts, which every shard gets.
    3. Documents meet their block's answers and are summed up.

    Blocks are cut twice from the same scan, so ``docs`` must be a table, not a
    plan with random order; a difference is noticed and raised.
    """
    spark = docs.sparkSession
    rows = ship(docs).select(column(id).alias("i"), column(text).cast("string").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    size, n, ends = (int(x or 0) for x in rows.agg(F.sum(F.octet_length("t") + 64), F.count("*"), F.sum(F.col("train").cast("long"))).first())
    per_block = max(1, int(block_bytes / max(1, size / max(1, n))))
    block = F.floor(F.monotonically_increasing_id() / F.lit(1 << 33)) * F.lit(1 << 33) + F.floor(
        F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) / F.lit(per_block))
    rows = rows.withColumn("block", block.cast("long"))
    shards = power_of_two(spark, 4)
    asked = rows.select("block", "train", "t").mapInArrow(lambda batches: _requests(batches, order, suffix, shards), PART)
    asked = staged(asked, "grams")

    def lowest(batches):
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, back = np.unique(unpacked(k) & np.uint64((1 << 8 * suffix) - 1), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(back, read_numbers(v)).astype(np.int64))], names=["key", "n"])

    pairs = (asked.filter(F.col("kind") == GRAM).select("keys", "values")
             .mapInArrow(lowest, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 0"))
    pairs = pairs.toArrow()  # at most 256**suffix rows
    shared = spark.sparkContext.broadcast((pairs.column("key").to_numpy().astype(np.uint64), pairs.column("n").to_numpy()))
    answers = asked.groupBy("kind", "shard").applyInArrow(lambda t: _answers(t, order, low_levels(*shared.value, suffix)), PART)
    answers = staged(answers, "answers")
    sums = answers.filter(F.col("kind") == TOTAL).select("values").collect()  # one row per shard
    total = sum((read_numbers(r[0]) for r in sums), np.zeros(2, np.int64))
    train_tokens, distinct = int(total[0]) + ends, int(total[1]) + (ends > 0)

    names = ["i", "n_tokens", "n_known", "logs", "score"]
    schema = StructType([StructField("block", LongType()), StructField("i", docs.schema[id].dataType)])
    kind = StructType([schema["i"], *[StructField(x, LongType()) for x in names[1:3]], *[StructField(x, DoubleType()) for x in names[3:]]])
    scored = (rows.select("block", "i", "t").groupBy("block").cogroup(answers.filter("block is not null").groupBy("block"))
              .applyInArrow(lambda d, a: _score(d, a, order, ends, names), kind))
    norm = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    return scored.select(F.col("i").alias(id), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
                         (F.col("logs") - F.col("n_tokens") * norm).alias("base_score"), "score")
