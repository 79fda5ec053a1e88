"""Benchmark decontamination: suffix arrays of the training shards, searched for every benchmark window."""

import hashlib
import itertools
from array import array
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from leadloom.llm.batches import add_columns, column, text_bytes

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

MATCH = StructType([StructField("item_id", StringType()), StructField("item_start", LongType()),
                    StructField("doc_start", LongType()), StructField("length", LongType())])
RUN = StructType([StructField("doc_start", LongType()), StructField("length", LongType())])


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of a block of items as packed arrays, built once and sent to the tasks as they are.

    ``low`` has every different window (ids of the block's own words, shorter ones
    padded with 0) in sorted order, ``lengths`` its words.  Window w occurs in the
    items ``owner[cuts[w]:cuts[w + 1]]`` at word ``start``.  Windows with the same
    items share a group ``kind``; its items are ``members[bounds[k]:bounds[k + 1]]``.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.width = [name for name, _ in items], width
        ids, sizes = array("I"), []
        for _, text in items:
            found = words(text)
            ids.extend(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found)
            sizes.append(len(found))
        sizes = np.array(sizes, np.int64)
        number = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), number)
        start = within(number).astype(np.int32)
        lengths = np.minimum(sizes, width)[owner]
        at = (np.cumsum(sizes) - sizes)[owner] + start
        padded = np.append(np.frombuffer(ids, np.uint32) if len(ids) else np.empty(0, np.uint32), np.zeros(width, np.uint32))
        rows = np.zeros((len(at), width), ">u4")
        for i in range(width):
            rows[:, i] = np.where(i < lengths, padded[at + i], 0)
        keys = as_keys(rows)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        self.low, self.lengths = keys[first], lengths[order[first]].astype(np.int16)
        self.owner, self.start, self.cuts = owner[order], start[order], np.append(first, len(keys)).astype(np.int32)
        self.least = int(self.lengths.min()) if len(first) else 0
        self._group()

    def _group(self) -> None:
        known: dict[bytes, int] = {}
        self.kind = np.empty(len(self.low), np.int32)
        lists = []
        for w, (a, b) in enumerate(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)):
            own = self.owner[a:b]
            own = own if b - a == 1 else np.unique(own)
            key = own.tobytes() if b - a < 8 else hashlib.sha256(own.tobytes()).digest() + b"."
            k = known.setdefault(key, len(lists))
            if k == len(lists):
                lists.append(own)
            self.kind[w] = k
        self.members = np.concatenate([*lists, np.empty(0, np.int32)])
        self.bounds = np.cumsum([0, *map(len, lists)])

    def ranges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per window, the range of the sorted suffixes ``keys`` that begin with it."""
        first, last = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.low, "right")
        short = np.flatnonzero(self.lengths < self.width)
        if len(short):
            rows = self.low[short].reshape(-1, 1).view(">u4").reshape(len(short), self.width)
            top = np.where(np.arange(self.width) < self.lengths[short][:, None], rows, 0xFFFFFFFF)
            last[short] = np.searchsorted(keys, as_keys(top), "right")
        return first, last


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the sizes, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    rows = np.ascontiguousarray(rows, ">u4")
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shard's suffixes in sorted order, and their first ``width`` words.

    0 stands for a word that no item has.  A suffix that meets one before
    ``least`` words, the shortest window, cannot match and is left out.
    """
    stops = np.flatnonzero(np.append(ids, 0) == 0)
    run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
    places = np.flatnonzero(run >= least) if least else np.empty(0, np.int64)
    padded = np.append(ids, np.zeros(width, ids.dtype))
    rows = padded[places[:, None] + np.arange(width)]
    rows[np.arange(width) >= run[places][:, None]] = 0
    keys = as_keys(rows)
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


class Shard:
    """The suffix array of some texts, and where the windows occur in it."""

    def __init__(self, texts: list[bytes], windows: Windows):
        get, docs = windows.vocabulary.get, [words(t) for t in texts]
        self.counts = [len(d) for d in docs]
        self.ids = np.array([i for d in docs for i in (*[get(w, 0) for w in d], 0)], np.uint32)  # 0 parts the texts
        self.starts = np.cumsum([0, *[n + 1 for n in self.counts]])
        self.places, keys = suffix_array(self.ids, windows.width, windows.least)
        self.first, self.last = windows.ranges(keys)
        self.windows = windows

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def matches(self) -> list[list[tuple]]:
        """Maximal matches of every text: item, start in the item, start in the text, length."""
        windows = self.windows
        diagonals: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for w in np.flatnonzero(self.last > self.first).tolist():
            a, b = windows.cuts[w:w + 2]
            own = list(zip(windows.owner[a:b].tolist(), windows.start[a:b].tolist(), strict=True))
            at = self.places[self.first[w]:self.last[w]]
            for p, doc in zip(at.tolist(), self.doc(at).tolist(), strict=True):
                for item, start in own:
                    diagonals[doc, item, p - int(self.starts[doc]) - start].append((start, int(windows.lengths[w])))
        found: list[list[tuple]] = [[] for _ in self.counts]
        for (doc, item, shift), parts in diagonals.items():
            begin = end = None
            for start, length in sorted(parts):
                if end is None or start > end:
                    if end is not None:
                        found[doc].append((item, begin, begin + shift, end - begin))
                    begin, end = start, start + length
                end = max(end, start + length)
            found[doc].append((item, begin, begin + shift, end - begin))
        return found

    def hits(self) -> tuple[list[list[tuple]], list[list[str]]]:
        """Of every text the runs of words (start, length) that windows cover, and the items' ids.

        A place begins at most ``width`` windows, and of windows with the same items one
        is looked up a text, so that nothing grows with occurrences times items.
        """
        windows = self.windows
        w = np.flatnonzero(self.last > self.first)
        n = (self.last - self.first)[w]
        at, w = self.places[np.repeat(self.first[w], n) + within(n)], np.repeat(w, n)
        size = len(self.ids) + 1
        step = np.bincount(at, minlength=size) - np.bincount(at + windows.lengths[w], minlength=size)
        edges = np.diff(np.concatenate([[0], np.cumsum(step) > 0]).astype(np.int8))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        runs: list[list[tuple]] = [[] for _ in self.counts]
        for doc, a, b in zip(self.doc(begin).tolist(), begin.tolist(), end.tolist(), strict=True):
            runs[doc].append((a - int(self.starts[doc]), b - a))
        items: list[list[str]] = [[] for _ in self.counts]
        seen = np.zeros(len(windows.names), bool)
        of, kinds = np.divmod(np.unique(self.doc(at) * len(windows.bounds) + windows.kind[w]), len(windows.bounds))
        cuts = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
        for a, b in itertools.pairwise(cuts):
            new = []
            for k in kinds[a:b].tolist():
                own = windows.members[windows.bounds[k]:windows.bounds[k + 1]]
                own = own[~seen[own]]
                seen[own] = True
                new.append(own)
            new = np.concatenate(new)
            seen[new] = False
            items[of[a]] = list({windows.names[i] for i in new.tolist()} - {None})
        return runs, items


def item_blocks(benchmark: DataFrame, id: str, text: str, most: int):
    """The items in blocks of ``most`` bytes of text, read one partition at a time."""
    block, size = [], 0
    for name, value in benchmark.select(F.col(id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        value = (value or "").encode()
        if block and size + len(value) > most:
            yield block
            block, size = [], 0
        block.append((name, value))
        size += len(value) + 64
    yield block


def _passes(docs: DataFrame, benchmark: DataFrame, width: int, text: str, item_id: str, item_text: str, wanted: list[str],
            block_bytes: int, look: Callable[[Shard], tuple[list, ...]], fields: list[StructField]) -> DataFrame:
    """Columns ``wanted``, n_words and the array columns ``fields`` that ``look`` gives, of all blocks together."""
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    block, following = next(blocks), next(blocks, None)
    kept = [c for c in wanted if c not in ("n_words", *[f.name for f in fields])]
    out, first = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(kept)], column(text).cast("string").alias("t")), True
    keep = [f"k{i}" for i in range(len(kept))]
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, width))  # of bounded size

        def make(shared=shared):
            def work(texts):
                shard = Shard(text_bytes(texts), shared.value)
                return [shard.counts, *look(shard)]

            return work

        made = [StructField("n", LongType()), *[StructField(f"m{i}", f.dataType) for i, f in enumerate(fields)]]
        carry = [*keep, *([] if first else [f"r{i}" for i in range(len(fields))]), *(["t"] if following is not None else [])]
        out = add_columns(out, "t", make, made, carry)
        out = out.select(*keep, "n", *(["t"] if following is not None else []),
                         *[(F.col(f"m{i}") if first else F.concat(f"r{i}", f"m{i}")).alias(f"r{i}") for i in range(len(fields))])
        first, block, following = False, following, next(blocks, None)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keep, kept, strict=True)], F.col("n").alias("n_words"),
                      *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(fields)])


def search(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id",
           item_text: str = "text", carry: list[str] | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """Columns ``carry`` (default: all) of every document plus n_words and matches.

    ``matches`` are the maximal verbatim runs that contain a window of ``width``
    consecutive item words (an item of fewer words, but not none, is one window):
    item_id, item_start, doc_start, length, all in words, longest first, then by
    place.  There is one for every occurrence of every item: for what a text
    shares with the benchmark as a whole, ``hits`` needs far less room.

    Words are runs of letters, digits and non-ASCII characters after lower-casing
    A-Z.  Null texts have no words; null items give no windows; an item without id
    can match, under a null item_id; repeated rows are searched each.  Empty tables
    are fine on either side.  Texts of any length are searched whole; a very long
    one is a shard of its own.  Extra columns may have any name; of ``carry``
    those named as a result column give way to it.

    Every task cuts its rows into shards of some megabytes, sorts the suffixes
    of a shard and binary-searches all windows in it; texts never leave their
    task and nothing is shuffled.  The benchmark is the query set: blocks of at
    most ``block_bytes`` (or one item) become packed arrays on the driver, 4
    bytes for each of ``width`` and some 20 more a word, and go to the tasks one
    pass after another.
    """
    def look(shard):
        return ([[{"item_id": shard.windows.names[i], "item_start": a, "doc_start": b, "length": n} for i, a, b, n in f] for f in shard.matches()],)

    out = _passes(docs, benchmark, width, text, item_id, item_text, list(docs.columns if carry is None else carry), block_bytes,
                  look, [StructField("matches", ArrayType(MATCH))])
    order = "(a, b) -> case when a.length != b.length then int(sign(b.length - a.length)) else int(sign(a.doc_start - b.doc_start)) end"
    return out.withColumn("matches", F.expr(f"array_sort(matches, {order})"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", carry: list[str] | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """Columns ``carry`` (default: all) of every document plus n_words, runs and items.

    ``runs`` (doc_start, length) are the stretches of words that item windows
    cover, in order; with several blocks of items, stretches of different blocks
    may overlap (``hit_words`` counts each word once).  ``items`` are the ids of
    the items with an occurring window, sorted, each once; items without id count
    in runs only.  Both are as long as the text and the benchmark allow, not as
    their product.  Everything else is as in ``search``.
    """
    def look(shard):
        runs, items = shard.hits()
        return [[{"doc_start": a, "length": n} for a, n in r] for r in runs], items

    out = _passes(docs, benchmark, width, text, item_id, item_text, list(docs.columns if carry is None else carry), block_bytes,
                  look, [StructField("runs", ArrayType(RUN)), StructField("items", ArrayType(StringType()))])
    return out.withColumns({"runs": F.array_sort("runs"), "items": F.array_sort(F.array_distinct("items"))})


def hit_words(matches: str = "matches"):
    """Number of words that lie in any match: the union of the runs."""
    runs = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"),
                                 F.greatest(s["end"], r["b"]).alias("end"))
    return F.aggregate(runs, start, step, lambda s: s["n"])


def items(matches: str = "matches"):
    """The matching items' ids as strings, sorted, each once; items without id are left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(matches, lambda m: m["item_id"]), lambda x: x.isNotNull())))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any match, their columns unchanged, whatever their names."""
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(text).cast("string").alias("t"))
    found = hits(rows, benchmark, text="t", carry=["row"], **options)
    return found.filter(F.size("runs") == 0).select("row.*")
