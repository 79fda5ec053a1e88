"""N-gram Jaccard join: word-shingle sets in global rare-first order, joined by a prefix tree."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from leadloom.llm.batches import column, ship, slices, text_bytes
from leadloom.llm.common import power_of_two, staged
from leadloom.llm.components import components

TOKEN, CLASS = 0, 1
NO_ID = (1 << 63) - 1
PART = StructType([StructField("kind", IntegerType()), StructField("shard", IntegerType()), StructField("block", LongType()),
                   StructField("keys", BinaryType()), StructField("values", BinaryType())])
SETS = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("class", BinaryType()),
                   StructField("first", LongType()), StructField("prefix", ArrayType(LongType())),
                   StructField("tokens", BinaryType()), StructField("counts", BinaryType())])


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of all words when there are fewer; none without words."""
    words = np.array([hashes[w] for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ words[j:j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def order_keys(tokens: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, 32-bit key) by which members are counted; two members that share both only share a count, which still orders them alike everywhere."""
    return (tokens >> np.uint64(32)) % np.uint64(shards), tokens.astype(np.uint32)


def prefix_length(n: int) -> int:
    """Of two sets with Jaccard similarity 3/4 or more, the first n - ceil(3n/4) + 1 members of each have one in common."""
    return n - -(-3 * n // 4) + 1


def similar(overlap, n, m):
    """100 * intersection >= 75 * union, in whole numbers."""
    return 7 * overlap >= 3 * (n + m)


class Trie:
    """Sets of ranked members in lexicographic order: an implicit prefix tree, each node a range of sets with a common beginning."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.order, self.sets = order, [sets[i] for i in order]
        self.n, self.group = sizes[order].astype(np.int64), groups[order]
        self.k = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate(self.sets) if sets else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.k)
        self.flat = owner * (1 << 32) + flat
        self.start = np.cumsum(self.k) - self.k
        by = np.argsort(flat, kind="stable")
        self.holders, self.members = owner[by], flat[by]
        self.parent = {int(g): int(g) for g in np.unique(self.group)}
        self.links: list[tuple[int, int]] = []

    def find(self, g: int) -> int:
        while self.parent[g] != g:
            self.parent[g] = self.parent[self.parent[g]]
            g = self.parent[g]
        return g

    def holding(self, member: int) -> np.ndarray:
        a, b = np.searchsorted(self.members, (member, member + 1))
        return self.holders[a:b]

    def join(self) -> list[tuple[int, int]]:
        """Links that connect, with the given groups, all sets that a chain of similar pairs connects.

        Down the tree goes, for every later set that may still match, its
        overlap with the path, counted once for all sets below.  A subtree is
        left when the overlap and the shorter rest cannot reach what its
        smallest set needs.  Pairs that are connected already are not counted out.
        """
        mark = np.zeros(len(self.sets), bool)
        stack = [(0, len(self.sets), 0, np.arange(len(self.sets)), np.zeros(len(self.sets), np.int64))] if len(self.sets) > 1 else []
        while stack:
            low, high, depth, alive, overlap = stack.pop()
            later = alive > low
            alive, overlap = alive[later], overlap[later]
            if not len(alive):
                continue
            if high - low == 1 or self.k[low] == depth:
                self._leaf(low, depth, alive, overlap)
                if high - low > 1:
                    stack.append((low + 1, high, depth, alive, overlap))
                continue
            at = low
            while at < high:
                member = int(self.sets[at][depth])
                end = at + 1
                while end < high and self.sets[end][depth] == member:
                    end += 1
                own = alive >= at
                a, o = alive[own], overlap[own]
                holders = self.holding(member)
                mark[holders] = True
                o = o + mark[a]
                mark[holders] = False
                rest = self.k[a] - (np.searchsorted(self.flat, a * (1 << 32) + member, "right") - self.start[a])
                tail = int(self.k[at:end].max()) - depth - 1
                may = similar(o + np.minimum(rest, tail), int(self.n[at:end].min()), self.n[a])
                stack.append((at, end, depth + 1, a[may], o[may]))
                at = end
        return self.links

    def _leaf(self, s: int, depth: int, alive: np.ndarray, overlap: np.ndarray) -> None:
        n, m = int(self.n[s]), self.n[alive]
        may = (4 * m >= 3 * n) & (4 * n >= 3 * m) & similar(overlap + int(self.k[s]) - depth, n, m)
        root = self.find(int(self.group[s]))
        for p, o in zip(alive[may].tolist(), overlap[may].tolist(), strict=True):
            other = self.find(int(self.group[p]))
            if other != root:
                both = o + len(np.intersect1d(self.sets[s][depth:], self.sets[p], assume_unique=True))
                if similar(both, n, int(self.n[p])):
                    self.links.append((self.order[s], self.order[p]))
                    self.parent[other] = root


def _blob_rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
        pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=PART.names)


def _block_rows(batches, at: int):
    """(block, rows) for every run of rows of one block, in slices."""
    for batch in batches:
        ids = np.array(batch.column(0).to_pylist(), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                for part in slices(batch.slice(a, b - a), at, 1 << 20):
                    yield int(ids[a]), part


def _class(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _requests(batches, width: int, shards: int):
    """Per block and shard: the distinct members of the block with the number of its texts, and its distinct sets with their least id."""
    hashes, block, runs, classes = WordHashes(), None, [], {}

    def merged(parts):
        found, back = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
        return found, np.bincount(back, np.concatenate([c for _, c in parts]), minlength=len(found)).astype("<u4")

    def flush():
        found, n = merged(runs)
        cuts = np.searchsorted(found, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
        rows = [(TOKEN, s, block, found[a:b].astype("<u4").tobytes(), n[a:b].tobytes())
                for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a]
        bins: dict[int, list] = {}
        for key, first in classes.items():
            bins.setdefault(int.from_bytes(key[:4], "little") % shards, []).append((key, first))
        rows += [(CLASS, s, block, b"".join(k for k, _ in part), np.array([f for _, f in part], "<i8").tobytes()) for s, part in bins.items()]
        return _blob_rows(rows)

    for b, part in _block_rows(batches, 2):
        if block is not None and b != block and classes:
            yield flush()
        if b != block:
            block, runs, classes = b, [], {}
        sets = [shingles(t, width, hashes) for t in text_bytes(part.column(2))]
        for i, s in zip(part.column(1).to_pylist(), sets, strict=True):
            if len(s):
                key = _class(s)
                classes[key] = min(i, classes.get(key, NO_ID))
        shard, key = order_keys(np.concatenate(sets), shards)
        found, n = np.unique(shard << np.uint64(32) | key, return_counts=True)
        runs.append((found, n.astype("<u4")))
        if len(runs) > 4:
            runs = [merged(runs)]
    if block is not None and classes:
        yield flush()


def _answers(table: pa.Table) -> pa.Table:
    """For one shard: to every block its members that occur in several texts, with their number; for its sets the least id and who has it."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    blocks, keys, values = (table.column(c).to_pylist() for c in ("block", "keys", "values"))
    rows = []
    if kind == TOKEN:
        asked = [np.frombuffer(k, "<u4") for k in keys]
        found, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, np.concatenate([np.frombuffer(v, "<u4") for v in values])).astype("<u4")
        at = 0
        for b, a in zip(blocks, asked, strict=True):
            n = total[back[at:at + len(a)]]
            at += len(a)
            rows.append((TOKEN, shard, b, a[n > 1].tobytes(), n[n > 1].tobytes()))
    else:
        best: dict[bytes, tuple[int, int]] = {}
        asked = [(b, [k[i:i + 16] for i in range(0, len(k), 16)], np.frombuffer(v, "<i8").tolist()) for b, k, v in zip(blocks, keys, values, strict=True)]
        for b, names, firsts in asked:
            for name, first in zip(names, firsts, strict=True):
                best[name] = min((first, b), best.get(name, (first, b)))
        for b, names, _ in asked:
            rows.append((CLASS, shard, b, b"".join(names), np.array([x for k in names for x in (best[k][0], best[k][1] == b)], "<i8").tobytes()))
    return pa.Table.from_batches([_blob_rows(rows)])


def _sets(docs: pa.Table, answers: pa.Table, width: int, shards: int) -> pa.Table:
    """Every document's set size and class; for one document of a class also its members that occur elsewhere, rarest first."""
    kinds = {f.name: f.type for f in _arrow(SETS)}
    if not docs.num_rows:
        return pa.table({c: pa.array([], t) for c, t in kinds.items()})
    tokens, counts, classes = [], [], {}
    for kind, shard, keys, values in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "keys", "values")), strict=True):
        if kind == TOKEN:
            tokens.append(np.frombuffer(keys, "<u4").astype(np.uint64) | np.uint64(shard << 32))
            counts.append(np.frombuffer(values, "<u4"))
        else:
            facts = np.frombuffer(values, "<i8").reshape(-1, 2).tolist()
            classes.update((keys[16 * i:16 * i + 16], fact) for i, fact in enumerate(facts))
    tokens = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
    counts = np.concatenate(counts) if counts else np.empty(0, np.uint32)
    by = np.argsort(tokens)
    tokens, counts, hashes, out = tokens[by], counts[by], WordHashes(), []
    for batch in docs.combine_chunks().to_batches():
        for part in slices(batch, 2, 1 << 20):
            rows = []
            for i, t in zip(part.column(1).to_pylist(), text_bytes(part.column(2)), strict=True):
                s = shingles(t, width, hashes)
                if not len(s):
                    rows.append((i, 0, None, i, None, None, None))
                    continue
                name = _class(s)
                if name not in classes:
                    raise RuntimeError("a block has other texts than when it was counted; write the documents to a table first")
                first, mine = classes[name]
                prefix = members = numbers = None
                if mine and i == first:
                    classes[name][1] = 0  # one document of a class, also where ids repeat
                    shard, key = order_keys(s, shards)
                    key = shard << np.uint64(32) | key
                    at = np.minimum(np.searchsorted(tokens, key), max(0, len(tokens) - 1))
                    known = tokens[at] == key if len(tokens) else np.zeros(len(s), bool)
                    shared, n = s[known], counts[at[known]] if len(tokens) else counts[:0]
                    order = np.lexsort((shared, n))
                    shared, n = shared[order], n[order]
                    in_prefix = prefix_length(len(s)) - (len(s) - len(shared))  # members of one text only come first
                    if in_prefix > 0:
                        prefix = shared[:in_prefix].astype(np.uint64).view(np.int64)
                        members, numbers = shared.astype("<u8").tobytes(), n.astype("<u4").tobytes()
                rows.append((i, len(s), name, first, prefix, members, numbers))
            out.append(pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds)))
    return pa.concat_tables(out)


def _arrow(schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _verify(batches):
    for batch in batches:
        keep = []
        for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("ta", "tb", "na", "nb")), strict=True):
            both = np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True)
            keep.append(similar(len(both), n, m))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _join_cell(table: pa.Table) -> pa.Table:
    names = table.column("class").to_pylist()
    members = [np.frombuffer(t, "<u8") for t in table.column("tokens").to_pylist()]
    counts = [np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()]
    found, first, back = np.unique(np.concatenate(members), return_index=True, return_inverse=True)
    rank = np.empty(len(found), np.int64)
    rank[np.lexsort((found, np.concatenate(counts)[first]))] = np.arange(len(found))
    ranked, at = [], 0
    for m in members:
        ranked.append(np.sort(rank[back[at:at + len(m)]]))
        at += len(m)
    _, groups = np.unique(np.array([g.hex() for g in table.column("root").to_pylist()]), return_inverse=True)
    links = Trie(ranked, np.array(table.column("n").to_pylist(), np.int64), groups).join()
    return pa.table([pa.array([names[i] for i, _ in links], pa.binary()), pa.array([names[j] for _, j in links], pa.binary())], names=["a", "b"])


def join(docs: DataFrame, width: int = 5, id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20, cell: int = 8192,
         salts: int = 32) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    A document's set are the hashes of its runs of ``width`` words (A-Z
    lower-cased; with fewer words the whole sequence).  Documents link when the
    Jaccard similarity of their sets is 3/4 or more; ``component_id`` is the
    smallest id that links reach.  Null and empty texts have an empty set and
    link with nothing: their component is their own id.  Ids are whole numbers;
    a document without id links like others, and has a null component only when
    no id is in it.  Repeated rows get equal results.  Empty tables are fine.

    1. Every block of consecutive rows sends its distinct shingles, by hash
       shard, and gets back those that occur in several texts, with their
       number; equal sets become a class, and one document stands for it.  No
       list grows with a group: a block asks once, however many copies it has.
    2. Sets are ordered rarest shingle first.  Similar sets share a shingle of
       the first quarter, so those that have only shingles of their own there
       are done; the others (a tenth of ordinary texts) go on.
    3. Per shared prefix shingle one set is the pivot; all others are compared
       with it, which settles large groups of near copies with one comparison
       a set and shingle, not one a pair.
    4. What is left unsettled forms cells (components by shared prefix shingles;
       above ``cell`` sets cut into pairs of parts, so that all pairs still meet).
       A prefix tree over a cell finds the remaining links; see ``Trie``.

    As ``docs`` is cut into blocks twice it must be a table, not a plan with
    random order; a difference is noticed and raised.
    """
    spark = docs.sparkSession
    rows = ship(docs).select(F.coalesce(column(id).cast("long"), F.lit(NO_ID)).alias("i"), column(text).cast("string").alias("t"))
    size, n = (int(x or 0) for x in rows.agg(F.sum(F.octet_length("t") + 64), F.count("*")).first())
    per_block = max(1, int(block_bytes / max(1, size / max(1, n))))
    place = F.monotonically_increasing_id()
    rows = rows.withColumn("block", F.shiftleft(F.shiftright(place, 33), 33) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(per_block)).cast("long"))
    rows = rows.select("block", "i", "t")
    shards = power_of_two(spark, 4)
    asked = rows.mapInArrow(lambda batches: _requests(batches, width, shards), PART)
    answers = asked.groupBy("kind", "shard").applyInArrow(_answers, PART)
    sets = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _sets(d, a, width, shards), SETS)
    sets = staged(sets, "sets")

    stored = sets.filter(F.col("tokens").isNotNull()).select("class", "n", "tokens", "counts")
    spots = sets.filter(F.col("prefix").isNotNull()).select("class", "n", F.explode("prefix").alias("token"))
    pivots = spots.groupBy("token").agg(F.min("class").alias("pivot"), F.count("*").alias("sets")).filter("sets > 1").drop("sets")
    spots = staged(spots.join(pivots, "token"), "prefixes")

    edges = spots.filter("class != pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    side = lambda x: stored.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    pairs = edges.join(side("a"), "a").join(side("b"), "b").filter("4 * na >= 3 * nb and 4 * nb >= 3 * na")
    links = staged(pairs.mapInArrow(_verify, "a binary, b binary"), "links")
    settled = components(links, "a", "b")

    spots = spots.join(settled, spots["class"] == settled["node"], "left").select("token", "class", "pivot", F.coalesce("root", "class").alias("root"))
    mixed = spots.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("token")
    left = staged(spots.join(mixed, "token"), "unsettled")
    joined = components(left.select("class", "pivot"), "class", "pivot")
    joined = joined.select(F.col("node").alias("class"), F.col("root").alias("cell"))
    cells = left.select("class", F.col("root").alias("group")).distinct().join(joined, "class")
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("parts"))
    cells = cells.join(parts, "cell").join(stored, "class")
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "class", F.col("group").alias("root"), "n", "tokens", "counts")
    found = cells.groupBy("cell", "x", "y").applyInArrow(_join_cell, "a binary, b binary")
    everything = components(links.unionByName(found), "a", "b")

    firsts = sets.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("first").alias("first"))
    linked = everything.join(firsts, F.col("node") == F.col("class")).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select(F.col("node").alias("class"), "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = sets.select("id", "n", "class", "first", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(salts)).cast("int").alias("salt")).join(linked, ["class", "salt"], "left")
    known = lambda c: F.when(c != NO_ID, c)
    return out.select(known(F.col("id")).alias(id), F.col("n").alias("n_shingles"), known(F.coalesce("least", "first")).alias("component_id"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of every group of linked documents the one with the smallest id, columns unchanged.

    Ids tell rows apart: a row goes when its id is that of a document with a
    smaller linked id.  Rows without id are never dropped.
    """
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = join(docs, id=id, text=text, **options).filter(F.col(id) != F.col("component_id")).select(F.col(id).alias(name)).distinct()
    return docs.join(gone, column(id) == F.col(name), "left_anti")
