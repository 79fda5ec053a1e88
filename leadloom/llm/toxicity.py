"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from leadloom.llm.batches import add_columns, column, ship, slices
from leadloom.llm.common import staged
from leadloom.llm.labels import sample

ORDERS = (4, 6, 8)
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


PIECE = 1 << 18


def pieces(texts: list[str]):
    """The lower-cased texts between two spaces, in lists of about ``PIECE`` characters with the number of the text of each.

    A longer text is cut; the cuts overlap, so that every n-gram lies in one of its pieces.
    """
    parts, owners, size = [], [], 0
    for k, text in enumerate(texts):
        whole = f" {text.lower()} "
        for start in range(0, len(whole), PIECE):
            parts.append(whole[start:start + PIECE + max(ORDERS) - 1])
            owners.append(k)
            size += len(parts[-1])
            if size >= PIECE:
                yield parts, np.array(owners)
                parts, owners, size = [], [], 0
    if parts:
        yield parts, np.array(owners)


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all character n-grams of the strings, and the string each is from."""
    joined = "\0".join(parts)
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    gaps = np.cumsum(chars == 0)
    codes, owners = [], []
    h = chars[:0]
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        h = chars.copy() if n == 1 else h[:-1] * _P + chars[n - 1:]
        if n in ORDERS:
            code = h ^ (h >> np.uint64(29)) ^ np.uint64(n)
            code = code * _M
            code ^= code >> np.uint64(32)
            first = gaps[:len(h)]
            whole = (first == gaps[n - 1:]) & (chars[:len(h)] != 0)
            codes.append(code[whole])
            owners.append(first[whole])
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


def strings(texts: pa.Array) -> list[str]:
    return [(t or "").replace("\0", " ") for t in texts.to_pylist()]


def _distinct(codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((codes, owners))
    codes, owners = codes[order], owners[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])
    return codes[new], owners[new]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (code, text) pairs."""
    found = []
    for parts, owners in pieces(texts):
        codes, part = grams(parts)
        found.append(_distinct(codes, owners[part]))
    return _distinct(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


@dataclass
class Model:
    """Codes in sorted order with their weights (log-count ratio times learnt weight), and an intercept."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (feature, text) pairs of the model's n-grams in the texts."""
        if not len(self.codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if not hasattr(self, "sieve"):  # most n-grams fall through, at one look-up each
            self.sieve = np.zeros(1 << 20, bool)
            self.sieve[self.codes >> np.uint64(44)] = True
        found = [np.empty(0, np.int64)]
        for parts, owners in pieces(texts):
            codes, part = grams(parts)
            near = self.sieve[codes >> np.uint64(44)]
            codes, part = codes[near], part[near]
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[place] == codes
            found.append(owners[part[hit]] * len(self.codes) + place[hit])
        pairs = np.unique(np.concatenate(found))
        return pairs % len(self.codes), pairs // len(self.codes)

    def score(self, texts: list[str]) -> np.ndarray:
        feature, owner = self.find(texts)
        raw = np.bincount(owner, self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def _logistic(rows: np.ndarray, features: np.ndarray, values: np.ndarray, y: np.ndarray, k: int, ridge: float,
              steps: int = 200, memory: int = 10) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression on sparse rows, by limited-memory BFGS."""
    v, mask = values[features], np.append(np.ones(k), 0.0)

    def loss(w):
        raw = np.bincount(rows, w[features] * v, minlength=len(y)) + w[k]
        error = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y) / len(y)
        slope = np.append(np.bincount(features, error[rows] * v, minlength=k), error.sum()) + ridge * mask * w
        return np.logaddexp(0, np.where(y > 0, -raw, raw)).mean() + ridge / 2 * (mask * w * w).sum(), slope

    w, past = np.zeros(k + 1), []
    f, g = loss(w)
    for _ in range(steps):
        if np.abs(g).max() < 1e-6:
            break
        q, used = g.copy(), []
        for s, t in reversed(past):
            used.append((s @ q) / (s @ t))
            q -= used[-1] * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, t), a in zip(past, reversed(used), strict=True):
            q += (a - (t @ q) / (s @ t)) * s
        size, fall = 1.0, g @ q
        while True:
            new = w - size * q
            f_new, g_new = loss(new)
            if f_new <= f - 1e-4 * size * fall or size < 1e-10:
                break
            size /= 2
        s, t = new - w, g_new - g
        if s @ t > 1e-12:
            past = [*past, (s, t)][-memory:]
        w, f, g = new, f_new, g_new
    return w


def _frequencies(rows: DataFrame, sieve: np.ndarray | None) -> DataFrame:
    """(code, n): the texts in which each n-gram occurs; with a sieve only those n-grams whose top bits it has."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                codes, _ = presence(strings(part.column(0)))
                if sieve is not None:
                    codes = codes[sieve[codes >> np.uint64(40)]]
                found, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    kind = StructType([StructField("code", LongType()), StructField("n", LongType())])
    return ship(rows).select("text").mapInArrow(count, kind).groupBy("code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, n_features: int = 2048, least: int = 3, ridge: float = 1e-4,
        id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on at most ``per_class`` labelled ids of each class, in hash order, with one text each.

    Document frequencies of n-grams per class give the log-count ratios r; of the
    n-grams in at least ``least`` toxic texts, the ``n_features`` with the largest
    chi-square become features with value r where present, and a ridge logistic
    regression learns their weights.  Counting is a Spark aggregation; the driver
    holds the sample's features, ``n_features`` numbers and a sieve of 2**24 bits.
    """
    chosen = sample(labels, label_id, label, per_class, 0).unionByName(sample(labels, label_id, label, per_class, 1))
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # of an id on many rows one text counts
    rows = staged(ship(rows.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("id", "label").agg(one).select("label", "text")), "labelled")
    n1, n = (int(x or 0) for x in rows.agg(F.sum("label"), F.count("*")).first())
    if not 0 < n1 < n:
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    toxic = staged(_frequencies(rows.filter("label = 1"), None).filter(F.col("n") >= least), "toxic-grams")
    sieve = np.zeros(1 << 24, bool)
    top = toxic.select(F.expr("cast(shiftrightunsigned(code, 40) as int) as top")).distinct().toArrow()  # 2**24 numbers at most
    sieve[top.column("top").to_numpy()] = True
    clean = _frequencies(rows.filter("label = 0"), sieve)
    seen = toxic.withColumnRenamed("n", "a").join(clean, "code", "left").withColumn("t", F.col("a") + F.coalesce("n", F.lit(0)))
    gap = (F.col("a") * n - F.col("t") * n1).cast("double")
    chi = gap * gap / (F.col("t") * (n - F.col("t")) + 1.0)
    best = np.array(seen.orderBy(chi.desc(), "code").limit(n_features).select("code", "a", "t").collect(), np.int64).reshape(-1, 3)
    best = best[np.argsort(best[:, 0].copy().view(np.uint64))]
    a, t = best[:, 1].astype(float), best[:, 2].astype(float)
    ratio = np.log((a + 1) / (n1 + 2)) - np.log((t - a + 1) / (n - n1 + 2))
    model = Model(best[:, 0].copy().view(np.uint64), ratio, 0.0)

    def features(batches):
        for part in (part for batch in batches for part in slices(batch, 1, 1 << 20)):
            texts = strings(part.column(1))
            found = [[] for _ in texts]
            for f, o in zip(*(x.tolist() for x in model.find(texts)), strict=True):
                found[o].append(f)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    kind = StructType([StructField("label", IntegerType()), StructField("found", ArrayType(IntegerType()))])
    data = rows.select("label", "text").mapInArrow(features, kind).orderBy("label", "found").toArrow().combine_chunks()  # bounded by the sample
    found = data.column("found").combine_chunks()
    owner = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
    w = _logistic(owner, found.flatten().to_numpy().astype(np.int64), ratio, data.column("label").to_numpy().astype(float), len(best), ridge)
    return Model(model.codes, w[:-1] * ratio, float(w[-1]))


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.7, text: str = "text", id: str = "doc_id", carry: list[str] | None = None,
          name: str = "score", decide: bool = True, **options) -> DataFrame:
    """Columns ``carry`` (default: id) of every document plus ``name`` (0..1, higher: more toxic) and predicted (1 from ``cut`` on).

    ``labels`` are the rows that may be learnt from.  Null and empty texts have
    no n-gram and take the intercept's score; whole texts of any length are
    read.  Repeated rows are scored alike; of an id on several rows the fit takes
    one text, and a label that is repeated counts once.  An empty table gives no
    rows; of columns whose names clash with added ones, the added one wins.  Labels without document, null labels and null ids
    are ignored; with one class only, every text gets that class's rate.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, text=text, id=id, **options)
    shared = spark.sparkContext.broadcast((model.codes, model.weights, model.bias))  # n_features numbers

    def make():
        model = Model(*shared.value)
        return lambda texts: [model.score(strings(texts))]

    out = add_columns(docs, text, make, [StructField(name, DoubleType())], carry or [id])
    return out.withColumn("predicted", (F.col(name) >= cut).cast("int")) if decide else out


def drop(docs: DataFrame, labels: DataFrame, cut: float = 0.7, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The documents that score below ``cut``, their columns unchanged; no shuffle of texts."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    out = score(docs, labels, cut, text, id, carry=docs.columns, name=name, decide=False, **options)
    return out.filter(F.col(name) < cut).select(*[column(c) for c in docs.columns])
