"""Text quality by Bradley-Terry pairwise ranking."""

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from leadloom.llm.batches import add_columns, ship, text_bytes
from leadloom.llm.common import hash60, staged
from leadloom.llm.labels import sample
from leadloom.operators.reports import order_statistics

FEATURES = ["symbols", "exclamations", "bars", "capitals", "digits", "spaces", "beyond_ascii", "distinct_words",
            "adjacent_repeats", "mean_word", "distinct_lines", "log_length"]
_SYMBOL = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ".,'-" for b in range(256)])
_UPPER, _DIGIT, _BEYOND = (np.array([f(b) for b in range(256)]) for f in (
    lambda b: 0x41 <= b <= 0x5A, lambda b: 0x30 <= b <= 0x39, lambda b: b >= 0x80))


def measures(text: bytes) -> list[float]:
    """The features of a whole text; shares are of its bytes, words or lines, under a square root so that small ones count."""
    counts, n = np.bincount(np.frombuffer(text, np.uint8), minlength=256), max(1, len(text))
    words = text.split()
    m, lines = max(1, len(words)), [x for x in text.split(b"\n") if x]
    shares = [counts[_SYMBOL].sum() / n, counts[0x21] / n, counts[0x7C] / n, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n,
              counts[0x20] / n, counts[_BEYOND].sum() / n, len(set(words)) / m, sum(map(eq, words, words[1:])) / m]
    return [float(x) ** 0.5 for x in shares] + [min(n / m, 100.0) / 10, len(set(lines)) / max(1, len(lines)), float(np.log1p(len(text))) / 10]


@dataclass
class Ranking:
    """A linear score: (features - mean) / scale, times weights, less the threshold; 0 marks the cut."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float

    def strength(self, features: str) -> Column:
        """Bradley-Terry strength over the threshold, native."""
        out = F.lit(-self.threshold)
        for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights, strict=True)):
            out = out + (F.col(features)[i] - m) / s * w
        return out


#: Labelled rows of a block, most blocks, pairs that a block forms at least (or all of its pairs), and partners that every row meets.
BLOCK, BLOCKS, PAIRS, PARTNERS = 4096, 512, 100_000, 8
_WIDTH = len(FEATURES)


def pairs(rows: np.ndarray, good: np.ndarray, weight: np.ndarray):
    """Feature differences (good - bad) and weights of the pairs of a block, one array per partner: every row meets rows of the other class."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    many, few = (a, b) if len(a) >= len(b) else (b, a)
    if not len(few):
        return
    for s in range(min(len(few), max(PARTNERS, -(-PAIRS // len(many))))):
        other = few[(np.arange(len(many)) + s) % len(few)]
        diff = rows[many] - rows[other]
        yield (diff if many is a else -diff), weight[many] * weight[other]


def blocks(known: DataFrame) -> tuple[DataFrame, int, int]:
    """(block, features, good, weight, own), one row per block of labelled rows (id, label, n, _features), and the labels of either class.

    Rows are dealt into blocks by a hash of their id; where one class is so rare
    that a block would see little of it, its rows are put into several blocks, of
    which one owns it.  Every row is in a block, and a block's rows are in a fixed order.
    """
    counts = {r["label"] == 1: (r["rows"], r["n"]) for r in
              known.groupBy((F.col("label") == 1).alias("label")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    (good, n_good), (bad, n_bad) = counts.get(True, (0, 0)), counts.get(False, (0, 0))
    n = max(1, min(BLOCKS, max(good, bad) // BLOCK))
    copies = min(n, -(-BLOCK // 4 * n // max(1, min(good, bad))))
    rare = (F.col("label") == 1) == F.lit(good < bad)
    key = hash60(F.col("id"))
    dealt = known.select(key.alias("h"), (F.col("label") == 1).alias("good"), F.col("n").cast("double").alias("n"), "_features",
                         F.explode(F.sequence(F.lit(0), F.when(rare, F.lit(copies - 1)).otherwise(F.lit(0)))).alias("copy"))
    dealt = dealt.withColumn("block", F.pmod(F.col("h") + F.col("copy"), F.lit(n)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        x = table.column("_features").combine_chunks().flatten().to_numpy().reshape(-1, _WIDTH)
        h, good, weight, copy = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "good", "n", "copy"))
        order = np.lexsort((*x.T, weight, good, h))
        values = (x[order].tobytes(), good[order].tobytes(), weight[order].tobytes(), (copy[order] == 0).tobytes())
        return pa.table({"block": table.column("block").slice(0, 1), **{c: pa.array([v], pa.binary()) for c, v in zip(PACKED, values, strict=True)}})

    packed = ship(dealt).groupBy("block").applyInArrow(pack, "block int, " + ", ".join(f"{c} binary" for c in PACKED))
    return staged(packed, "labelled"), n_good, n_bad


PACKED = ("features", "good", "weight", "own")


def total(packed: DataFrame, measure) -> np.ndarray:
    """Sum over the blocks of ``measure(rows, good, weight, own)``, an array of fixed length; added in the order of the blocks."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, good, weight, own = (np.frombuffer(row[c], t) for c, t in zip(PACKED, (float, bool, float, bool), strict=True))
                yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int32()), "value": pa.array([measure(x.reshape(-1, _WIDTH), good, weight, own).tolist()], pa.list_(pa.float64()))})

    found = ship(packed).mapInArrow(run, "block int, value array<double>").orderBy("block").collect()  # BLOCKS rows at most
    return np.sum([r["value"] for r in found], axis=0)


def fit(known: DataFrame, ridge: float = 1e-3) -> Ranking:
    """Weights by logistic loss on the feature differences of (good, bad) pairs, and a threshold by score quantile.

    All labelled rows (id, label, n times, _features) take part: means, scales and
    ranks count each label, and every row forms pairs with rows of the other class
    in its blocks (``blocks``, ``pairs``).  The loss is minimised by Newton steps,
    each one pass over the blocks, of which a gradient and a curvature reach the
    driver.  The threshold is the score quantile at the share of bad labels,
    midway between the scores on its two sides.  With only one class there are no
    pairs: all weights are 0 and every score is at the threshold's upper side.
    """
    d, zero = _WIDTH, [0.0] * _WIDTH
    packed, n_good, n_bad = blocks(known)
    if not (n_good and n_bad):
        return Ranking(zero, [1.0] * d, zero, 0.0)
    mean = total(packed, lambda x, good, weight, own: (x * (weight * own)[:, None]).sum(0)) / (n_good + n_bad)
    spread = np.sqrt(total(packed, lambda x, good, weight, own: ((x - mean) ** 2 * (weight * own)[:, None]).sum(0)) / (n_good + n_bad))
    scale = np.where(spread > 1e-9, spread, 1.0)
    w = np.zeros(d)

    def step(x, good, weight, own):
        slope, curve, size = np.zeros(d), np.zeros((d, d)), 0.0
        for diff, much in pairs((x - mean) / scale, good, weight):
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            slope += diff.T @ ((p - 1) * much)
            curve += (diff * (p * (1 - p) * much)[:, None]).T @ diff
            size += much.sum()
        return np.concatenate((slope, curve.ravel(), [size]))

    for _ in range(30):
        found = total(packed, step)
        slope, curve = found[:d] / found[-1] + ridge * w, found[d:-1].reshape(d, d) / found[-1] + ridge * np.eye(d)
        move = np.linalg.solve(curve, slope)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    model = Ranking(mean.tolist(), scale.tolist(), w.tolist(), 0.0)
    scores = staged(known.select(model.strength("_features").alias("s"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("s"), "strengths")
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    cut = order_statistics(scores, "s", [n_bad - 1, n_bad], low, high)
    return Ranking(model.mean, model.scale, model.weights, (cut[n_bad - 1] + cut[n_bad]) / 2)


def score(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, cut: float = 0.3, id: str = "doc_id",
          text: str = "text", label_id: str = "doc_id", label: str = "quality", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: id) of every document plus features, score and predicted.

    ``labels`` are the rows that may be learnt from, all of them; only where a
    caller gives ``max_labelled`` the fit takes that many, in hash order.  ``score`` lies in 0..1 and is at
    least ``cut`` exactly where the Bradley-Terry strength reaches the
    threshold.  Null and empty texts have the features of an empty text.
    Repeated rows are scored alike; a label repeated for an id counts each time,
    with the mean features of the different texts of its id, so that copies of a
    document weigh nothing and the fit has one row per label; labels of ids without document, null labels and null ids are ignored.
    Without labels of both kinds every score is ``cut``.

    One pass over the texts writes the features (12 numbers a document); the fit
    reads those of labelled documents in a few passes, and scoring is a native expression.
    """
    carry = carry or [id]
    fields = [StructField("_features", ArrayType(DoubleType()))]
    rows = add_columns(docs, text, lambda: lambda texts: [[measures(t) for t in text_bytes(texts)]], fields, carry)
    rows = staged(rows, "features")
    chosen = sample(labels, label_id, label, max_labelled).groupBy("id", "label").agg(F.count("*").alias("n"))
    once = rows.select(F.col(id).alias("id"), "_features").distinct().join(chosen.select("id").distinct(), "id", "left_semi")
    means = [F.avg(F.col("_features")[i].cast("decimal(28,20)").cast("decimal(38,20)")).cast("double") for i in range(len(FEATURES))]
    known = once.groupBy("id").agg(F.array(*means).alias("_features")).join(chosen, "id")  # one row per labelled id and label
    model = fit(staged(known, "known"))
    raw = model.strength("_features")
    value = 1 / (1 + F.exp(-(raw + float(np.log(cut / (1 - cut))))))
    good = raw >= 0
    value = F.when(good, F.greatest(value, F.lit(cut))).otherwise(F.least(value, F.lit(float(np.nextafter(cut, 0)))))
    return rows.select(*carry, F.col("_features").alias("features"), value.alias("score"), good.cast("int").alias("predicted"))
