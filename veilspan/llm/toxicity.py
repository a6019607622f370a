"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are which of its words, pairs of neighbours and pairs with one word between them occur in it,
hashed to 2^BITS places. Training reads whole labelled texts one by one: each coordinate has its own learning rate,
from the sum of its squared gradients, and L1 keeps a weight at exactly zero until the evidence for it outgrows
lambda1. What is left is a short list of (place, weight), sent to all tasks; scoring is one narrow pass in which only
words that hit a weight cost more than their hash.

The model is fitted on at most MAX_ROWS labelled rows, those with the smallest hash of their id: the bound on the work
of the one task that fits it. Scores are probabilities of label 1 as they would be if both labels were equally common: the
bias is moved by the logarithm of how much rarer label 1 is among the labelled rows. A null or empty text has the score of the bias
alone. Labels that are null, or ids with two different labels, take no part in training. Repeated rows each get their
score. Extra columns are ignored. Ids must be whole numbers. Without any label the score is 0 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _spark, _text

#: Hash places of the features; labelled rows read in training; share of label 1 above which a text is toxic.
BITS, MAX_ROWS, THRESHOLD = 24, 9_000, 0.7
#: FTRL: learning rate, its smoothing, L1, L2, and passes over the rows.
ALPHA, BETA, LAMBDA1, LAMBDA2, PASSES = 4.0, 1.0, 4.0, 0.05, 3


def places(block: _text.Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of all words, pairs and skip pairs of a block, with repetitions."""
    words = block.words()
    h, text = words.hashes(), words.text_of()
    out = [(text, h)]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = text[:-gap] == text[gap:]
            out.append((text[:-gap][same], _text.mix64(h[:-gap][same] * np.uint64(salt) + h[gap:][same])))
    return np.concatenate([t for t, _ in out]), (np.concatenate([p for _, p in out]) >> np.uint64(64 - bits)).astype(np.int64)


def occurring(block: _text.Block, bits: int = BITS) -> list[np.ndarray]:
    """The distinct places of each text of a block."""
    text, place = places(block, bits)
    both = np.unique(text << np.int64(bits) | place)
    at = np.searchsorted(both, np.arange(block.n + 1) << np.int64(bits))
    both = (both & ((1 << bits) - 1)).astype(np.int32)
    return [both[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@dataclass(frozen=True)
class Weights:
    """A fitted model: the places with a weight, in order, their weights, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scorer(self):
        """A function that gives the score of each text of a block."""
        known = np.zeros(1 << self.bits, bool)
        known[self.places] = True

        def score(block: _text.Block) -> np.ndarray:
            text, place = places(block, self.bits)
            hit = known[place]
            both = np.unique(text[hit] << np.int64(self.bits) | place[hit])
            weight = self.weights[np.searchsorted(self.places, both & ((1 << self.bits) - 1))] if len(both) else np.zeros(0)
            total = self.bias + np.bincount(both >> self.bits, weights=weight, minlength=block.n)
            return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

        return score


def fit_ftrl(examples: list[tuple[np.ndarray, int]], alpha: float = ALPHA, beta: float = BETA, lambda1: float = LAMBDA1, lambda2: float = LAMBDA2, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) by FTRL-proximal over (places, label) in the order given. The bias has no penalty. A place
    that occurs in too few texts for its gradients, each below 1, to outgrow lambda1 gets no coordinate."""
    if not examples:
        return np.zeros(0, np.int64), np.zeros(0), -30.0
    count = np.zeros(1 + max((int(x[-1]) for x, _ in examples if len(x)), default=0), np.uint32)
    for x, _ in examples:
        count[x] += 1
    able = count * float(passes) > lambda1
    seen = np.flatnonzero(able)
    coordinate = np.cumsum(able, dtype=np.int32) - 1
    which = [coordinate[x[able[x]]] for x, _ in examples]
    z, n = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    bias = len(seen)

    def weights(i: np.ndarray) -> np.ndarray:
        own = z[i]
        w = -(own - np.sign(own) * lambda1) / ((beta + np.sqrt(n[i])) / alpha + lambda2)
        return np.where(np.abs(own) <= lambda1, 0.0, w)

    for _ in range(passes):
        for k, (_, label) in enumerate(examples):
            i = which[k]
            w = weights(i)
            wb = -z[bias] / ((beta + np.sqrt(n[bias])) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -30, 30))) - label
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
            step = (np.sqrt(n[bias] + g * g) - np.sqrt(n[bias])) / alpha
            z[bias] += g - step * wb
            n[bias] += g * g
    w = weights(np.arange(len(seen)))
    keep = np.flatnonzero(w)
    return seen[keep], w[keep], float(-z[bias] / ((beta + np.sqrt(n[bias])) / alpha))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: F.Column | None = None, max_rows: int = MAX_ROWS) -> Weights:
    """Fit on the texts of docs whose id has a label. usable: a condition on the id column of labels."""
    _spark.whole_ids(docs, id_col)
    agreed = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        agreed = agreed.where(usable)
    agreed = agreed.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other")).where("label = other")
    # at most max_rows ids, so small enough to send to all tasks
    chosen = agreed.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    one = texts.dropDuplicates(["id"]).select("id", "label", "text").repartition(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            ids, given = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high, block in _text.blocks(batch.column(2)):
                rows += zip(ids[low:high], given[low:high], occurring(block), strict=True)
        order = _text.mix64(np.array([r[0] for r in rows], np.int64).view(np.uint64)) if rows else []
        place, weight, bias = fit_ftrl([(rows[k][2], rows[k][1]) for k in np.argsort(order, kind="stable")] if rows else [])
        toxic = sum(r[1] for r in rows)
        bias += float(np.log((len(rows) - toxic) / toxic)) if 0 < toxic < len(rows) else 0.0
        yield pa.RecordBatch.from_pydict({"place": pa.array([-1, *place.tolist()], pa.int64()), "weight": pa.array([bias, *weight.tolist()], pa.float64())})

    found = one.mapInArrow(fit, "place long, weight double").collect()  # the weights that L1 has left
    found = sorted((r["place"], r["weight"]) for r in found)
    if not found:
        return Weights(np.zeros(0, np.int64), np.zeros(0), -30.0)
    return Weights(np.array([p for p, _ in found[1:]], np.int64), np.array([w for _, w in found[1:]]), found[0][1])


def score(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.scorer()
        for batch in batches:
            for low, high, block in _text.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(own(block), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Weights, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below threshold, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.scorer()
        for batch in batches:
            scores = [own(block) for _, _, block in _text.blocks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold if scores else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """The third of ids, by the CRC-32 of their decimal text, that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
