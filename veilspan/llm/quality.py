"""Quality classifier by co-training of two views.

The content view sees how the words of a text are written: the shapes of what stands between white space (letters,
capitals and digits as runs, other signs as they are), each with its share of the text, pairs of neighbouring shapes, and how much
the words repeat. The metadata view sees the columns beside the text and nothing of the text: language, source and
recorded length, alone and in pairs. Each view is a naive Bayes classifier over the places its features are hashed to: its
log-odds are the mean, over a row's places, of the logarithm of how much more often a place stands with label 1.
A view is calibrated (Platt scaling) on labelled rows that are never trained on, every fourth.

Both views start from the same labelled rows. In each of ROUNDS rounds they score every unlabelled row of the table, and
each hands the rows that it is sure of, with its own label, to the other; a row that the two are sure of but call differently is left alone. What
is handed over are sums, how often each place stands with each label, so the exchange covers all rows of a table of any
size in one narrow pass a round, and what comes to the driver has 2^BITS entries a view at most. The sums of a round
stand in for those of the round before and weigh as much as the labelled rows of their label, at most. At the end
a logistic regression over the two calibrated scores combines them; with too few labelled rows to calibrate on the mean of
the two log-odds stands instead.

At most LABELLED labelled rows are read, those with the smallest hash of their id; of rows that share an id one. The score
is the probability that quality is 1; scoring is one more narrow pass.

Null and empty texts have the features of an empty page. Null metadata is a value of its own. Labels that are null, or
ids with two different labels, take no part in fitting. Repeated rows each get their score. Extra columns are ignored;
a missing metadata column counts as null. Ids must be whole numbers. Without both labels among the rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _spark, _text

#: Hash places of a view's features; labelled rows read in fitting; rounds; texts that a place must stand in to count.
BITS, LABELLED, ROUNDS, LEAST = 16, 8_000, 3, 5
#: A view must be at least this sure of a row that it hands over; documents below KEEP are rejected.
SURE, KEEP = 0.95, 0.5
METADATA = ("lang", "source", "n_chars")

_U = np.uint64


def _classes() -> np.ndarray:
    """Letters 1 (those outside ASCII too), capitals 2, digits 3, other signs by their code."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123], out[128:], out[65:91], out[48:58] = 1, 1, 2, 3
    return out


_CLASS = _classes()


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Halvings from the whole to the part: 0 for more than half, 15 for less than 2^-14 or nothing."""
    ratio = np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)
    return np.where(ratio > 0, np.clip(-np.log2(np.maximum(ratio, 2.0**-15)), 0, 14).astype(np.int64), 15)


def _place(kind: int, value: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (_text.mix64(_text.mix64(value.astype(np.int64).view(_U)) + _U(kind)) >> _U(64 - bits)).astype(np.int64)


def _named(kind: int, values: pa.Array, bits: int = BITS) -> np.ndarray:
    texts = values.cast(pa.string()).fill_null("\x00")
    words = [_text.Words(b, b.bounds[:-1], b.bounds[1:]) for _, _, b in _text.blocks(texts)]
    return _place(kind, np.concatenate([w.hashes(fold=False) for w in words]).view(np.int64), bits)


def views(block: _text.Block, meta: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, place) of the features of the two views, sorted and distinct."""
    n, data = block.n, block.data
    tokens = block.words(_text.NON_SPACE)
    owner, per = tokens.text_of(), tokens.per_text
    # content: shapes, as runs of classes
    kind = _CLASS[data]
    keep = _text.NON_SPACE[data]
    run = keep.copy()
    run[1:] &= (kind[1:] != kind[:-1]) | ~keep[:-1]
    run[tokens.start] = True
    at = np.concatenate([[0], np.cumsum(run)])
    shape = _text.Words(_text.Block(kind[run], np.zeros(1)), at[tokens.start], at[tokens.end]).hashes(fold=False)
    names, which = np.unique(shape, return_inverse=True)
    both, count = np.unique(owner * max(1, len(names)) + which, return_counts=True)
    text, name = both // max(1, len(names)), both % max(1, len(names))
    content = [(text, _place(1, names[name].view(np.int64)) ^ _share_bin(count, per[text])), (text, _place(2, names[name].view(np.int64)))]
    near = np.flatnonzero(owner[1:] == owner[:-1])
    content.append((owner[near], _place(3, (shape[near] * _U(0x9E3779B97F4A7C15) + shape[near + 1]).view(np.int64))))
    hashes = tokens.hashes()
    mixed = np.sort(_text.mix64(hashes) >> _U(24) | (owner.astype(_U) << _U(40)))
    fresh = np.append(True, mixed[1:] != mixed[:-1])[: len(mixed)]
    distinct = np.bincount((mixed[fresh] >> _U(40)).astype(np.int64), minlength=n)
    first = np.flatnonzero(fresh)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, (mixed[first] >> _U(40)).astype(np.int64), np.diff(np.append(first, len(mixed))))
    every = np.arange(n)
    content += [(every, _place(4, _share_bin(per - distinct, per))), (every, _place(5, _share_bin(most, per) * 16 + np.minimum(np.log2(per + 1), 15).astype(np.int64)))]
    # metadata: the columns beside the text
    lang, source, length = (_named(11 + k, column) for k, column in enumerate(meta))
    pair = lambda k, x, y: _place(k, x * (1 << BITS) + y)
    page = [(every, x) for x in (lang, source, length, pair(14, lang, source), pair(15, lang, length), pair(16, source, length))]
    out = []
    for parts in (content, page):
        joined = np.unique(np.concatenate([t for t, _ in parts]) << np.int64(BITS) | np.concatenate([p for _, p in parts]))
        out.append((joined >> BITS, joined & ((1 << BITS) - 1)))
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a small dense logistic regression by Newton's method, the bias last and free of the ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    free = np.append(np.full(x.shape[1], ridge), 1e-9)
    for _ in range(steps):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(free + 1e-9), a.T @ (p - y) + free * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """For each view the log-ratio of each place and its calibration (slope, offset), and the weights that combine them."""

    ratios: tuple[np.ndarray, np.ndarray]
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combined: tuple[float, float, float]

    def means(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[np.ndarray]:
        """For each view the mean log-ratio of each row's places that have one."""
        out = []
        for (text, place), ratio in zip(found, self.ratios, strict=True):
            own = ratio[place]
            out.append(np.bincount(text, weights=own, minlength=n) / np.maximum(1, np.bincount(text, weights=own != 0, minlength=n)))
        return out

    def log_odds(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[np.ndarray]:
        return [slope * m + offset for m, (slope, offset) in zip(self.means(found, n), self.calibration, strict=True)]

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Content score, metadata score and combined score."""
        a, b = self.log_odds(found, n)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combined[0] * a + self.combined[1] * b + self.combined[2])

    def handed(self, found: list[tuple[np.ndarray, np.ndarray]], n: int, sure: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view the rows handed to it, and their labels, by the other one."""
        p = [_sigmoid(x) for x in self.log_odds(found, n)]
        call = [np.where(x >= sure, 1, np.where(x <= 1 - sure, 0, -1)) for x in p]
        agreed = (call[0] < 0) | (call[1] < 0) | (call[0] == call[1])
        rows = [np.flatnonzero((call[1 - view] >= 0) & agreed) for view in (0, 1)]
        return [(rows[view], call[1 - view][rows[view]]) for view in (0, 1)]


NEUTRAL = Model((np.zeros(1 << BITS), np.zeros(1 << BITS)), ((1.0, 0.0), (1.0, 0.0)), (0.0, 0.0, 0.0))


class Sums:
    """For each view how many rows of each label there are (at the last place) and how often each place stands with it."""

    def __init__(self):
        self.n = np.zeros((2, 2, (1 << BITS) + 1))

    def add(self, view: int, label: int, places: np.ndarray, rows: int) -> None:
        self.n[view, label, :-1] += np.bincount(places, minlength=1 << BITS)
        self.n[view, label, -1] += rows

    def batch(self) -> pa.RecordBatch:
        view, place = np.nonzero(self.n.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(place, pa.int32()), *(pa.array(self.n[view, y, place].astype(np.int64)) for y in (0, 1))], names=["view", "place", "n0", "n1"])

    @staticmethod
    def of(df: DataFrame, count) -> Sums:
        """The sums over a frame; count gives those of the batches of a task. At most 2^(BITS + 1) + 2 rows come back."""
        out = Sums()
        found = df.mapInArrow(lambda batches: iter([count(batches).batch()]), "view int, place int, n0 long, n1 long")
        table = found.groupBy("view", "place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        for y in (0, 1):
            out.n[table["view"].to_numpy(), y, table["place"].to_numpy()] = table[f"n{y}"].to_numpy()
        return out


def ratios(labelled: Sums, given: Sums | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The log-ratios of both views from the labelled rows and those handed over, which weigh no more than the former."""
    out = []
    for view in (0, 1):
        n = labelled.n[view].copy()
        if given is not None:
            for y in (0, 1):
                rows = given.n[view, y, -1]
                n[y] += given.n[view, y] * (min(1.0, labelled.n[view, y, -1] / rows) if rows else 0.0)
        share = np.log((n[:, :-1] + 1) / (n[:, -1:] + 2))
        out.append(np.where(n[:, :-1].sum(axis=0) >= LEAST, share[1] - share[0], 0.0))
    return out[0], out[1]


def calibrated(model: Model, means: list[np.ndarray], y: np.ndarray) -> Model:
    """The model calibrated and combined on rows apart, given their means and labels; as it is if they lack a label."""
    if len(set(y.tolist())) < 2:
        return Model(model.ratios, ((1.0, 0.0), (1.0, 0.0)), (0.5, 0.5, 0.0))
    found, odds = [], []
    for own in means:
        scale = max(float(np.abs(own).std()), 1e-9)
        slope, offset = logistic((own / scale)[:, None], y, ridge=0.1)
        found.append((float(max(slope, 0.0)) / scale, float(offset)))
        odds.append(found[-1][0] * own + found[-1][1])
    return Model(model.ratios, (found[0], found[1]), tuple(float(w) for w in logistic(np.column_stack(odds), y, ridge=0.1)))


def _page_columns(docs: DataFrame, text_col: str) -> list[F.Column]:
    """The text and the metadata, the recorded length by its order of magnitude."""
    known = {c.lower() for c in docs.columns}
    n = F.floor(F.log2(F.col("n_chars").cast("double") + 1)) if "n_chars" in known else F.lit(None)
    return [F.col(text_col).cast("string"), *((F.col(c) if c in known else F.lit(None)).cast("string") for c in METADATA[:2]), n.cast("string")]


def _page(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, *meta = _page_columns(docs, text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), *(c.alias(f"m{k}") for k, c in enumerate(meta)))


def _found(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """The views of a batch (.., text, metadata), block by block. batch: text at 1, then the metadata."""
    for low, high, block in _text.blocks(batch.column(1)):
        yield low, high, views(block, [batch.column(2 + k).slice(low, high - low) for k in range(len(METADATA))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: F.Column | None = None, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Fit on docs. usable: a condition on the id column of labels; rows without a usable label count as unlabelled."""
    _spark.whole_ids(docs, id_col)
    spark, scratch = docs.sparkSession, _spark.Scratch(docs.sparkSession)
    agreed = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        agreed = agreed.where(usable)
    agreed = agreed.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other")).where("label = other").select("id", "label")
    # a bounded list, so small enough to send to all tasks
    known = agreed.orderBy(F.xxhash64("id"), "id").limit(labelled)
    page = _page(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    rows = page.join(F.broadcast(known), "id").select("id", "text", "m0", "m1", "m2", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in _found(batch):
                lists = []
                for text, place in found:
                    at = np.searchsorted(text, np.arange(high - low + 1))
                    lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(place, pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(5).slice(low, high - low), *lists], names=["id", "label", "content", "page"])

    found = rows.mapInArrow(extract, "id long, label int, content array<int>, page array<int>")
    one = scratch.stored(found.groupBy("id").agg(F.min(F.struct("label", "content", "page")).alias("x")).select("id", "x.*"), "labelled")
    ids = one.select("id", "label").orderBy(F.xxhash64("id"), "id").toArrow()  # at most labelled rows
    order, label = ids["id"].to_numpy(), ids["label"].to_numpy()
    apart, base = order[3::4], np.delete(order, np.s_[3::4])
    if len(set(label[3::4].tolist())) < 2 or len(set(np.delete(label, np.s_[3::4]).tolist())) < 2:
        apart, base = order[:0], order
    if len(set(label.tolist())) < 2:
        scratch.clear()
        return NEUTRAL
    sent = spark.sparkContext.broadcast((np.sort(apart), np.sort(order)))

    def lists(batch: pa.RecordBatch, use: np.ndarray) -> tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]:
        batch = batch.filter(pa.array(use))
        found = []
        for column in ("content", "page"):
            own = batch.column(column)
            size = np.diff(own.offsets.to_numpy())
            found.append((np.repeat(np.arange(len(own)), size), own.flatten().to_numpy().astype(np.int64)))
        return batch, found

    def count_base(batches: Iterator[pa.RecordBatch]) -> Sums:
        out = Sums()
        for batch in batches:
            batch, found = lists(batch, ~np.isin(batch.column("id").to_numpy(), sent.value[0]))
            y = batch.column("label").to_numpy()
            for view, (text, place) in enumerate(found):
                for label in (0, 1):
                    out.add(view, label, place[y[text] == label], int((y == label).sum()))
        return out

    def calibrate(model: Model) -> Model:
        own = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch, found = lists(batch, np.isin(batch.column("id").to_numpy(), sent.value[0]))
                means = own.value.means(found, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *map(pa.array, means)], names=["id", "label", "a", "b"])

        table = one.mapInArrow(run, "id long, label int, a double, b double").orderBy("id").toArrow()
        return calibrated(model, [table[c].to_numpy() for c in ("a", "b")], table["label"].to_numpy().astype(float))

    own = Sums.of(one, count_base)
    model = calibrate(Model(ratios(own), NEUTRAL.calibration, NEUTRAL.combined))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def count_given(batches: Iterator[pa.RecordBatch], now=now) -> Sums:
            out = Sums()
            for batch in batches:
                fresh = ~np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), sent.value[1]) | np.asarray(batch.column(0).is_null())
                batch = batch.filter(pa.array(fresh))
                for low, high, found in _found(batch):
                    for view, (rows, called) in enumerate(now.value.handed(found, high - low, sure)):
                        to = np.full(high - low, -1)
                        to[rows] = called
                        text, place = found[view]
                        for label in (0, 1):
                            out.add(view, label, place[to[text] == label], int((called == label).sum()))
            return out

        model = calibrate(Model(ratios(own, Sums.of(page, count_given)), NEUTRAL.calibration, NEUTRAL.combined))
    scratch.clear()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content_score, metadata_score, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in _found(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(s, pa.float64()) for s in sent.value.scores(found, high - low))], names=["id", "content_score", "metadata_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _page(docs, id_col, text_col).mapInArrow(run, f"id {kind}, content_score double, metadata_score double, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of docs that score at least least, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept, names = docs.schema, docs.columns
    beside = docs.select("*", *(c.alias(f"__{k}") for k, c in enumerate(_page_columns(docs, text_col))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(list(range(len(names))))
            page = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), *batch.columns[len(names) :]], names=[str(k) for k in range(len(METADATA) + 2)])
            flags = [sent.value.scores(found, high - low)[2] >= least for low, high, found in _found(page)]
            yield own.filter(pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))

    return beside.mapInArrow(run, kept)
