"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its runs of five words, each weighted by how often it stands there. For each sample k and
term the term's hash alone draws r and c from Gamma(2, 1) and b from [0, 1); with weight w

    t = floor(ln w / r + b),    a = c * exp(-r * (t - b + 1)),

and the sample is the (term, t) with the smallest a. Two texts agree in a sample with the probability of their
generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger ones. A fingerprint is SAMPLES
such samples, 16 bits each, in hexadecimal; the likeness of two is the share of places where they agree.

The draws are read from tables of the inverse distribution functions, 16 bits of hash each.

A text of fewer than five words has one term, all its words; a text without words (null or empty included) has the
fingerprint of "ffff" at all places, like only to its equals. Equal texts have equal fingerprints.

Neighbours in descending id order are found without putting all rows in order in one place: ids are cut into ranges by
their quantiles, each range is sorted on its own, and the first row of each range is also sent to the range before, as
the boundary record that its last row needs. Equal ids stand in the order of their texts; rows without an id come last.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _text

#: Samples of a fingerprint, words of a term.
SAMPLES, SIZE = 64, 5
#: Terms whose samples are drawn at once.
_AT_ONCE = 1 << 15


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) and its logarithm at the middle of each of 65,536 equal shares of probability."""
    share = (np.arange(65536) + 0.5) / 65536
    x = np.full(65536, 1.5)
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):  # bisection of 1 - (1 + x) e^-x
        less = 1 - (1 + x) * np.exp(-x) < share
        low, high = np.where(less, x, low), np.where(less, high, x)
        x = (low + high) / 2
    return x.astype(np.float32), np.log(x).astype(np.float32)


def weighted_terms(words: _text.Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each text of a block, text after text: (text, term, weight)."""
    terms, number = words.shingles(size)
    if not len(terms):
        return np.zeros(0, np.int64), terms, np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(number)), number)
    order = np.argsort(terms)
    order = order[np.argsort(text[order], kind="stable")]
    terms = terms[order]
    fresh = np.ones(len(terms), bool)
    fresh[1:] = (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    return text[at], terms[at], np.diff(np.append(at, len(terms)))


def signatures(text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, samples: int = SAMPLES) -> np.ndarray:
    """The samples of n weighted sets as 16-bit numbers, a row for each set; 65535 throughout for an empty set."""
    gamma, log_gamma = _tables()
    u64, f32 = np.uint64, np.float32
    out = np.full((n, samples), 0xFFFFFFFFFFFFFFFF, u64)
    log_w = np.log(weight.astype(f32))
    mixed, spare = np.empty(_AT_ONCE, u64), np.empty(_AT_ONCE, u64)
    draws = [np.empty(_AT_ONCE, f32) for _ in range(3)]
    for low in range(0, len(term), _AT_ONCE):
        own, h, lw = text[low : low + _AT_ONCE], term[low : low + _AT_ONCE], log_w[low : low + _AT_ONCE]
        heavy = np.flatnonzero(lw > 0)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        rows = own[starts]
        u, v = mixed[: len(h)], spare[: len(h)]
        r, log_a, b = (x[: len(h)] for x in draws)
        for k in range(samples):
            np.multiply(h, u64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF), out=u)
            np.bitwise_xor(u, np.right_shift(u, u64(29), out=v), out=u)
            np.multiply(u, u64(0xBF58476D1CE4E5B9), out=u)
            np.bitwise_xor(u, np.right_shift(u, u64(32), out=v), out=u)
            # 16 bits each for r, b and c
            gamma.take(np.bitwise_and(u, u64(0xFFFF), out=v).view(np.int64), out=r, mode="clip")
            log_gamma.take(np.right_shift(u, u64(48), out=v).view(np.int64), out=log_a, mode="clip")
            np.multiply(np.right_shift(u, u64(16), out=v).view(np.uint16)[::4], f32(1 / 65536), out=b, casting="unsafe", dtype=f32)
            if len(heavy):
                some_r, some_b, some_c = r[heavy], b[heavy], log_a[heavy]
                t = np.floor(lw[heavy] / some_r + some_b)
                heavy_a = some_c - some_r * (t - some_b + 1)
            # weight 1: t = 0
            np.add(log_a, np.multiply(np.subtract(b, f32(1), out=b), r, out=b), out=log_a)
            name = np.right_shift(np.multiply(u, u64(0x94D049BB133111EB), out=v), u64(32), out=v)
            if len(heavy):
                log_a[heavy] = heavy_a
                name[heavy] ^= _text.mix64(t.astype(u64)) >> u64(32)  # 0 for t = 0
            # the order of floats as the order of unsigned numbers, the sample's name below
            bits = log_a.view(np.int32)
            key = (bits ^ ((bits >> 31) | np.int32(-(2**31)))).view(np.uint32).astype(u64)
            key <<= u64(32)
            key |= name
            out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(key, starts))
    empty = out[:, 0] == 0xFFFFFFFFFFFFFFFF
    short = (_text.mix64(out & u64(0xFFFFFFFF)) % u64(65535)).astype(np.uint16)
    short[empty] = 0xFFFF
    return short


def sketch(texts: pa.Array, samples: int = SAMPLES, size: int = SIZE) -> np.ndarray:
    """The samples of each text of a string array."""
    parts = [signatures(*weighted_terms(b.words(), size), b.n, samples) for _, _, b in _text.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, samples), np.uint16)


def _hex(rows: np.ndarray) -> list[str]:
    raw = rows.astype(">u2").tobytes().hex()
    width = rows.shape[1] * 4
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, size: int = SIZE) -> DataFrame:
    """(id, fingerprint) of each text; a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(sketch(batch.column(1), samples, size)), pa.string())], names=["id", "fingerprint"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def likeness(left: F.Column, right: F.Column, samples: int = SAMPLES) -> F.Column:
    """The share of places where two fingerprints agree."""
    same = lambda k: F.when(F.substring(left, 4 * k + 1, 4) == F.substring(right, 4 * k + 1, 4), 1).otherwise(0)
    return sum((same(k) for k in range(1, samples)), same(0)) / F.lit(float(samples))


def ranged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, tail, id, text) sorted within partitions by descending id, equal ids by text. Each range ends with a
    tail: the first row of the next range, or of the first range after the last."""
    spark = df.sparkSession
    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = chosen.select("id")
    # a bounded summary of all ids: as many quantiles as there are ranges
    splits = sorted(set(ids.where("id IS NOT NULL").approxQuantile("id", [k / (parts * 4) for k in range(1, parts * 4)], 0.1 / (parts * 4))))
    edges = spark.sparkContext.broadcast(np.array(splits, np.float64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            low = len(edges.value) - np.searchsorted(edges.value, known.astype(np.float64), "left")
            low[np.asarray(batch.column(0).is_null())] = len(edges.value) + 1
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), *batch.columns], names=["range", *batch.schema.names])

    schema = "range long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema)
    placed = chosen.mapInArrow(place, schema)
    # one row for each range: its first id, and the least text among the rows with that id
    heads = ids.mapInArrow(place, "range long, id long").groupBy("range").agg(F.max("id").alias("id")).collect()
    heads = sorted((r["range"], r["id"]) for r in heads)
    if not heads:
        return placed.select("range", F.lit(0).alias("tail"), "id", "text")
    # a row for each range: small enough to send to all tasks
    before = spark.createDataFrame([(heads[k][1], heads[k - 1][0]) for k in range(len(heads))], "head long, range long")
    tails = chosen.join(F.broadcast(before), F.col("id").eqNullSafe(F.col("head"))).groupBy("range", "id").agg(F.min("text").alias("text"))
    both = placed.select("range", F.lit(0).alias("tail"), "id", "text").unionByName(tails.select("range", F.lit(1).alias("tail"), "id", "text"))
    return both.repartition(parts, "range").sortWithinPartitions("range", "tail", F.col("id").desc_nulls_last(), "text")


def neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, size: int = SIZE) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against its edit,
    the last half of its code points replaced by as many first ones of the next text in descending id order (after the
    last: the first), and against that next text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, which waits for the next
        for batch in batches:
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            yield from pairs(rows)
            held = rows.slice(rows.num_rows - 1)

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = _text.string_parts(rows.column("text"))
        at = 0
        while at < rows.num_rows - 1:
            end = at + max(2, int(np.searchsorted(bounds[at:], bounds[at] + _text.BLOCK_BYTES, "right")) - 1)
            end = min(end, rows.num_rows)
            yield some(rows.slice(at, end - at))
            at = end - 1

    def some(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids = rows.column("text").to_pylist(), rows.column("id")
        same = rows.column("range").to_numpy()
        use = np.flatnonzero((same[:-1] == same[1:]) & (rows.column("tail").to_numpy()[:-1] == 0))
        edited = []
        for i in use.tolist():
            own, half = texts[i], len(texts[i]) // 2
            edited.append(own[: len(own) - half] + texts[i + 1][:half])
        own = sketch(rows.column("text"), samples, size)
        other = sketch(pa.array(edited, pa.string()), samples, size)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(use)), pa.array([len(texts[i]) for i in use.tolist()], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(_hex(own[use]), pa.string()), pa.array(_hex(other), pa.string()), pa.array((own[use] == other).mean(axis=1), pa.float64()), pa.array((own[use] == own[use + 1]).mean(axis=1), pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ranged(df, id_col, text_col).mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
