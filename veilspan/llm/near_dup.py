"""Near-duplicate detection with DartMinHash signatures.

Texts are the weighted sets of their runs of five words. Two texts are linked if the generalised Jaccard similarity of
these sets is at least THRESHOLD; a class is what links join together.

1. One pass gives each row a number of its own, and each text a digest and BANDS keys of ROWS signature coordinates. Rows
   with the same digest are one node from here on, whatever their ids, so exact copies cost one row each.
2. Nodes that share a key stand in a bucket. Each bucket has a centre, the member whose buckets are largest in sum: of a
   text and its edited copies that is the text itself. Every member is compared with its centre, exactly.
3. Buckets whose members, the centre aside, are still in different classes are solved whole, the centre aside: all pairs
   are compared exactly, as products of the members' term matrix, and only links that join classes are given out. Of
   buckets with the same members one is solved. Large buckets are cut into blocks of about BLOCK members and UNITS
   units of their sets, and each pair of blocks is solved on its own, so no task holds more than two blocks.

No step makes a row for each pair of a bucket. Links become classes by hooking each node to its smallest neighbour
and contracting, all in tables; nothing that grows with the documents comes to the driver. Joins on keys that may be hot
have a stored table on the other side, so that adaptive execution can split them.

A pair with similarity 0.8 shares no bucket with a probability of 7e-5; no pair below THRESHOLD is ever linked.

Null texts are empty. Texts without words are alike only if they are equal. A text of fewer than five words has one run.
A class is one of texts: rows that share an id but not their text may be in different classes, and each row has the class
of its own text. A class is named by the smallest id in it; of two classes with the same smallest id, which takes an id
with several texts, either bears it. Rows without an id take no part, and their class is null. Ids must be whole numbers.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _spark, _text
from veilspan.llm.fingerprints import weighted_terms

#: Words of a term, similarity of a link, bands of a signature and coordinates of a band.
SIZE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
#: Members of a block and units of their sets (128 MB); up to so many ids the candidates are sent to all tasks, beyond that joined.
BLOCK, UNITS, SENT_IDS = 192, 16 << 20, 500_000


def darts(text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """DartMinHash signatures of n weighted sets, a row of k coordinates each. text (ascending), term and weight list the sets' elements.

    An element's weight is laid out in cells of width 1. Darts fall on a cell as a Poisson process along an axis of
    ranks, drawn from the hash of element and cell alone; each dart has a height within the cell, and hits if that lies
    below the element's weight, and a coordinate. A coordinate keeps its earliest dart. Only ranks up to a limit
    are drawn, at which a set of its total weight has k ln k + 3 k darts to expect; sets with a coordinate still
    empty are drawn again up to twice the limit. A set without weight has zeros."""
    out = np.full(n * k, 0xFFFFFFFFFFFFFFFF, np.uint64)
    total = np.bincount(text, weights=weight, minlength=n)
    cells = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(term)), cells)
    number = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    unit = _text.mix64(term[at] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    owner = text[at]
    height = np.minimum(weight[at] - number, 1.0)
    limit = np.divide(k * np.log(k) + 3 * k, total, out=np.zeros(n), where=total > 0)
    while True:
        u, rank, who, top = unit, np.zeros(len(unit)), owner, height
        draw = 0
        while len(u):
            draw += 1
            h = _text.mix64(u + np.uint64(draw * 0xD6E8FEB86659FD93 % (1 << 64)))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = np.flatnonzero(rank < limit[who])
            u, rank, who, top, h = u[on], rank[on], who[on], top[on], h[on]
            g = _text.mix64(h ^ np.uint64(0xA0761D6478BD642F))
            hit = ((g >> np.uint64(40)).astype(np.float64) * 2.0**-24) < top
            slot = who * k + (g % np.uint64(k)).astype(np.int64)
            # ranks in order, then the dart's name
            key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, slot[hit], key[hit])
        sparse = (out.reshape(n, k) == 0xFFFFFFFFFFFFFFFF).any(axis=1) & (total > 0)
        if not sparse.any():
            break
        again = sparse[owner]
        unit, owner, height = unit[again], owner[again], height[again]
        limit = np.where(sparse, limit * 2, limit)
    out = _text.mix64(out.reshape(n, k))
    out[total <= 0] = 0
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of each signature; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(_text.mix64(np.arange(bands, dtype=np.uint64) + np.uint64(0xB5)), (len(signature), bands)).copy()
    for r in range(rows):
        key = _text.mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def signed(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(row, id, digest, keys) of each row with an id, row a number of its own; no keys for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, block in _text.blocks(batch.column(1)):
                text, term, weight = weighted_terms(block.words(), size)
                keys = band_keys(darts(text, term, weight.astype(np.float64), block.n, bands * rows), bands, rows)
                some = np.bincount(text, minlength=block.n) > 0
                raw, ends = block.data.tobytes(), block.bounds.tolist()
                digests = [hashlib.md5(raw[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].view(np.int64).ravel()))
                numbers = pa.array(np.arange(row, row + high - low))
                row += high - low
                yield pa.RecordBatch.from_arrays([numbers, batch.column(0).slice(low, high - low), pa.array(digests, pa.binary()), lists], names=["row", "id", "digest", "keys"])

    _spark.whole_ids(docs, id_col)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    return chosen.mapInArrow(run, "row long, id long, digest binary, keys array<long>")


def units(texts: pa.Array, size: int) -> list[bytes]:
    """Each text's weighted set as a plain one: a 64-bit name for each unit of weight of each term, in order."""
    out = []
    for _, _, block in _text.blocks(texts):
        text, term, weight = weighted_terms(block.words(), size)
        at = np.repeat(np.arange(len(term)), weight)
        number = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
        name, owner = _text.mix64(term[at] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), text[at]
        order = np.argsort(name)
        order = order[np.argsort(owner[order], kind="stable")]
        name, ends = name[order].tobytes(), (np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.n))]) * 8).tolist()
        out += [name[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def similarity(a: bytes, b: bytes, threshold: float = 0.0) -> float:
    """The generalised Jaccard similarity of two sets given as units; 0 if their sizes alone keep it below threshold."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(x) + len(y) - same)


def similarities(sets: list[bytes]) -> np.ndarray:
    """The similarity of all pairs of a bounded number of sets, by products of their term matrix."""
    size = np.array([len(s) // 8 for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    names = np.frombuffer(b"".join(sets), np.uint64)
    order = np.argsort(names, kind="stable")
    names, owner = names[order], owner[order]
    fresh = np.append(True, names[1:] != names[:-1]) if len(names) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    shared = np.bincount(group)[group] > 1 if len(names) else fresh  # a term of one set alone is in no intersection
    owner, group = owner[shared], group[shared]
    _, group = np.unique(group, return_inverse=True)
    same, step = np.zeros((len(sets), len(sets)), np.float64), max(1, (4 << 20) // max(1, len(sets)))
    for low in range(0, int(group[-1]) + 1 if len(group) else 0, step):
        a, b = np.searchsorted(group, [low, low + step])
        part = np.zeros((len(sets), int(group[b - 1]) - low + 1), np.float32)
        part[owner[a:b], group[a:b] - low] = 1
        same += part @ part.T
    np.fill_diagonal(same, size)
    total = size[:, None] + size[None, :] - same
    return np.divide(same, total, out=np.equal.outer(size, size) * 1.0, where=total > 0)


def links_between(names: list[int], classes: list[int], sets: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of some nodes, enough to join all that any link among them joins."""
    first: dict[int, int] = {}
    own = np.array([first.setdefault(c, k) for k, c in enumerate(classes)])
    rows, cols = np.nonzero(np.triu((similarities(sets) >= threshold) & (own[:, None] != own[None, :])))
    root = list(range(len(names)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = top(int(own[a])), top(int(own[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((names[a], names[b]))
    return out


def connected(edges: DataFrame, scratch: _spark.Scratch) -> DataFrame | None:
    """(node, label) of all nodes of edges (a, b); label: the smallest node that it is joined with. None without edges."""
    store = lambda df: scratch.stored(df, "classes")
    left = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
        while True:  # to the end of each chain of hooks
            on = hook.select(F.col("node").alias("label"), F.col("label").alias("next"))
            new = store(hook.join(on, "label").select("node", "label", "next"))
            moved = not new.where("label <> next").isEmpty()
            hook = new.select("node", F.col("next").alias("label"))
            if not moved:
                break
        to = lambda name: hook.select(F.col("node").alias(name), F.col("label").alias(f"{name}_to"))  # noqa: E731, B023
        if labels is None:
            labels = hook
        else:
            labels = store(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label")).unionByName(hook.join(labels.select("node"), "node", "left_anti")))
        left = store(left.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return labels


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Stored frames (id, digest) of all rows with an id, and (digest, class_id, id, kept) of all texts: id is one that stands with
    the text, kept tells whether the text stands for its class."""
    scratch = _spark.Scratch(docs.sparkSession)
    store = lambda df, name="near": scratch.stored(df, name)
    slim = store(signed(docs, id_col, text_col, size, bands, rows), "signed")
    same = slim.groupBy("digest", "id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    chosen = F.min(F.struct("id", "row", "copies", "keys"))
    texts = store(same.groupBy("digest").agg(chosen.alias("x")).select("digest", F.col("x.row").alias("node"), F.col("x.id").alias("id"), F.col("x.copies").alias("copies"), F.col("x.keys").alias("keys")))
    member = texts.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = store(member.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    member = store(member.join(sizes, "key"))
    weight = store(member.groupBy("node").agg(F.sum("members").alias("weight")))
    weighed = member.join(weight, "node")
    # rows number the texts, so equal weights go to the one met first
    centre = store(weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre")))
    others = store(member.select("key", "node").join(centre, "key").where("node <> centre"))
    pairs = store(others.select("node", "centre").distinct())

    sets = store(_sets(docs, texts.join(weight.select("node"), "node", "left_semi").select("node", "id", "digest", "copies"), id_col, text_col, size), "sets")
    of = lambda name, col: sets.select(F.col("node").alias(name), F.col("units").alias(col))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = pa.array([similarity(x, y, threshold) >= threshold for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    compared = pairs.join(of("node", "u"), "node").join(of("centre", "v"), "centre").select(F.col("node").alias("a"), F.col("centre").alias("b"), "u", "v")
    star = store(compared.mapInArrow(compare, "a long, b long"), "links")
    labels = connected(star, scratch)

    label = (lambda df: df.withColumn("label", F.col("node"))) if labels is None else lambda df: df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # what has been compared with its centre needs no more of it; the rest of a bucket, if its classes differ
    sized = sets.select("node", (F.octet_length("units") / 8).cast("long").alias("units"))
    rest = store(label(others.select("key", "node")).join(sized, "node"))
    names = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (1, 2)]
    parted = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"), *names).where("low <> high")
    parted = parted.groupBy("n", "units", "sum1", "sum2").agg(F.min("key").alias("key"))  # of buckets with the same members one
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("units") / UNITS)).cast("long")
    parted = store(parted.select("key", blocks.alias("blocks")))
    open_ = rest.join(parted, "key").select("key", "node", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    # each pair of blocks, a block with itself included
    open_ = open_.select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    open_ = store(open_.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("part"), "node", "label"), "open")

    def solve(key: tuple, group: pa.Table) -> pa.Table:
        found = links_between(group["node"].to_pylist(), group["label"].to_pylist(), group["units"].to_pylist(), threshold)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    more = store(open_.join(of("node", "units"), "node").groupBy("part").applyInArrow(solve, "a long, b long").distinct(), "links")
    if not more.isEmpty():
        labels = connected(star.unionByName(more), scratch)
    named = label(texts.select("digest", "node", "id")) if labels is not None else texts.select("digest", "node", "id", F.col("node").alias("label"))
    # a class by its label; its name and the text that stands for it by the smallest id, then digest
    top = named.groupBy("label").agg(F.min(F.struct("id", "digest")).alias("top"))
    named = store(named.join(top, "label").select("digest", F.col("top.id").alias("class_id"), "id", (F.col("digest") == F.col("top.digest")).alias("kept")), "named")
    rows_of = store(slim.select("id", "digest"), "rows")
    scratch.clear(keep=(named, rows_of))
    return rows_of, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) of each row: the class of its text, named by the smallest id in it."""
    slim, named = classified(docs, id_col, text_col, size, threshold, bands, rows)
    classed = slim.join(named.select("digest", "class_id"), "digest").select("id", "class_id")
    lost = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"))
    return classed.unionByName(lost).select(F.col("id").cast(_spark.field_type(docs, id_col)).alias(id_col), "class_id")


def _digest(text_col: str) -> F.Column:
    """The digest of a text as signed() makes it."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, units) of the texts of some nodes (node, id, digest, copies), once each: a node's text is sought by its id and
    digest, and where an id stands with the same text repeatedly one of the copies is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units(batch.column(1), size), pa.binary())], names=["node", "units"])

    few = nodes.count() <= SENT_IDS  # 40 bytes each, so 20 MB
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = nodes.withColumnRenamed("digest", "__digest")
    found = texts.join(F.broadcast(wanted) if few else wanted, "id").where(_digest("text") == F.col("__digest"))
    made = found.where("copies = 1").select("node", "text")
    again = found.where("copies > 1").groupBy("node").agg(F.first("text").alias("text"))
    return made.unionByName(again).mapInArrow(run, "node long, units binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their class, one each: its text with the smallest id, then the smallest digest. Of
    rows with that id and text, the one whose columns have the smallest hash stays. Rows without an id stay."""
    rows, named = classified(docs, id_col, text_col, **options)
    kept = named.where("kept").select("digest", "id")
    # how often an id stands with its text, of those that stay
    copies = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("__copies")).join(kept, ["id", "digest"], "left_semi")
    copies = _spark.stored(copies.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "__copies"), "kept")
    found = docs.join(copies, F.col(id_col).cast("long") == F.col("__id")).where(_digest(text_col) == F.col("__digest"))
    once = found.where("__copies = 1").select(*docs.columns)
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    again = found.where("__copies > 1").groupBy("__id", "__digest").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("row")).select("row.*")
    return once.unionByName(again).unionByName(docs.where(F.col(id_col).isNull()))
