"""Language-model scoring with a probabilistic suffix tree.

A text is a stream of symbols: the bytes of each of its tokens, a blank after each token and a line feed at the end;
ASCII letters are in lower case, tokens are what stands between white space. The tree's nodes are contexts of up to DEPTH
symbols. From the counts of all windows of DEPTH + 1 symbols over all training texts,

* a context is a candidate if it occurs at least LEAST times, in a corpus of any size, so the tree grows with the corpus;
* it is retained if the next symbols after it diverge from those after its suffix: if its count times the
  Kullback-Leibler divergence of the two is at least GAIN, plus PRICE for each distinct next symbol;
* its next-symbol distribution is smoothed towards that of its longest retained suffix, down to the root and half a
  count for each of the 256 bytes.

A symbol is scored by the distribution of the longest retained suffix of what stands before it.

Windows meet in PARTS parts by their three symbols before the last, each a task that grows its part of the tree alone;
contexts of up to two symbols, at most 256^3 counts, are known to all. Texts are scored in as many passes as the tree
needs at MOST counts a pass: a pass sends a range of parts to all tasks, which score the symbols whose windows are in them,
and the passes are summed. Each task looks up its distinct windows once for each block of texts.

The unigram baseline needs the count of every token of every text. Texts are taken in groups of a bounded size; each group
asks once for each of its distinct tokens, the answers are joined from the counts of all tokens, and come
back to the group. No task sees the whole vocabulary, and no row is made for each token of a text.

Tokens are compared by 64-bit hashes. Null and empty texts have one token, the end. Repeated rows each get their score
and count in training as often as they stand. Extra columns are ignored. If no row is for training, counts are zero and
the base score divides by 0.1 (V + 1) with V = 0. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _spark, _text
from veilspan.llm._tokens import ragged

#: Symbols of a context, least count of a candidate, divergence that retains it, and its price for each next symbol.
DEPTH, LEAST, GAIN, PRICE = 6, 2, 8.0, 2.0
#: Parts of windows, symbols of the contexts that all parts know, counts of the tree that a pass sends.
PARTS, SHALLOW, MOST = 256, 2, 4_000_000
#: Weight of the suffix's distribution in smoothing, in counts.
BACK = 8.0
#: Bytes of text of a group.
GROUP = 12 << 20
_SPACE, _END = 0x20, 0x0A
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] = _LOW[97:123]


def stream(block: _text.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, tokens): the symbols of all texts of a block, DEPTH line feeds before each text; where each
    text's own symbols start (and one more for the end); and the tokens of each text without its end."""
    words = block.words(_text.NON_SPACE)
    size = words.end - words.start
    per = words.per_text
    letters = np.concatenate([[0], np.cumsum(size)])[words.at]
    length = np.diff(letters) + per + 1 + DEPTH
    first = np.concatenate([[0], np.cumsum(length)]) + DEPTH
    out = np.full(int(first[-1]) - DEPTH, _END, np.uint8)
    kept = np.flatnonzero(_text.NON_SPACE[block.data])
    word = np.repeat(np.arange(len(size)), size)
    text = words.text_of()
    shift = (first[:-1] - letters[:-1] - words.at[:-1])[text] + np.arange(len(size)) if len(size) else size
    at = np.arange(len(kept)) + shift[word] if len(kept) else kept
    out[at] = _LOW[block.data[kept]]
    out[np.cumsum(size) + shift] = _SPACE
    return out, first, per


def windows(symbols: np.ndarray, first: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The window that ends at each own symbol of the texts in use: the symbol in the low byte, what stands before it above."""
    n = len(symbols)
    own = np.zeros(n, bool)
    own[_text_ranges(first, use)] = True
    at = np.flatnonzero(own)
    out = symbols[at].astype(np.int64)
    for back in range(1, DEPTH + 1):
        out |= symbols[at - back].astype(np.int64) << (8 * back)
    return out


def _text_ranges(first: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The places of the own symbols of the texts in use."""
    size = np.diff(first) - DEPTH
    return ragged(first[:-1][use], size[use])


def _counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[at], np.add.reduceat(counts, at) if len(at) else counts


def row_keys(ids: pa.Array, block: _text.Block) -> np.ndarray:
    """A 64-bit name of each row's id and text."""
    raw, ends = block.data.tobytes(), block.bounds.tolist()
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=str(i).encode()[:64]).digest(), "little", signed=True) for i, a, b in zip(ids.to_pylist(), ends[:-1], ends[1:], strict=True)], np.int64)


def gather(df: DataFrame, id_col: str, text_col: str, training: F.Column) -> DataFrame:
    """One pass over all texts, rows of four kinds:
    word: key a token's hash, group, place its number in the group, n its training count
    group: group, the (token number, text number, count) of its texts, as numbers of 4 bytes each
    text: key a row's name, group, place its number in the group, n 1 if it is for training"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, bounds = _text.string_parts(batch.column(1))
            flags = np.asarray(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for low, high in _text.cuts(bounds, GROUP):
                name = task << 32 | group
                group += 1
                hashes, owner, keys = [], [], []
                for a, b, block in ((a + low, b + low, _text.Block(data[bounds[a + low] : bounds[b + low]], bounds[a + low : b + low + 1] - bounds[a + low])) for a, b in _text.cuts(bounds[low : high + 1])):
                    words = block.words(_text.NON_SPACE)
                    hashes.append(words.hashes())
                    owner.append(words.text_of() + (a - low))
                    keys.append(row_keys(batch.column(0).slice(a, b - a), block))
                token, which = np.unique(np.concatenate(hashes), return_inverse=True)
                both = np.sort(which.astype(np.int64) << 32 | np.concatenate(owner))
                at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
                count = np.diff(np.append(at, len(both)))
                word, text = both[at] >> 32, both[at] & 0xFFFFFFFF
                trained = np.bincount(word, weights=count * flags[low:high][text], minlength=len(token)).astype(np.int64)
                yield rows("word", token.view(np.int64), trained, name, np.arange(len(token)))
                yield rows("group", np.zeros(1, np.int64), np.zeros(1, np.int64), name, np.zeros(1, np.int64), [np.stack([word, text, count]).astype("<u4").tobytes()])
                yield rows("text", np.concatenate(keys), flags[low:high].astype(np.int64), name, np.arange(high - low))
    def rows(kind: str, key: np.ndarray, n: np.ndarray, group: int = 0, place: np.ndarray | None = None, counts: list[bytes] | None = None) -> pa.RecordBatch:
        size = len(key)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * size, pa.string()) if size < 9 else pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int8)), pa.array([kind])).cast(pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(size, group, np.int64)), pa.array(np.zeros(size, np.int64) if place is None else place, pa.int64()), pa.nulls(size, pa.binary()) if counts is None else pa.array(counts, pa.binary())],
            names=["kind", "key", "n", "group", "place", "counts"],
        )

    chosen = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    return chosen.mapInArrow(run, "kind string, key long, n long, group long, place long, counts binary")


def part_of(window: np.ndarray) -> np.ndarray:
    """The part of each window, by the three symbols before its last."""
    return ((window.astype(np.int64) >> 8 & 0xFFFFFF) * 0x9E3779B1 >> 24) & (PARTS - 1)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte in planes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def gather_windows(df: DataFrame, id_col: str, text_col: str, training: F.Column) -> DataFrame:
    """(part, n, keys, counts): the windows of training texts, n of them in a row, in order and packed as differences."""

    def rows(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = part_of(values)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(PARTS + 1))
        own = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        found = [(k, len(o), _packed(np.diff(values[o], prepend=0)), _packed(counts[o])) for k, o in enumerate(own) if len(o)]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "n", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, block in _text.blocks(batch.column(0)):
                symbols, first, _ = stream(block)
                found = np.sort(windows(symbols, first, np.ones(block.n, bool)))
                at = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else found
                held.append((found[at], np.diff(np.append(at, len(found)))))
                if sum(len(x) for x, _ in held) > 3_000_000:
                    held = [_counted(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held]))]
                    if len(held[0][0]) > 1_500_000:  # a bounded memory of windows
                        yield rows(*held.pop())
        if held:
            yield rows(*_counted(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held])))

    return df.where(F.coalesce(training, F.lit(False))).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "part long, n long, keys binary, counts binary")


class Tree:
    """Next-symbol distributions of contexts, by window: for each length the windows in order, their shares, and the weight
    that their context leaves to its suffix. parts: the parts whose windows it scores; the others count as nothing."""

    def __init__(self, contexts: np.ndarray, depths: np.ndarray, symbols: np.ndarray, counts: np.ndarray, retained: np.ndarray, parts: tuple[int, int] = (0, PARTS)):
        """Counts of (context, symbol) of the root and of candidates; retained: whether the context of a row is kept."""
        root = depths == 0
        count = np.bincount(symbols[root], weights=counts[root], minlength=256)
        self.base = (count + 0.5) / (count.sum() + 128)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.parts = parts
        for d in range(1, int(depths.max(initial=0)) + 1):
            at = np.flatnonzero((depths == d) & retained)
            key = contexts[at] << 8 | symbols[at]
            order = np.argsort(key)
            key, n = key[order], counts[at][order]
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, key[1:] >> 8 != key[:-1] >> 8))
            total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(n))))
            share = (n + BACK * self.shares(key)) / (total + BACK)
            self.levels.append((d, key, share.astype(np.float32), (BACK / (total + BACK)).astype(np.float32)))

    def shares(self, window: np.ndarray) -> np.ndarray:
        """The probability of each window's symbol after its longest retained suffix."""
        out = self.base[window & 255]
        for d, key, share, back in self.levels:
            own = window & ((1 << 8 * (d + 1)) - 1)
            at = np.searchsorted(key, own)
            here, before = np.minimum(at, len(key) - 1), np.maximum(at - 1, 0)
            near = np.where(key[here] >> 8 == own >> 8, here, before)  # a window of the same context, if there is one
            known = key[near] >> 8 == own >> 8
            out = np.where(key[here] == own, share[here], np.where(known, out * back[near], out))
        return out

    def scores(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text of a stream, of the symbols in the tree's parts."""
        n = len(first) - 1
        found, which = np.unique(windows(symbols, first, np.ones(n, bool)), return_inverse=True)
        value = np.log10(self.shares(found))
        if self.parts != (0, PARTS):
            part = part_of(found)
            value[(part < self.parts[0]) | (part >= self.parts[1])] = 0.0
        return np.bincount(np.repeat(np.arange(n), np.diff(first) - DEPTH), weights=value[which], minlength=n)


class Packed:
    """What a tree is made of, packed, so that the driver never unfolds it: the counts of shallow contexts and, for each part
    and depth, those of the others as (depth, size, keys, counts). tree() is made once in each worker."""

    def __init__(self, shallow: list[tuple[int, np.ndarray, np.ndarray]], deep: list[tuple[int, int, bytes, bytes]], parts: tuple[int, int]):
        self.shallow, self.deep, self.parts = shallow, deep, parts

    def __getstate__(self) -> tuple:
        return self.shallow, self.deep, self.parts

    def __setstate__(self, state: tuple) -> None:
        self.shallow, self.deep, self.parts = state

    @functools.cached_property
    def tree(self) -> Tree:
        own = [*self.shallow, *((d, np.cumsum(_unpacked(k, n)), _unpacked(c, n)) for d, n, k, c in self.deep)]
        depth = np.concatenate([np.full(len(k), d, np.int8) for d, k, _ in own])
        key, n = (np.concatenate([x[i] for x in own]) for i in (1, 2))
        return Tree(key >> 8, depth, key & 255, n, np.ones(len(key), bool), self.parts)


def _totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows in order: (total, kinds, number) of each one's context."""
    first = np.flatnonzero(np.append(True, key[1:] >> 8 != key[:-1] >> 8))
    size = np.diff(np.append(first, len(key)))
    return np.repeat(np.add.reduceat(n, first), size), np.repeat(size, size), np.repeat(np.arange(len(first)), size)


def kept(key: np.ndarray, n: np.ndarray, above: np.ndarray, n_above: np.ndarray, depth: int, least: int = LEAST, gain: float = GAIN, price: float = PRICE) -> np.ndarray:
    """Which windows of depth + 1 symbols, in order, have a context that is retained. above: those of one symbol less."""
    total, kinds, number = _totals(key, n)
    at = np.searchsorted(above, key & ((1 << 8 * depth) - 1))
    q = n_above[at] / _totals(above, n_above)[0][at]
    g = np.bincount(number, weights=n * np.log(n / total / q))[number]
    return (total >= least) & (g >= gain + price * kinds)


def grow(found: DataFrame, most: int = MOST) -> Iterator[Packed]:
    """The trees of all passes, packed and made as they are asked for, from gathered windows."""
    spark = found.sparkSession

    def merged(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
        held, fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        for k, (size, keys, counts) in enumerate(zip(*(table[c].to_pylist() for c in ("n", "keys", "counts")), strict=True)):
            key = np.cumsum(_unpacked(keys, size))
            fresh.append((key & ((1 << 8 * (depth + 1)) - 1), _unpacked(counts, size)))
            if sum(len(x) for x, _ in fresh) > 2_000_000 or k == table.num_rows - 1:
                held = _counted(np.concatenate([held[0], *(x for x, _ in fresh)]), np.concatenate([held[1], *(c for _, c in fresh)]))
                fresh = []
        return held

    def flat(table: pa.Table) -> pa.Table:
        key, n = merged(table, DEPTH)
        return pa.table({"part": np.full(len(key), table["part"][0].as_py()), "key": key, "n": n})

    # one exchange: the windows of each part, summed
    level = _spark.stored(found.groupBy("part").applyInArrow(flat, "part long, key long, n long"), "windows")
    low = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (SHALLOW + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    known = {SHALLOW: _counted(low["key"].to_numpy(), low["n"].to_numpy())}
    for d in range(SHALLOW - 1, -1, -1):
        known[d] = _counted(known[d + 1][0] & ((1 << 8 * (d + 1)) - 1), known[d + 1][1])
    shallow = [(0, *known[0])]
    if len(known[0][0]):
        for d in range(1, SHALLOW + 1):
            use = kept(*known[d], *known[d - 1], d)
            shallow.append((d, known[d][0][use], known[d][1][use]))
    sent = spark.sparkContext.broadcast(known[SHALLOW])

    def part(table: pa.Table) -> pa.Table:
        levels = {DEPTH: _counted(table["key"].to_numpy(), table["n"].to_numpy())}
        for d in range(DEPTH - 1, SHALLOW, -1):
            levels[d] = _counted(levels[d + 1][0] & ((1 << 8 * (d + 1)) - 1), levels[d + 1][1])
        out, above = [], sent.value
        for d in range(SHALLOW + 1, DEPTH + 1):
            use = kept(*levels[d], *above, d)
            above = levels[d]
            if use.any():
                out.append((table["part"][0].as_py(), d, int(use.sum()), _packed(np.diff(above[0][use], prepend=0)), _packed(above[1][use])))
        return pa.table({c: pa.array([o[i] for o in out], kind) for i, (c, kind) in enumerate((("part", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())))})

    deep = _spark.stored(level.groupBy("part").applyInArrow(part, "part long, depth long, n long, keys binary, counts binary"), "tree")
    size = {r["part"]: r["n"] for r in deep.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    cuts, held = [0], 0
    for k in range(PARTS):
        if held and held + size.get(k, 0) > most:
            cuts.append(k)
            held = 0
        held += size.get(k, 0)

    def tree(a: int, b: int) -> Packed:
        own = deep.where(F.col("part").between(a, b - 1)).orderBy("part", "depth").collect()  # at most most counts, packed, or one part
        return Packed(shallow, [(r["depth"], r["n"], bytes(r["keys"]), bytes(r["counts"])) for r in own], (a, b))

    for a, b in zip(cuts, [*cuts[1:], PARTS], strict=True):
        yield tree(a, b)


def base_scores(gathered: DataFrame) -> tuple[DataFrame, int]:
    """(key, n_known, base_score) of each row, and the number of training tokens."""
    asked = gathered.where("kind = 'word'").select("key", "n", "group", "place")
    counts = _spark.stored(asked.groupBy("key").agg(F.sum("n").alias("c")), "counts")
    words = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = gathered.where("kind = 'text'").agg(F.sum("n")).first()[0] or 0
    tokens, kinds = (words["n"] or 0) + ends, words["v"] + (ends > 0)
    whole = float(np.log10(tokens + 0.1 * (kinds + 1)))
    answers = asked.join(counts, "key").select(F.col("group").alias("asker"), F.col("place").alias("slot"), "c")
    texts = gathered.where("kind IN ('group', 'text')").select("group", "kind", "key", "place", "counts")

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = np.array(left["kind"].to_pylist())
        text = left.filter(pa.array(kind == "text"))
        blob = left["counts"].to_pylist()[int(np.flatnonzero(kind == "group")[0])]
        word, owner, count = np.frombuffer(blob, "<u4").reshape(3, -1).astype(np.int64)
        c = np.zeros(len(right), np.int64)
        c[right["slot"].to_numpy()] = right["c"].to_numpy()
        n = len(text)
        total = np.bincount(owner, weights=count * np.log10(c[word] + 0.1), minlength=n) + np.log10(ends + 0.1)
        known = np.bincount(owner, weights=count * (c[word] > 0), minlength=n).astype(np.int64) + (ends > 0)
        number = np.bincount(owner, weights=count, minlength=n) + 1
        place = text["place"].to_numpy()
        return pa.table({"key": text["key"], "n_known": known[place], "base_score": (total - number * whole)[place]})

    scored = texts.groupBy("group").cogroup(answers.groupBy("asker")).applyInArrow(score, "key long, n_known long, base_score double")
    # rows with the same id and text have the same scores
    return scored.groupBy("key").agg(F.min("n_known").alias("n_known"), F.min("base_score").alias("base_score")), tokens


def tree_scores(df: DataFrame, tree: Packed, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_tokens, score) of each row."""
    sent = df.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.tree
        for batch in batches:
            for low, high, block in _text.blocks(batch.column(1), 2 * _text.BLOCK_BYTES):
                symbols, first, tokens = stream(block)
                names = row_keys(batch.column(2).slice(low, high - low), block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(names), pa.array(tokens + 1, pa.int64()), pa.array(own.scores(symbols, first))], names=["id", "key", "n_tokens", "score"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("name"))
    return chosen.mapInArrow(run, f"id {_spark.field_type(df, id_col)}, key long, n_tokens long, score double")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: F.Column | None = None, most: int = MOST) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts, learning from those for which
    training, a condition on the id, holds (all, if None)."""
    training = F.lit(True) if training is None else training
    gathered = _spark.stored(gather(df, id_col, text_col, training), "gathered")
    passes = [tree_scores(df, tree, id_col, text_col) for tree in grow(gather_windows(df, id_col, text_col, training), most)]
    base, tokens = base_scores(gathered)
    joined = passes[0].join(base, "key")
    if len(passes) > 1:
        rest = None
        for k, p in enumerate(passes[1:]):
            own = p.select("key", F.lit(k).alias("pass"), F.col("score").alias("more"))
            rest = own if rest is None else rest.unionByName(own)
        # rows with the same id and text have the same scores
        rest = rest.groupBy("key", "pass").agg(F.min("more").alias("more")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pass", "more"))).alias("more"))
        joined = joined.join(rest, "key").withColumn("score", F.aggregate("more", F.col("score"), lambda x, y: x + y["more"])).drop("more")
    held = ~F.coalesce(training, F.lit(False))
    return joined.withColumnRenamed("id", id_col).select(id_col, held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
