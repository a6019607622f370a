"""Packing by concatenate and cut.

Pass one turns each text into token ids, ends it with an end id, and notes for each document where it starts among the
documents of its task; the rows are written to the shared folder. Summing the tokens of each task and adding these
sums up in order (one number for each task, never one for each document) gives every task its global offset. Pass two
adds the offset to each document's place, so all documents stand in one gapless stream, and cuts the stream into fixed
windows. A document that crosses a window's edge leaves a boundary record on either side: one piece for each window it
touches. Neither pass moves rows between tasks, so no key can be hot; every window but the last is full.

The order of documents is that of the tasks that read them. Null texts are empty: they hold the end id alone. Repeated
rows are packed as often as they stand. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _spark, _text, _tokens

#: Ids of one window.
WINDOW = 2048
#: The id that ends each document.
END_ID = 1


def tokenized(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, task, place, tokens, wide, ids): the ids of each text and end_id as little-endian bytes, 2 an id (4 if
    wide: a vocabulary of over 65,536); place: the ids before them in the same task."""
    kind = _spark.field_type(df, id_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokens.word_encoder(tokenizer)
        dtype, end = words.dtype, np.array([end_id], words.dtype).tobytes()
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, high, block in _text.blocks(batch.column(1), _tokens.BLOCK):
                ids = [own + end for own in words.encode(block)]
                tokens = np.array([len(x) // dtype.itemsize for x in ids], np.int64)
                places = place + np.cumsum(tokens) - tokens
                place += int(tokens.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.full(len(ids), task)), pa.array(places), pa.array(tokens), pa.array(np.full(len(ids), dtype.itemsize == 4)), pa.array(ids, pa.binary())],
                    names=["id", "task", "place", "tokens", "wide", "ids"],
                )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, f"id {kind}, task long, place long, tokens long, wide boolean, ids binary")


def cut(stream: DataFrame, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of the rows of tokenized(), which must be stored: each id lies in exactly one piece."""
    # one row for each task of pass one
    sums = {r["task"]: r["n"] for r in stream.groupBy("task").agg(F.sum("tokens").alias("n")).collect()}
    offsets, total = {}, 0
    for task in sorted(sums):
        offsets[task] = total
        total += sums[task]
    kind = _spark.field_type(stream, "id")
    offsets = stream.sparkSession.sparkContext.broadcast(offsets)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            task, place, tokens = (batch.column(k).to_numpy() for k in (1, 2, 3))
            begin = place + np.array([offsets.value[t] for t in task.tolist()], np.int64)
            first, last = begin // window, (begin + tokens - 1) // window
            number = (last - first + 1).astype(np.int64)
            row = np.repeat(np.arange(rows), number)
            sequence = np.repeat(first, number) + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            low = np.maximum(sequence * window, begin[row])
            high = np.minimum((sequence + 1) * window, (begin + tokens)[row])
            start, length = low - begin[row], high - low
            wide, crc, parts = batch.column(4).to_pylist(), [], []
            at, ids = -1, b""
            for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if r != at:
                    at, own = r, batch.column(5)[r].as_buffer()
                    ids = memoryview(np.frombuffer(own, "<u4" if wide[r] else "<u2").astype("<u4")).cast("B")
                part = ids[4 * s : 4 * (s + n)]
                crc.append(zlib.crc32(part))
                if keep_ids:
                    parts.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = {
                "id": batch.column(0).take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(tokens[row]), "sequence_id": pa.array(sequence), "offset": pa.array(low - sequence * window),
            }
            if keep_ids:
                columns["ids"] = pa.array(parts, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * keep_ids
    return stream.select("id", "task", "place", "tokens", "wide", "ids").mapInArrow(pieces, schema)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ids if keep_ids."""
    stream = _spark.stored(tokenized(df, tokenizer, id_col, text_col, end_id), "packing")
    return cut(stream, window, keep_ids).withColumnRenamed("id", id_col)


