"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never be merged, so a cut between
them is certain: what stands before it and after it encodes independently. Texts are cut at all such places that the
tokenizer's own first split also respects; the fragments are encoded by the tokenizers library, each distinct one of a
block once, and the ids are laid end to end. The result equals the library's ids of the whole text.

The first split looks ahead only at the end of white space and treats an apostrophe with certain letters as one word,
so no cut is made after white space, before an apostrophe or inside a character. Special strings are cut out whole.

Null texts are empty: no ids, decoded as empty. Texts of any length are cut and gathered as a whole. Repeated rows
each get their result. Extra columns are ignored. There is no shuffle.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _spark, _text, _tokens


class Codec:
    """Encoder and decoder of one byte-level file."""

    def __init__(self, path: str):
        made = _tokens.described(path)
        letters = _tokens.byte_letters()
        level = made["pre_tokenizer"]
        if made["model"]["type"] != "BPE" or level["type"] != "ByteLevel" or level["add_prefix_space"] or made["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        self.tokenizer = _tokens.load(path)
        self.dtype = np.dtype("<u4")
        vocab = made["model"]["vocab"]
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in made["added_tokens"])]) + 1)
        for text, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        together = np.zeros((256, 256), bool)
        for t in self.tokens:
            if len(t) > 1:
                own = np.frombuffer(t, np.uint8)
                together[own[:-1], own[1:]] = True
        for t in (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"):  # one word to the first split
            own = np.frombuffer(t, np.uint8)
            together[own[:-1], own[1:]] = True
        self.specials = [t["content"].encode() for t in made["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"]):
            raise ValueError("special strings that depend on what stands beside them aren't handled")
        for t in made["added_tokens"]:
            self.tokens[t["id"]] = t["content"].encode()
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32, 28, 29, 30, 31]] = True
        together[space, :] = True
        together[:, ord("'")] = True
        together[:, 0x80:0xC0] = True
        self.forced = ~together.ravel()
        #: Last bytes of white space outside ASCII; a lead byte from 0xC3 to 0xDF before them makes another character.
        self.end_of_space = np.zeros(256, bool)
        self.end_of_space[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
        self.pieces = _tokens.Pieces(self._learn, self.dtype)
        self.decimals = [str(i).encode() for i in range(len(self.tokens))]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def cuts(self, block: _text.Block) -> np.ndarray:
        """Where the fragments of a block start."""
        data, n = block.data, len(block.data)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            cut[1:n] = self.forced[data[:-1].astype(np.int64) * 256 + data[1:]]
            doubt = self.end_of_space[data[:-1]]
            doubt[1:] &= ~((data[:-2] >= 0xC3) & (data[:-2] <= 0xDF))
            cut[1:n] &= ~doubt
        cut[block.bounds] = True
        raw = data.tobytes()
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                end = at + len(special)
                if not np.isin(block.bounds, range(at + 1, end)).any():
                    cut[at + 1 : end] = False
                    cut[at] = cut[end] = True
                at = raw.find(special, end)
        return np.flatnonzero(cut[:n])

    def encode(self, block: _text.Block) -> list[np.ndarray]:
        """The ids of each text."""
        start = self.cuts(block)
        end = np.append(start[1:], len(block.data))
        at = np.searchsorted(start, block.bounds)
        ids, number = self.pieces.ids(block.data, start, end, _text.Words(block, start, end).hashes(fold=False))
        ends = np.concatenate([[0], np.cumsum(number)])[at].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids outside the vocabulary are left out, bytes that form no character become U+FFFD."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(self.tokens[i] for i in ids if 0 <= i < len(self.tokens)).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for low, high, block in _text.blocks(batch.column(1), _tokens.BLOCK):
                ids = [x.astype(np.int32) for x in own.encode(block)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {_spark.field_type(df, id_col)}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids, special tokens included; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            texts = [own.decode([i for i in ids or () if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, f"id {_spark.field_type(df, id_col)}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again in one pass, and digests of the
    ids (in decimal, joined by commas) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for low, high, block in _text.blocks(batch.column(1), _tokens.BLOCK):
                number, digests, decoded = [], [], []
                for ids in own.encode(block):
                    ids = ids.tolist()
                    number.append(len(ids))
                    digests.append(hashlib.sha256(b",".join(map(own.decimals.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(number, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {_spark.field_type(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
