"""Exact token ids of public tokenizer files, at the speed of array operations.

Both encoders cut texts where the tokenizer itself can never join. The distinct pieces of a block of texts are encoded
once each, by the tokenizers library, and remembered while there is room; the ids of all texts are then gathered from
them. Texts that the library could cut otherwise go to it whole.
"""

from __future__ import annotations

import functools
import gc
import json
import os
from collections.abc import Callable
from pathlib import Path

import numpy as np

from veilspan.llm import _text

#: Pieces that an encoder remembers before it starts again.
REMEMBERED = 400_000
#: Bytes of text whose pieces are gathered at once.
BLOCK = 3 << 20


def load(path: str):
    """The tokenizer of a file, without its truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def described(path: str) -> dict:
    return json.loads(Path(path).read_text())


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the
    others by the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """Ids of pieces of text. learn: gives the ids of distinct new pieces, as bytes of dtype."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], dtype: np.dtype):
        gc.disable()  # a worker's pieces hold no cycles, and looking for some costs more than the pieces do
        self.learn, self.dtype = learn, dtype
        self.known: dict[bytes, bytes] = {}

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each piece."""
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw, low = data.tobytes(), start[first].tolist()
        pieces = [raw[s:e] for s, e in zip(low, end[first].tolist(), strict=True)]
        found = list(map(self.known.get, pieces))
        if new := [p for p, ids in zip(pieces, found, strict=True) if ids is None]:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            fresh = dict(zip(new, self.learn(new), strict=True))
            self.known.update(fresh)
            found = [fresh[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        pool, number = np.frombuffer(b"".join(found), self.dtype), size[which]
        place = np.cumsum(number) - number
        return pool[np.repeat((np.cumsum(size) - size)[which] - place, number) + np.arange(int(number.sum()))], number


class Merges:
    """The merges of a BPE file, applied to many words at once: in each round every word takes its best merge."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, self.NONE, np.int32)
        left, ranks = keys, np.arange(len(keys), dtype=np.int32)
        slot = self._slot(left)
        while len(left):  # each free slot takes the first key that wants it, the others go one slot further
            free = self.key[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.key[slot[first]], self.rank[slot[first]] = left[first], ranks[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, ranks, slot = left[rest], ranks[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (_text.mix64(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).view(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE if it is never merged."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.rank[slot], self.NONE)
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.rank[slot[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out

    def apply(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are given as symbols, word after word; none may be empty. size: each word's symbols,
        in the result its ids."""
        word, symbols = np.arange(len(size)), symbols.astype(np.int32)
        size, done = size.astype(np.int64), []
        end = np.cumsum(size)
        rank = np.full(len(symbols), self.NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[end - 1] = self.NONE
        while len(word):
            best = np.minimum.reduceat(rank, end - size)
            live = best < self.NONE
            if np.count_nonzero(live) < 0.8 * len(live):  # what is done makes room
                mask = np.repeat(live, size)
                done.append((word[~live], size[~live], symbols[~mask]))
                word, size, symbols, rank, best = word[live], size[live], symbols[mask], rank[mask], best[live]
                end = np.cumsum(size)
                if not len(word):
                    break
            own = np.repeat(best, size)
            chosen = (rank == own) & (own < self.NONE)
            chosen[1:] &= ~chosen[:-1] | (rank[:-1] != rank[1:])
            run = np.flatnonzero(chosen)
            if len(run) > 1:  # of pairs that overlap the left one first, the others in a later round
                run = run[np.append(True, np.diff(run) > 1)]
            symbols[run] = self.made[rank[run]]
            mask = np.ones(len(symbols), bool)
            mask[run + 1] = False
            size = size - np.bincount(np.searchsorted(end, run, "right"), minlength=len(size))
            symbols, rank, end = symbols[mask], rank[mask], np.cumsum(size)
            at = run - np.arange(len(run))
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near + 1 < len(symbols)]
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
            rank[end - 1] = self.NONE
        if not done:
            return symbols, size
        word, size = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        flat, start = np.concatenate([d[2] for d in done]), np.cumsum(size) - size
        order = np.argsort(word)
        return flat[ragged(start[order], size[order])], size[order]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each of many runs, one after another."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)


class WordEncoder:
    """For files that drop white space, put letters in lower case, split words from numbers and signs, and mark each
    word's end. A block's words are found and split as arrays, its distinct words merged all at once. Texts with
    characters beyond Latin Extended-A or with strings that look special go to the library whole."""

    #: The split that the arrays follow.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Characters below this are split as the library does; tests hold all of them against it.
    PLAIN = 0x180

    def __init__(self, path: str):
        made = described(path)
        steps = made["pre_tokenizer"].get("pretokenizers", [made["pre_tokenizer"]])
        split = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        suffix = made["model"].get("end_of_word_suffix") or ""
        self.tokenizer = load(path)
        self.wide = self.tokenizer.get_vocab_size() > 0x10000
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.quick = bool(suffix) and split == [self.SPLIT] and [n["type"] for n in (made["normalizer"] or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
        self.quick = self.quick and all(t["content"].startswith("<|") for t in made["added_tokens"])
        if not self.quick:
            return
        vocab = made["model"]["vocab"]
        self.merges = Merges(vocab, made["model"]["merges"])
        letters = byte_letters()
        self.inner, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, byte in letters.items():
            self.inner[byte], self.final[byte] = vocab[c], vocab[c + suffix]
        # white space 0, letters 1, numbers 2, other 3
        kind = [0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in map(chr, range(self.PLAIN))]
        self.kind1 = np.array(kind[:128] + [3] * 128, np.uint8)
        self.kind2 = np.array(kind[128:], np.uint8)
        self.low1 = np.arange(256, dtype=np.uint8)
        self.low1[65:91] = self.low1[97:123]
        lower = [c.lower() if len(c.lower()) == 1 and ord(c.lower()) < self.PLAIN else c for c in map(chr, range(128, self.PLAIN))]
        self.low2 = np.frombuffer("".join(lower).encode(), np.uint8).reshape(-1, 2)
        self.odd = np.zeros(256, bool)
        self.odd[chr(self.PLAIN).encode()[0] :] = True  # first bytes of other characters
        self.odd[0x1C:0x20] = True  # white space to one of the two languages

    def whole(self, text: str) -> bytes:
        """The library's own ids, as little-endian bytes."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def split(self, block: _text.Block) -> tuple[_text.Words, np.ndarray]:
        """The words of a block, over its bytes in lower case, and which texts must go to the library."""
        data, n = block.data, len(block.data)
        kind, low, flag = self.kind1[data], self.low1[data], self.odd[data]
        first = np.flatnonzero((data >= 0xC2) & (data < chr(self.PLAIN).encode()[0]))
        first = first[first + 1 < n]
        code = (data[first].astype(np.int64) - 0xC2) * 64 + data[first + 1] - 0x80
        good = (code >= 0) & (code < len(self.kind2))
        first, code = first[good], code[good]
        kind[first] = kind[first + 1] = self.kind2[code]
        low[first], low[first + 1] = self.low2[code, 0], self.low2[code, 1]
        flag[first] |= code == 0x130 - 0x80  # it becomes two characters
        flag[1:] |= (data[1:] == ord("|")) & (data[:-1] == ord("<"))  # special strings begin so
        whole = np.diff(np.concatenate([[0], np.cumsum(flag)])[block.bounds]) > 0
        edge = np.zeros(n + 1, bool)
        edge[block.bounds] = True
        begin = edge[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        begin |= kind == 2
        begin[first + 1] = False
        mark = np.flatnonzero(begin & (data == ord("'")))
        mark = mark[mark + 1 < n]
        mark = mark[~edge[mark + 1]]
        c1 = low[mark + 1]
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        two = np.flatnonzero(~one & (mark + 2 < n))
        c2 = low[np.minimum(mark[two] + 2, n - 1)]
        both = ((c1[two] == ord("r")) & (c2 == ord("e"))) | ((c1[two] == ord("v")) & (c2 == ord("e"))) | ((c1[two] == ord("l")) & (c2 == ord("l")))
        two = mark[two[both & ~edge[mark[two] + 2]]]
        one = mark[one]
        begin[one + 1] = begin[two + 1] = False
        after = np.concatenate([one + 2, two + 3])
        begin[after[after < n]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)[: len(start)]
        use = kind[start] != 0
        return _text.Words(_text.Block(low, block.bounds), start[use], end[use]), whole

    def encode(self, block: _text.Block) -> list[bytes]:
        """The ids of each text, as little-endian bytes."""
        data, bounds = block.data, block.bounds
        if not self.quick or not len(data):
            return [self.whole(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        words, whole = self.split(block)
        out = [b""] * block.n
        if len(words.start):
            _, first, which = np.unique(words.hashes(fold=False), return_index=True, return_inverse=True)
            start, size = words.start[first], words.end[first] - words.start[first]
            raw = words.block.data[ragged(start, size)]
            symbols = self.inner[raw]
            last = np.cumsum(size) - 1
            symbols[last] = self.final[raw[last]]
            ids, size = self.merges.apply(symbols, size)
            number = size[which]
            joined = ids.astype(self.dtype)[ragged((np.cumsum(size) - size)[which], number)].tobytes()
            ends = (np.concatenate([[0], np.cumsum(number)])[words.at] * self.dtype.itemsize).tolist()
            out = [joined[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in np.flatnonzero(whole).tolist():
            out[k] = self.whole(data[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace"))
        return out


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path)
