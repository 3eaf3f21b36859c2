"""Tokenizer files of the tokenizers library, with a cache of whole chunks of text.

A chunk is what stands between two blanks. For the two kinds of files known here the library never
merges across such a place, so the ids of a text are those of its chunks, and nearly all chunks have been met
before. Where that can't be told (runs of blanks before a chunk in byte-level files, files of other kinds)
the whole text goes to the library.

In files of the one kind whose words are runs of letters, in lower case (op8's), a chunk also ends between an ASCII letter and ASCII
punctuation, A-Z are lowered before chunks are looked up, and words to be learnt go to the library with a blank between two.

Chunks are found and hashed in numpy on the texts' bytes, without a Python object for each, and looked up in a table of 64-bit
hashes that holds CACHE_BYTES at most (two chunks of one hash: below 1e-13 for each new chunk).
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix, tokenizer_path, worker_cache

#: Bytes that the chunk table of one Python worker takes at most (for a moment, while it is cut down, one and a half times that).
CACHE_BYTES = 48 << 20
#: Words as the files know them that let chunks be cut finer.
FINE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PUNCTUATION = np.array([chr(b) in string.punctuation for b in range(256)])
#: Bytes of longer chunks are hashed by xxhash.
SHORT = 64
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
POWER = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(SHORT)], np.uint64)


class Table:
    """Hash -> number (0 to n - 1), by linear probing; 12 bytes a slot, twice as many slots as hashes or more."""

    def __init__(self, bits: int = 16) -> None:
        self.n, self.bits = 0, bits
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it isn't there."""
        out = np.full(len(h), -1, np.int64)
        at, left = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            k = self.key[at]
            hit, go = k == h[left], k != 0
            out[left[hit]] = self.value[at[hit]]
            go &= ~hit
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes, none of them 0 or there, get the next numbers."""
        if 2 * (self.n + len(h)) > len(self.key):
            while 2 * (self.n + len(h)) > 1 << self.bits:
                self.bits += 1
            full = self.key != 0
            key, value = self.key[full], self.value[full]
            self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint32)
            self._put(key, value)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.uint32))
        self.n += len(h)

    def _put(self, h: np.ndarray, value: np.ndarray) -> None:
        at, left = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.key[at] == 0
            self.key[at[free]] = h[left[free]]  # of those that want one slot, the last has it
            won = free & (self.key[at] == h[left])
            self.value[at[won]] = value[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


class Encoder:
    def __init__(self, path: str, cache: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        special = [x for x in spec.get("added_tokens", []) if x.get("special") and not x.get("normalized")]
        self.kind = self._kind(spec) if special else "whole"
        self.mark, self.mark_id = (special[-1]["content"], special[-1]["id"]) if special else ("", -1)
        self.added = [x["content"].lower().encode() for x in spec.get("added_tokens", [])]
        self.fine = self.kind == "word" and self._fine(spec)
        if self.fine:  # the model alone, for words of a to z, which are as they are after all other steps; and whether an id ends a word
            self.bare = Tokenizer(self.lib.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
            self.ends = np.zeros(max(self.lib.get_vocab_size(), self.mark_id + 1), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.most = cache
        self._clear()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm, post = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("truncation") or spec.get("padding")
        if post or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x["content"].split() != [x["content"]] for x in spec.get("added_tokens", [])):
            return "whole"
        if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        parts = pre.get("pretokenizers") or []
        blanks_go = [n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in (norm or {}).get("normalizers", [])]
        if parts and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in (parts[0].get("pattern") or {}).get("Regex", "") and True in blanks_go:
            return "word"
        return "whole"

    @staticmethod
    def _fine(spec: dict) -> bool:
        """Whether words are FINE's, in lower case, and each one's last id, and no other, ends with </w>."""
        from tokenizers.pre_tokenizers import ByteLevel

        model, split, rest = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0], spec["pre_tokenizer"]["pretokenizers"][1:]
        plain_model = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "continuing_subword_prefix"))
        by_byte = [(x.get("type"), x.get("use_regex"), x.get("add_prefix_space")) for x in rest] == [("ByteLevel", False, False)]
        lowered = [n.get("type") for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        return plain_model and by_byte and lowered and split.get("pattern") == {"Regex": FINE} and all(c in model["vocab"] and f"{c}</w>" in model["vocab"] for c in ByteLevel.alphabet())

    def _finer(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with A-Z lowered where no mark can follow (NFC comes first, and joins some marks to small letters only), and where chunks
        are cut besides blanks: a word ends between an ASCII letter and ASCII punctuation. Nothing of both near added tokens."""
        low = data | (((data - np.uint8(65)) < 26) & (np.append(data[1:], np.uint8(0)) < 128)).astype(np.uint8) << np.uint8(5)
        raw = low.tobytes()
        if any(t in raw for t in self.added):
            return data, np.zeros(0, np.int64)
        return low, np.flatnonzero(((low[:-1] - np.uint8(97)) < 26) & PUNCTUATION[low[1:]]) + 1

    def _clear(self) -> None:
        self.table = Table()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n_ids = 0
        self.at, self.len, self.used = (np.zeros(1 << 14, t) for t in (np.uint32, np.uint32, np.uint32))
        self.turn = 0

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.table.key, self.table.value, self.ids, self.at, self.len, self.used))

    def _trim(self) -> None:
        """Keeps what was used last, up to a quarter of the room; with that little the table doesn't grow again at once."""
        n, t = self.table.n, self.table
        used = self.used[:n]
        size = 24 + 12 + 4 * self.len[:n].astype(np.int64)
        by_turn = np.cumsum(np.bincount(self.turn - used, size))  # bytes of what was used in the last turns
        keep = self.turn - used < np.searchsorted(by_turn, self.most // 4)
        full = t.key != 0
        key = np.zeros(n, np.uint64)
        key[t.value[full]] = t.key[full]
        ids, at, length, used = self.ids, self.at[:n][keep].astype(np.int64), self.len[:n][keep].astype(np.int64), used[keep]
        turn, key = self.turn, key[keep]
        self._clear()
        self.turn = turn
        if len(key):
            self.table.add(key)
            self._store(ids[pieces(at, length)], length, used)

    def _store(self, ids: np.ndarray, length: np.ndarray, used: np.ndarray | int) -> None:
        """Ids of the last chunks of the table, one after another."""
        n = self.table.n
        a = n - len(length)
        if n > len(self.at):
            self.at, self.len, self.used = (np.concatenate([x, np.zeros(n + n // 2 - len(x), x.dtype)]) for x in (self.at, self.len, self.used))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids) // 2), np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.at[a:n], self.len[a:n], self.used[a:n] = self.n_ids + np.cumsum(length) - length, length, used
        self.n_ids += len(ids)

    def _good(self, k: str) -> bool:
        """Whether the library gives a chunk the same ids wherever it stands."""
        if self.mark in k:
            return False
        return self.kind != "byte" or bool(k) and not k[-1].isspace() and not k[k[0] == "\n"].isspace()

    def _learn(self, h: np.ndarray, keys: list[bytes], blank: list[bool]) -> None:
        """Encodes chunks many at a time. In byte-level files a chunk carries the blank before it."""
        text = [k.decode("utf-8") for k in keys]
        kind = np.fromiter(((t.isalpha() + (t.isascii() and t.islower() and t.isalpha()) for t in text) if self.fine else (0 for _ in text)), np.int8, len(text))
        order = np.argsort(kind, kind="stable")  # others, words, words of a to z
        h, text, blank = h[order], [text[i] for i in order.tolist()], [blank[i] for i in order.tolist()]
        a, b = np.searchsorted(kind[order], (1, 2)).tolist()
        parts = [self._marked(text[:a], blank[:a])]
        if self.fine:
            parts += [*self._words(text[a:b], self.lib), *self._words(text[b:], self.bare)]
        own, size = (np.concatenate(x) for x in zip(*parts))
        self.table.add(h)
        self._store(own, np.where(size == NOT_ALONE, 0, size), self.turn)
        n = self.table.n
        self.len[n - len(size) : n][size == NOT_ALONE] = NOT_ALONE

    def _words(self, text: list[str], lib: object) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of chunks that are letters only, and how many each has, told apart by the ids that end words. A chunk is one word at least, so as many ends as
        chunks mean one word each; where there are more (letters that the library doesn't take for such), chunks are marked."""
        for at in range(0, len(text), 4000):
            parts = [text[a : a + 500] for a in range(at, min(at + 4000, len(text)), 500)]
            for part, e in zip(parts, lib.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                stop = np.flatnonzero(self.ends[ids])
                yield (ids, np.diff(stop, prepend=-1).astype(np.uint32)) if len(stop) == len(part) else self._marked(part, [False] * len(part))

    def _marked(self, text: list[str], blank: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any chunks, and how many each has (NOT_ALONE: not to be told), with a special token between two."""
        good = np.fromiter(map(self._good, text), bool, len(text))
        texts = [" " + t if b else t for t, b, g in zip(text, blank, good) if g]
        joined = [self.mark.join(texts[a : a + 500]) + self.mark for a in range(0, len(texts), 500)]
        found = [np.array(e.ids, np.uint32) for x in range(0, len(joined), 8) for e in self.lib.encode_batch_fast(joined[x : x + 8], add_special_tokens=False)]
        ids = np.concatenate([*found, np.zeros(0, np.uint32)])
        stop = np.flatnonzero(ids == self.mark_id)
        length = np.full(len(text), NOT_ALONE, np.uint32)
        length[good] = np.diff(np.concatenate([[-1], stop])) - 1
        return ids[ids != self.mark_id], length

    def _chunks(self, data: np.ndarray, edge: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each chunk of the texts in `data`, its text, and whether a blank belongs to it."""
        text = np.flatnonzero(edge[1:] > edge[:-1])
        blank, line = np.flatnonzero(data == 32), np.flatnonzero(data == 10)
        if self.kind != "byte":  # line ends are blanks
            blank, line = np.sort(np.concatenate([blank, line]), kind="stable"), cut
        # What begins a chunk, in this order at one place: the blank before it, a text, a line's end or a cut.
        key = np.sort(np.concatenate([3 * (blank + 1), 3 * edge[text] + 1, 3 * line + 2]), kind="stable")
        begin, what = key // 3, key % 3
        end = np.append(begin[1:] - (what[1:] == 0), len(data))
        return begin, end, text[np.cumsum(what == 1) - 1], (what == 0) & (self.kind == "byte")

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text. Null is the empty text."""
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        if self.kind == "whole" or not len(column):
            return self._whole(column.to_pylist())
        edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
        edge = edge - edge[0]
        if self.nbytes() > self.most:
            self._trim()
        self.turn += 1
        data, cut = self._finer(data) if self.fine else (data, np.zeros(0, np.int64))
        begin, end, owner, blank = self._chunks(data, edge, cut)
        h = hashes(data, begin, end, blank)
        piece = self.table.find(h)
        if (miss := np.flatnonzero(piece < 0)).size:
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            raw = data.tobytes()
            self._learn(new, [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())], blank[first].tolist())
            piece[miss] = self.table.find(h[miss])
        self.used[piece] = self.turn
        size = self.len[piece]
        odd = np.unique(owner[size == NOT_ALONE])
        if len(odd):
            size = np.where(np.isin(owner, odd), 0, size)
        size = size.astype(np.int64)
        out = self.ids[pieces(self.at[piece].astype(np.int64), size)]
        counts = np.bincount(owner, size, len(column)).astype(np.int64)
        if not len(odd):
            return out, counts
        parts = np.split(out, np.cumsum(counts)[:-1])
        for i in odd.tolist():
            parts[i] = np.array(self.lib.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.fromiter(map(len, found), np.int64, len(found))


#: Length of chunks whose texts go to the library whole.
NOT_ALONE = np.uint32(0xFFFFFFFF)


def pieces(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of runs of these sizes, one run after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - size), size)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """64 bits of each chunk: powers times spread bytes, summed; never 0."""
    stop = np.append(begin[1:], len(data))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(begin.astype(np.int32), stop - begin)  # texts follow one another, so all bytes are covered
    np.minimum(place, SHORT - 1, out=place)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * POWER[place], out=total[1:])
    h = total[end] - total[begin]
    for i in np.flatnonzero(end - begin > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    h = mix((h + (end - begin).astype(np.uint64)) ^ (blank * np.uint64(0xA0761D6478BD642F)))
    h[h == 0] = 1
    return h


@worker_cache
def encoder(name: str) -> Encoder:
    """One for each Python worker. `name`: a path, or the name of a file that public_tokenizers has."""
    return Encoder(name if os.sep in name else tokenizer_path(name))


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id `end` after each text."""
    return np.insert(ids, np.cumsum(counts), end).astype(np.uint32), counts + 1
