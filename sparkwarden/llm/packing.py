"""Packing by minimum bin slack.

Texts become ids, each with an end id. Whole windows are cut off; what remains of each text is shorter than a
window. For those remainders, by length: the longest left opens a window, and subset-sum dynamic programming
over the multiset of remaining lengths (a bitset, one stage for each power of two of a length's count) finds the
sum closest to the window's room; going back through the stages gives how many of each length it takes. The
pattern is used as often as the counts allow. Windows left with room are filled by cutting pieces of the same
kind, and the very last one becomes windows of powers of two, which need no padding.

Each task packs what it reads, in parts of BUFFER ids: no shuffle, and memory doesn't follow the input. A text is
in one task. Null texts are empty: they hold the end id only. Repeated rows are packed each for itself;
a null id is one like others; a text of any length is encoded whole, by one task, and cut into windows. Extra columns of any name are left
out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_batches, plain, slices
from .tokens import encoder, with_end

WINDOW = 2048
#: Ids that a task packs together.
BUFFER = 1 << 21
TOKENIZER = "byte_bpe_50k.json"
END = 1


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length sum up closest to `room` without going beyond."""
    limit = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            stages.append((length, k, reach))
            reach |= (reach << (k * length)) & limit
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(stages):
        if not before >> at & 1:
            out[length] += k
            at -= k * length
    return dict(out)


def patterns(counts: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings of windows, each with how often it is used, until all lengths are used up."""
    counts = {k: v for k, v in counts.items() if v}
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        fill = best_fill({k: v for k, v in rest.items() if v}, window - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // v for k, v in fill.items())
        yield fill, times
        for k, v in fill.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]


def pack(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts with these numbers of ids: text, start, length, sequence, offset."""
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = 0
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(sizes.tolist()):
        for start in range(0, n - window + 1, window):
            pieces.append((i, start, window, seq, 0))
            seq += 1
        if n % window:
            by_length[n % window].append(i)
    loose: list[tuple[int, int, int]] = []
    for fill, times in patterns({k: len(v) for k, v in by_length.items()}, window):
        full = sum(k * v for k, v in fill.items()) == window
        for _ in range(times):
            at = 0
            for length in sorted(fill, reverse=True):
                for _ in range(fill[length]):
                    i = by_length[length].pop()
                    start = int(sizes[i]) - length
                    if full:
                        pieces.append((i, start, length, seq, at))
                        at += length
                    else:
                        loose.append((i, start, length))
            seq += full
    left = sum(x[2] for x in loose)
    rooms = [window] * (left // window) + [1 << b for b in range(window.bit_length(), -1, -1) if left % window >> b & 1]
    k = at = 0
    for i, start, length in loose:
        while length:
            take = min(length, rooms[k] - at)
            pieces.append((i, start, take, seq + k, at))
            start, length, at = start + take, length - take, at + take
            if at == rooms[k]:
                k, at = k + 1, 0
    out = np.array(pieces, np.int64).reshape(-1, 5)
    return tuple(out.T)  # type: ignore[return-value]


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; with `ids` also the ids
    themselves (little-endian unsigned 32-bit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 36, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal used
            names = pa.concat_arrays([x[0] for x in held])
            flat, sizes = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            text, start, length, seq, at = pack(sizes, window)
            raw, begin = memoryview(flat.astype("<u4").tobytes()), (np.cumsum(sizes) - sizes)[text] + start
            cut = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
            cols = [names.take(pa.array(text)), start, length, np.fromiter(map(zlib.crc32, cut), np.int64, len(cut)), sizes[text], base + used + seq, at]
            used += int(seq.max(initial=-1)) + 1
            arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in cols] + ([pa.array(map(bytes, cut), pa.binary())] if ids else [])
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids])

        size = 0
        for part in slices(batches):
            flat, counts = with_end(*encoder(tokenizer).encode(part.column("text")), end)
            held.append((part.column("doc_id"), flat, counts))
            size += len(flat)
            if size >= BUFFER:
                yield flush()
                size = 0
        if held:
            yield flush()

    return map_batches(plain(docs, doc_id=kind, text="string"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids)
