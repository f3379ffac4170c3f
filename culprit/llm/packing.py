"""Sequence packing: best-fit decreasing over a capacity segment tree.

Documents become token ids and a closing id 0.  An overlong document is first
cut into full windows, each a sequence of its own.  The rest of each document,
shorter than a window, goes to the open sequence whose remaining capacity is
the tightest that still holds it; a segment tree indexed by remaining capacity
finds it in ``log2(window)`` steps.  Every task packs the documents that it
reads, longest rest first, so nothing is shuffled, and a lost task packs the
same documents to the same sequences again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from culprit.llm.common import freeing
from culprit.llm.tokens import CHUNK_TABLE, ChunkTable, slices


class ChunkIds(ChunkTable):
    """Little-endian uint32 ids."""

    def encoded(self, chunks: list[str]) -> list[bytes]:
        out = []
        for ids, at in self.merged(chunks):
            raw, at = ids.tobytes(), (4 * at).tolist()
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def encoded_first(self, heads: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(heads, add_special_tokens=False)] if heads else []

    def joined(self, parts: list[bytes]) -> bytes:
        return b"".join(parts)

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of whole texts as the library gives them."""
        if not self.plain:
            yield from (np.frombuffer(self.whole(t), "<u4") for t in texts.to_pylist())
            return
        starts, which, values, odd = self.split(texts)
        if not len(starts):
            return
        values = [v or b"" for v in values]
        size = np.array(list(map(len, values)), np.int64) // 4
        flat, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
        length = size[which]
        ends = np.cumsum(length)
        total = int(ends[-1])
        at = np.repeat(first[which] - (ends - length), length)
        at += np.arange(total)
        ids = flat[at]
        cuts = np.append((ends - length)[starts], total).tolist()
        alone = set(odd.tolist())
        for k in range(len(starts)):
            yield np.frombuffer(self.alone(texts[k].as_py()), "<u4") if k in alone else ids[cuts[k] : cuts[k + 1]]


@lru_cache(maxsize=1)
def encoder(path: str, cap: int) -> ChunkIds:
    """A worker keeps its table for its next tasks; results don't depend on what is in it."""
    return ChunkIds(path, cap)


class CapacityTree:
    """Open sequences by remaining capacity; finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = capacity + self.size
        while i:
            self.any[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(capacity, sequence)`` of the least capacity >= need."""
        i = need + self.size
        if not self.any[i]:
            while True:
                if i == 1:
                    return None
                if not i & 1 and self.any[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.size
        sequence = self.open[capacity].pop()
        while i:
            self.any[i] -= 1
            i >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: np.ndarray, window: int, first_sequence: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each item, and the next free sequence number."""
    tree, sequence, offset, free = CapacityTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), first_sequence
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        if (found := tree.take(need)) is None:
            capacity, s = window, free
            free += 1
        else:
            capacity, s = found
        sequence[k], offset[k] = s, window - capacity
        if capacity > need:
            tree.add(capacity - need, s)
    return sequence, offset, free


def fill_gaps(sequences: list[list[tuple[int, int, int]]], window: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Dissolve the emptiest sequences into the gaps of the fullest.

    A sequence is a list of ``(item, start, length)``.  Items of dissolved
    sequences are cut to the gaps of at least ``least`` ids that best fit left;
    a sequence is dissolved only if all of it finds room.
    """
    used = [sum(p[2] for p in s) for s in sequences]
    order = sorted(range(len(sequences)), key=lambda s: (-used[s], s))
    gaps = [window - used[s] if window - used[s] >= least else 0 for s in order]
    room, moved, keep = sum(gaps), 0, len(order)
    while keep > 1 and moved + used[order[keep - 1]] <= room - gaps[keep - 1]:
        keep -= 1
        moved += used[order[keep]]
        room -= gaps[keep]
    at = keep - 1  # receivers with the largest gaps first: fewest cuts
    for s in order[keep:]:
        for item, start, length in sequences[s]:
            while length:
                while not gaps[at]:
                    at -= 1
                part = min(length, gaps[at])
                sequences[order[at]].append((item, start, part))
                gaps[at] -= part
                start, length = start + part, length - part
    return [sequences[s] for s in order[:keep]]


def powers_of_two(sequence: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """A sequence of ``size`` ids as sequences whose sizes are powers of two, the largest first."""
    out: list[list[tuple[int, int, int]]] = []
    rest = list(reversed(sequence))
    while size:
        room = 1 << (size.bit_length() - 1)
        size -= room
        out.append([])
        while room:
            item, start, length = rest.pop()
            part = min(length, room)
            out[-1].append((item, start, part))
            room -= part
            if part < length:
                rest.append((item, start + part, length - part))
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = 1024,
    end_id: int = 0,
    least_gap: int = 16,
    table_size: int = CHUNK_TABLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document into sequences of at most ``window`` ids.

    After best-fit decreasing, the emptiest sequences are cut into the gaps of
    at least ``least_gap`` ids that the others have left; what is then still
    emptier than that is cut to sequences of a power of two, which need no padding.

    A null text counts as empty and still gives its closing id.  Rows with a
    null or repeated id are packed like any other; an empty table gives no
    piece.  Returns one row per piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``; sequence ids are the task's number in
    the upper 32 bits and a counter in the lower.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = pa.schema([(n, pa.int64()) for n in names])
    tail = np.array([end_id], "<u4").tobytes()

    def emit(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out)

    def encoded(table: ChunkIds, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for at, texts in slices(batch.column(1)):
            yield from zip(batch.column(0).slice(at, len(texts)).to_pylist(), table.ids(texts), strict=True)

    def run(batches):
        table, base = encoder(tokenizer_path, table_size), TaskContext.get().partitionId() << 32
        free, rests = 0, []
        for batch in batches:
            full: list[tuple] = []
            for doc, ids in encoded(table, batch):
                ids = ids.tobytes() + tail
                n = len(ids) // 4
                for start in range(0, n - window + 1, window):
                    full.append((doc, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), n, base + free, 0))
                    free += 1
                if left := n % window:
                    rests.append((doc, n - left, n, ids[4 * (n - left) :]))
            if full:
                yield emit(list(zip(*full, strict=True)))
        if rests:
            lengths = np.array([len(r[3]) // 4 for r in rests])
            sequence, _, end = best_fit_decreasing(lengths, window, 0)
            content: list[list[tuple[int, int, int]]] = [[] for _ in range(end)]
            for k, s in enumerate(sequence.tolist()):
                content[s].append((k, 0, int(lengths[k])))
            pieces = []
            packed: list[list[tuple[int, int, int]]] = []
            for parts in fill_gaps(content, window, least_gap):
                size = sum(p[2] for p in parts)
                packed += [parts] if window - size < least_gap else powers_of_two(parts, size)
            for s, parts in enumerate(packed):
                offset = 0
                for k, start, length in parts:
                    doc, first, n, ids = rests[k]
                    pieces.append((doc, first + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, base + free + s, offset))
                    offset += length
            for k in range(0, len(pieces), 10_000):
                yield emit(list(zip(*pieces[k : k + 10_000], strict=True)))

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(freeing(run), ", ".join(f"{n} long" for n in names))
