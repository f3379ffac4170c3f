"""Exact removal of repeated substrings by bucket-pointer refinement.

A byte position is in a *bucket* with all positions whose next ``q`` bytes are
equal.  Sorting every position of the corpus would be far too much, so positions
get *identifiers* first, which shards agree on without a global sort: that of
``2q`` bytes comes from those at offsets 0 and ``q``, and so on (8, 16, 32 bytes,
then the whole window from 0, 32, 64 and window - 32).  They deal the corpus into
groups that may hold equal windows, and the suffixes of a group are sorted by
bucket-pointer refinement (:func:`bucket_pointers`), which compares bytes:

1. A window's *key* is the least 32-byte pointer inside it; equal windows have
   equal keys.  Consecutive windows with one key form a *run*.  Keys that one
   run alone has are final: those windows are unique.
2. The other runs are refined by the pointer of their whole content.  A run
   whose content occurs in an earlier document is repeated as a whole.
3. Where different contents share a key, the first run of each content is
   refined to single windows.  Buckets of up to ``GROUP`` contents are dealt by
   key, and refined where they meet.  Larger ones can't meet in one task: their
   windows are grouped by key and identifier (128 bits), and each document gets
   the repeated windows of the longer (64-byte) keys that it has, so what is sent
   back is a row per document and key.

The other steps are grouped minima, which Spark aggregates before the shuffle,
and joins that it may split, so no large bucket meets in one task.  Repeats
inside a document are found in the document itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from culprit.llm.common import discard, freeing, materialize, sieved

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S1, _S2 = np.uint64(29), np.uint64(32)
_Q = 32
#: Contents of one key that may be compared in one task; larger buckets go by single windows.
GROUP = 100
#: Repeated windows in one row that goes back to the documents of a key.
LIST = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble in place."""
    x ^= x >> _S1
    x *= _B
    x ^= x >> _S2
    x *= _C
    x ^= x >> _S1
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x += b
    return _mix(x)


def pointers(raw: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointers of all 32-byte strings and of all windows of ``raw``, which holds a window at least."""
    words = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,)).astype(np.uint64)
    p8 = _mix(words + _A)
    p16 = _pair(p8[:-8], p8[8:])
    p32 = _pair(p16[:-16], p16[16:])
    count = len(raw) - window + 1
    whole = p32[:count] * _A
    for at in (*range(_Q, window - _Q, _Q), window - _Q):
        whole += p32[at : at + count]
        whole *= _B
        whole ^= whole >> _S1
    return p32, _mix(whole)


def least_over(x: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of each ``reach`` consecutive values."""
    have = 1
    while have < reach:
        step = min(have, reach - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def runs_of(raw: bytes, window: int) -> tuple[np.ndarray, ...] | None:
    """Keys, first windows and content pointers of the runs; pointers of all windows and of all q-grams. None if too short."""
    if len(raw) < window:
        return None
    p32, whole = pointers(raw, window)
    count = len(whole)
    least = least_over(p32, window - _Q + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    length = np.diff(np.append(first, count))
    place = np.arange(count, dtype=np.uint64)
    place -= np.repeat(first.astype(np.uint64), length)
    content = np.add.reduceat(_mix(whole + place * _A), first)
    return least[first], first, content, whole, p32


def keys_met_again(least: np.ndarray, p32: np.ndarray, window: int) -> np.ndarray:
    """Keys that stand at more than one position: a position holds a key if no window over it has a greater least pointer."""
    reach = window - _Q + 1
    most = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    have = 1
    while have < reach:
        step = min(have, reach - have)
        most = np.maximum(most[:-step], most[step:])
        have += step
    values, times = np.unique(p32[most == p32], return_counts=True)
    return values[times > 1]


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_runs(docs: DataFrame, window: int, contents: bool) -> DataFrame:
    """One row per run: its key, and content pointer and document if asked for."""
    names = ["key", "content", "doc"] if contents else ["key"]

    def run(batches):
        for b in batches:
            keys, cont, own, size = [], [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and (r := runs_of(text.encode(), window)):
                    keys.append(r[0])
                    size += len(r[0])
                    if contents:
                        cont.append(r[2])
                        own.append(np.full(len(r[0]), doc))
                    if size > 200_000:
                        yield made(keys, cont, own)
                        keys, cont, own, size = [], [], [], 0
            if keys:
                yield made(keys, cont, own)

    def made(keys, cont, own):
        cols = [_i64(np.concatenate(keys))]
        if contents:
            cols += [_i64(np.concatenate(cont)), pa.array(np.concatenate(own))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(freeing(run), ", ".join(f"{c} long" for c in names))


_OPEN = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("whole", pa.int64()), ("bytes", pa.binary())])


def _batch(**cols: pa.Array) -> pa.RecordBatch:
    n = len(cols["key"])
    return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in _OPEN], schema=_OPEN)


def _met_windows(found: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Windows of some documents, aggregated to first and last document, and their keys by document."""
    key, whole = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    doc = np.repeat(np.array([f[2] for f in found], np.int64), [len(f[0]) for f in found])
    o = np.lexsort((doc, whole, key))
    k, w, d = key[o], whole[o], doc[o]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]))
    yield _batch(key=_i64(k[head]), doc=pa.array(d[head]), last=pa.array(d[np.append(head[1:], len(d)) - 1]), whole=_i64(w[head]))
    o = np.lexsort((key, doc))
    k, d = key[o], doc[o]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
    yield _batch(key=_i64(k[head]), doc=pa.array(d[head]))


def _emit_open(docs: DataFrame, window: int) -> DataFrame:
    """Runs with a content pointer in ``marks`` as bytes; of those in ``hot``, windows and documents under 64-byte keys."""

    def run(batches):
        rows: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def made():
            keys, own, content = zip(*rows, strict=True)
            rows.clear()
            return _batch(key=pa.array(keys, pa.int64()), doc=pa.array(own, pa.int64()), bytes=pa.array(content, pa.binary()))

        for b in batches:
            for doc, text, marks, hot in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = (text or "").encode()
                if (r := runs_of(raw, window)) is None:
                    continue
                keys, first, content, whole, p32 = r
                stop = np.append(first[1:], len(whole))
                for k in np.flatnonzero(np.isin(content.view(np.int64), marks.values.to_numpy())):
                    rows.append((int(keys[k].view(np.int64)), doc, raw[first[k] : stop[k] + window - 1]))
                if len(hot.values):
                    pick = np.repeat(np.isin(content.view(np.int64), hot.values.to_numpy()), stop - first)
                    longer = least_over(_pair(p32[:-_Q], p32[_Q:]), window - 2 * _Q + 1)
                    found.append((longer[pick], whole[pick], doc))
                    size += len(found[-1][0])
                if len(rows) > 5_000:
                    yield made()
                if size > 1_000_000:
                    yield from _met_windows(found)
                    found, size = [], 0
        if rows:
            yield made()
        if size:
            yield from _met_windows(found)

    return docs.mapInArrow(freeing(run), "key long, doc long, last long, whole long, bytes binary")


def bucket_pointers(raw: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Bucket-pointer refinement of the suffixes of ``raw`` to ``depth`` bytes.

    Suffixes are first sorted into buckets of 8 bytes; a suffix's pointer is the
    place of its bucket's last suffix in that order.  Buckets of more than one
    suffix are then sorted on the pointers at a later offset, which splits them,
    and the next round reuses the new pointers at twice the offset.  Suffixes
    with equal pointers have their first ``depth`` bytes in common, and no others
    have (but for those that end before).  If only ``wanted`` suffixes are asked
    for, each round sorts what the rounds after it look up, and the other
    pointers mean nothing.
    """
    n = len(raw)
    steps = []  # how far each round looks
    have = 8
    while have < depth:
        steps.append(min(have, depth - have))
        have += steps[-1]
    needed = [np.ones(n, bool)]
    if wanted is not None:
        needed[0][:] = False
        needed[0][wanted] = True
    for step in reversed(steps):
        more = needed[-1].copy()
        more[step:] |= needed[-1][: n - step]
        needed.append(more)
    place = np.flatnonzero(needed.pop())
    words = np.ndarray((n,), ">u8", buffer=raw + bytes(8), strides=(1,))[place].astype(np.uint64)
    order = np.argsort(words)
    words, order = words[order], place[order]
    last = np.flatnonzero(np.append(words[1:] != words[:-1], True))
    size = np.diff(last, prepend=-1)
    pointer = np.full(n + depth, -1, np.int64)
    pointer[order] = np.repeat(last, size)
    open_ = order[np.repeat(size > 1, size)]
    for step in steps:
        open_ = open_[needed.pop()[open_]]
        own, later = pointer[open_], pointer[open_ + step]
        o = np.argsort(own * (n + 1) + later)
        open_, own, later = open_[o], own[o], later[o]
        ends = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
        outer = np.flatnonzero(ends)
        inner = np.flatnonzero(ends | np.append(later[1:] != later[:-1], True)) if len(own) else outer
        size = np.diff(inner, prepend=-1)
        behind = np.repeat(outer, np.diff(outer, prepend=-1)) - np.repeat(inner, size)
        pointer[open_] = own - behind
        open_ = open_[np.repeat(size > 1, size)]
    return pointer[:n]


def later_windows(docs: list[int], contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, identifier)`` of windows of ``contents`` that a smaller document has too.

    Windows whose identifier occurs once are unique; the others are compared by
    their bytes, through their bucket pointers.
    """
    size = np.array(list(map(len, contents)))
    raw = b"".join(contents)
    start = np.cumsum(size) - size
    count = size - window + 1
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    names, place = np.unique(np.array(docs, np.int64), return_inverse=True)
    own = pointers(raw, window)[1][at]
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    order = order[np.append(same, False) | np.concatenate([[False], same])]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w, d = bucket_pointers(raw, window, at[order])[at[order]], np.repeat(place, count)[order]
    o = np.argsort(w * len(names) + d)
    w, d, order = w[o], d[o], order[o]
    head = np.concatenate([[True], w[1:] != w[:-1]])
    least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    new = d > least
    new[1:] &= (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    return names[d[new]], own[order[new]]


def _compare_met(opened: DataFrame, window: int) -> DataFrame:
    """Repeated windows of runs that were dealt and sorted by key."""

    def run(batches):
        keys: list[int] = []
        docs: list[int] = []
        contents: list[bytes] = []

        def made(n: int):
            d, w = later_windows(docs[:n], contents[:n], window)
            del keys[:n], docs[:n], contents[:n]
            return pa.RecordBatch.from_arrays([pa.array(d), _i64(w)], names=["doc", "mark"])

        for b in batches:
            keys += b.column(0).to_pylist()
            docs += b.column(1).to_pylist()
            contents += b.column(2).to_pylist()
            n = len(keys)
            while n and keys[n - 1] == keys[-1]:  # the last key may go on in the next batch
                n -= 1
            if n:
                yield made(n)
        if keys:
            yield made(len(keys))

    return opened.mapInArrow(freeing(run), "doc long, mark long")


def repeated_bytes(raw: bytes, window: int, marks: np.ndarray) -> np.ndarray | None:
    """Mask of the bytes in windows that are marked or repeat inside ``raw``; None if there are none."""
    r = runs_of(raw, window)
    if r is None:
        return None
    keys, first, content, whole, p32 = r
    count = len(whole)
    length = np.diff(np.append(first, count))
    again = np.zeros(count, bool)
    if len(marks):
        again |= np.repeat(np.isin(content.view(np.int64), marks), length)
        near = np.zeros(1 << 16, bool)  # most windows are told apart by 16 bits
        near[marks & 0xFFFF] = True
        at = np.flatnonzero(near[whole & np.uint64(0xFFFF)])
        again[at] |= np.isin(whole[at].view(np.int64), marks)
    twice = keys_met_again(np.repeat(keys, length), p32, window)
    if len(twice):
        suspects = np.isin(keys, twice)
        at = np.flatnonzero(np.repeat(suspects, length))
        _, once = np.unique(whole[at], return_index=True)
        later = np.ones(len(at), bool)
        later[once] = False
        again[at[later]] = True
    if not again.any():
        return None
    step = np.zeros(len(raw) + 1, np.int32)
    step[:count] += again
    step[window : window + count] -= again
    return np.cumsum(step)[:-1] > 0


def find_repeats(docs: DataFrame, window: int) -> DataFrame:
    """``doc, marks``: pointers of each document's windows and run contents that an earlier document has."""
    texts = docs.where(F.octet_length("text") >= window)
    # counts are written before they are joined: Spark splits a key with very many rows only if no aggregate stands between
    shared = materialize(_emit_runs(texts, window, False).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "suffix-shared")
    runs = materialize(_emit_runs(texts, window, True).join(shared, "key"), "suffix-runs")
    contents = materialize(runs.groupBy("key", "content").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "suffix-contents")
    whole = runs.join(contents.where("last > first").select("key", "content", "first"), ["key", "content"]).where("doc > first").select("doc", F.col("content").alias("mark"))
    mixed = materialize(contents.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "suffix-mixed")
    open_ = contents.join(mixed, "key").select(F.col("first").alias("doc"), "content", (F.col("n") > GROUP).alias("hot"))
    lists = open_.groupBy("doc").agg(F.collect_set(F.when(~F.col("hot"), F.col("content"))).alias("marks"), F.collect_set(F.when(F.col("hot"), F.col("content"))).alias("hot"))
    lists = materialize(lists, "suffix-lists")
    asked = sieved(texts, lists, "doc").where("_met").join(lists, "doc").select("doc", "text", "marks", "hot")
    opened = materialize(_emit_open(asked, window), "suffix-open")
    met = opened.where("bytes is not null").select("key", "doc", "bytes").repartition("key").sortWithinPartitions("key")
    windows = opened.where("whole is not null").groupBy("key", "whole")
    again = windows.agg(F.min("doc").alias("first"), F.max("last").alias("last")).where("last > first").select("key", "whole", "first")
    again = materialize(again, "suffix-again")
    sizes = materialize(again.groupBy("key").agg(F.ceil(F.count("*") / LIST).alias("n")), "suffix-sizes")
    chunks = again.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("whole"), F.col("n")))
    chunks = chunks.groupBy("key", "chunk").agg(F.collect_list(F.struct("whole", "first")).alias("met"))
    # a window that starts in an earlier document may be marked whether or not this one has it
    earlier = F.transform(F.filter("met", lambda w: w["first"] < F.col("doc")), lambda w: w["whole"])
    large = opened.where("whole is null and bytes is null").select("key", "doc").distinct().join(chunks, "key").select("doc", earlier.alias("marks"))
    small = whole.union(_compare_met(met, window)).groupBy("doc").agg(F.collect_set("mark").alias("marks"))
    marks = small.union(large.groupBy("doc").agg(F.flatten(F.collect_list("marks")))).groupBy("doc").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    marks = materialize(marks, "suffix-marks")
    discard(shared, runs, contents, mixed, lists, opened, again, sizes)
    return marks


def deduplicate(docs: DataFrame, *, window: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Remove every byte in a ``window``-byte string that also starts earlier.

    Earlier is a smaller id, or an earlier start in the same row; rows that
    share an id are not earlier than each other, and a null id comes first.
    Null texts are empty.  Texts shorter than the window stay as they are.
    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, the kept text
    if asked for (bytes that no longer form a character are left out of it),
    and the columns in ``keep``.
    """
    first_id = -(1 << 63)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(first_id)).alias("doc")
    rows = docs.select(doc, F.col(text_col).alias("text"))
    marks = find_repeats(rows, window)
    full = docs.select(doc, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)))
    columns = ["doc_id", "text", "marks", *(f"keep_{i}" for i in range(len(keep)))]
    full = sieved(full, marks, "doc")  # texts without marks stay where they are
    joined = full.where("not _met").withColumn("marks", F.lit(None).cast("array<long>")).select(columns)
    joined = joined.union(full.where("_met").join(marks, "doc", "left").select(columns))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []), *keep]
    fields = [T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in names[1:4]), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] if with_text else []
    schema = T.StructType([*fields, *(docs.schema[k] for k in keep)])
    none = np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            out = []
            for text, m in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                raw = (text or "").encode()
                mask = repeated_bytes(raw, window, m.values.to_numpy() if m.is_valid else none)
                if mask is None:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text or ""))
                    continue
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                out.append((len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else ""))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            made = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made[: 5 if with_text else 4], *b.columns[3:]], names=names)

    return joined.mapInArrow(freeing(run), schema)
