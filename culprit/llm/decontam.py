"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of ``width`` consecutive benchmark words, written with
one space before, between and after the words; documents are written alike, so
an occurrence of the pattern is an occurrence of the word window.  A table of
block shifts says how far the search may jump: the distance of the block under
the cursor from the end of the patterns' common prefix length, or the whole
length for unknown blocks.  At shift 0, a bucket by the block and the pattern's
first bytes selects candidate strings, and a direct comparison confirms them.

Patterns are searched in groups of similar length, so that a short benchmark
item doesn't shorten the jumps for long windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from culprit.llm.common import freeing, materialize

#: Bytes of windows that one pass ships to the executors.
PATTERN_BYTES = 8 << 20

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z went to lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Search for patterns of at least ``m`` bytes: shift table, buckets, comparison."""

    def __init__(self, patterns: list[bytes], block: int = 8):
        self.m = min(map(len, patterns))
        self.block = b = min(block, self.m)
        self.far = self.m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[bytes]]] = {}
        for p in patterns:
            for end in range(b, self.m + 1):
                key, by = p[end - b : end], self.m - end
                if self.shift.get(key, self.far) > by:
                    self.shift[key] = by
            self.bucket.setdefault(p[self.m - b : self.m], {}).setdefault(p[: min(b, 4)], []).append(p)

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """All occurrences as ``(start, pattern)``."""
        m, b, far, shift, found = self.m, self.block, self.far, self.shift.get, []
        at, n, head = m, len(text), min(self.block, 4)
        while at <= n:
            by = shift(text[at - b : at], far)
            if by:
                at += by
                continue
            start = at - m
            for p in self.bucket[text[at - b : at]].get(text[start : start + head], ()):
                if text.startswith(p, start):
                    found.append((start, p))
            at += 1
        return found


def searchers(patterns: list[bytes]) -> list[WuManber]:
    """One search per class of pattern lengths (powers of two)."""
    classes: dict[int, list[bytes]] = defaultdict(list)
    for p in patterns:
        classes[min(len(p).bit_length(), 6)].append(p)
    return [WuManber(ps, 10 if k >= 6 else 4) for k, ps in sorted(classes.items())]


def window_groups(items: Iterable[tuple[str | None, str]], width: int, limit: int) -> Iterator[dict[bytes, set[str]]]:
    """Windows with their items, in groups of about ``limit`` bytes of windows; a long item may be in several groups."""
    found: dict[bytes, set[str]] = defaultdict(set)
    size = 0
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            pattern = b" " + b" ".join(w[k : k + width]) + b" "
            found[pattern].update(() if item is None else (item,))
            size += len(pattern)
            if size >= limit:
                yield dict(found)
                found, size = defaultdict(set), 0
    if found:
        yield dict(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans ``[first, end)`` in order that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def occurrences(words: list[bytes], search: list[WuManber], table: dict[bytes, set[str]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words inside occurrences of the table's windows, and the items that have those."""
    line = b" " + b" ".join(words) + b" "
    found: dict[int, int] = {}
    items: set[str] = set()
    for s in search:
        for start, p in s.find(line):
            found[start] = max(found.get(start, 0), p.count(b" ") - 1)
            items |= table[p]
    if not found:
        return [], items
    place = {at: k for k, at in enumerate(accumulate((len(w) + 1 for w in words), initial=0)) if at in found}
    return merged([(place[at], place[at] + n) for at, n in found.items()]), items


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    pattern_bytes: int = PATTERN_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: words, hit words, items with windows in it.

    The driver streams the benchmark and ships its windows in groups of
    ``pattern_bytes``, one group at a time, so what is broadcast has that bound
    whatever the benchmark.  A benchmark of one group takes one pass over the
    documents, which are then never shuffled.  Each further group reads them once
    more and writes what it finds, a row for a document with finds; those rows
    meet the documents by id and a digest of the text.  Null texts have no words;
    empty benchmark items have no window; windows of items with a null id count
    as hits, but not in ``n_items`` and ``items_sha256``; repeated items and rows
    are handled like others; a very long text takes memory in proportion to it;
    an empty benchmark leaves every document clean; an empty table gives an empty
    result.  ``keep`` names columns to carry along; others, whatever their names,
    are ignored.  Returns ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated`` and ``keep``.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    groups = window_groups(((r[0], r[1]) for r in rows.toLocalIterator()), width, pattern_bytes)
    carried = [T.StructField(f"keep_{i}", docs.schema[k].dataType) for i, k in enumerate(keep)]
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(docs[k].alias(f.name) for k, f in zip(keep, carried, strict=True)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *_RESULT, *carried])
    group, found = next(groups, {}), []
    if (later := next(groups, None)) is None:
        result = texts.mapInArrow(freeing(_one_pass(spark.sparkContext.broadcast(group))), schema)
        return result.toDF(*schema.names[:6], *keep)
    while group:
        shipped = spark.sparkContext.broadcast(group)
        found.append(materialize(texts.select("doc_id", "text").mapInArrow(freeing(_finds(shipped)), "doc_id long, mark binary, spans array<long>, items array<string>"), "decontam-finds"))
        shipped.destroy()
        group, later = later, next(groups, None)
    every = reduce(DataFrame.union, found).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    # repeated rows have the same finds, which merge to the same spans
    every = every.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = texts.mapInArrow(freeing(_counts), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("mark", T.BinaryType()), *carried]))
    joined = counted.join(every, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    joined = joined.select("doc_id", "n_words", "spans", "items", *(f.name for f in carried))
    return joined.mapInArrow(freeing(_merged), schema).toDF(*schema.names[:6], *keep)


_RESULT = [*(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]


def _mark(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _finished(first: pa.Array, rows: list[tuple[int, list[tuple[int, int]], set[str]]], rest: list[pa.Array]) -> pa.RecordBatch:
    """Results of ``(words, disjoint spans, items)`` rows."""
    hits = [sum(z - a for a, z in spans) for _, spans, _ in rows]
    made = [
        pa.array([n for n, _, _ in rows], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for _, _, i in rows], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in rows], pa.string()),
        pa.array([hit > 0 and 20 * hit >= n for (n, _, _), hit in zip(rows, hits, strict=True)], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays([first, *made, *rest], names=["doc_id", *(f.name for f in _RESULT), *(f"keep_{i}" for i in range(len(rest)))])


_KEPT: dict[str, tuple[dict, list[WuManber]]] = {}


def _tables(shipped: Broadcast, name: str) -> tuple[dict, list[WuManber]]:
    """Search tables of a broadcast group; a worker keeps those of the last group for its next tasks."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = shipped.value, searchers(list(shipped.value))
    return _KEPT[name]


def _searched(shipped: Broadcast, name: str, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    table, search = _tables(shipped, name)
    for text in texts.to_pylist():
        words = words_of(text) if text else []
        yield (len(words), *(occurrences(words, search, table) if words and table else ([], set())))


def _one_pass(shipped: Broadcast):
    name = uuid.uuid4().hex

    def run(batches):
        for b in batches:
            yield _finished(b.column(0), list(_searched(shipped, name, b.column(1))), b.columns[2:])

    return run


def _finds(shipped: Broadcast):
    name = uuid.uuid4().hex

    def run(batches):
        for b in batches:
            found = [(k, [x for s in spans for x in s], sorted(items)) for k, (_, spans, items) in enumerate(_searched(shipped, name, b.column(1))) if spans]
            at = pa.array([f[0] for f in found], pa.int64())
            marks = [_mark(t) for t in b.column(1).take(at).to_pylist()]
            made = [pa.array(marks, pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *made], names=["doc_id", "mark", "spans", "items"])

    return run


def _counts(batches):
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        made = [pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array(list(map(_mark, texts)), pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[2:]], names=["doc_id", "n_words", "mark", *(f"keep_{i}" for i in range(b.num_columns - 2))])


def _merged(batches):
    for b in batches:
        n, spans, items = (b.column(k).to_pylist() for k in (1, 2, 3))
        rows = [(k, merged(list(zip(s[::2], s[1::2], strict=True))) if s else [], set(i or ())) for k, s, i in zip(n, spans, items, strict=True)]
        yield _finished(b.column(0), rows, b.columns[4:])
