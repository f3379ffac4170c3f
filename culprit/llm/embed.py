"""Embedding near-duplicates: a small-world graph per shard, every shard queried.

Equal vectors form a class first.  Classes are dealt to shards of bounded size;
a task builds its shard's graph and streams classes through it as queries.  Two
shards meet once: the classes of one are asked in the graph of the other, and
what is found counts for both ends.  Some queries of each block are audited
against the whole shard by brute force, and the beam widens until the audit finds
its links; a beam that is full of links is widened until it is not, so clusters
of any size are found whole.  Similarities are verified in double precision.
Links inside a task are joined by union-find to a spanning forest, so what leaves
it is linear in its rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from culprit.llm.common import freeing, materialize
from culprit.llm.components import connected_components
from culprit.llm.hnsw import Hnsw

#: Vectors in a shard, about; the number of shards follows the table.
SHARD = 16_384
#: Shards at least, so that small tables use several tasks.
LEAST_SHARDS = 6
#: Widest beam; beyond it a block of queries is compared with the whole shard.
WIDEST = 256
#: Share of the audited queries' links that a beam must find.
RECALL = 0.995


#: Queries that are asked together, and of how many one is audited.
BLOCK, AUDITED = 512, 32


def _audit_rows(n: int) -> np.ndarray:
    return np.arange(0, n, AUDITED)


def search_links(index: Hnsw, exact: np.ndarray, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links ``(query row, index row)`` with cosine at least ``least``, and the beam for the next block.

    Beams that are full of links widen, and so do all beams of the block until
    the audit passes.  What a beam of ``WIDEST`` can't settle - queries with more
    links than that, or a block whose links the graph doesn't reach - is compared
    with the whole shard.
    """
    q32, n, widest = q.astype(np.float32), len(exact), min(WIDEST, len(exact) - 1)
    near = least - 1e-5

    def compared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.nonzero(q32[rows] @ index.x.T >= near)
        return rows[a], b

    def links(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        while len(rows) and width <= widest:
            ids, sims = index.search(q32[rows], width)
            hit = (sims >= near) & (ids >= 0)
            full = hit.all(axis=1)
            r, c = np.nonzero(hit & ~full[:, None])
            found.append((rows[r], ids[r, c]))
            rows, width = rows[full], 4 * width
        if len(rows):
            found.append(compared(rows))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.einsum("ij,ij->i", q[a], exact[b]) >= least
        return a[keep], b[keep]

    audit, every, beam = _audit_rows(len(q)), np.arange(len(q)), ef
    want = verified(*compared(audit))
    while beam <= widest:
        a, b = verified(*links(every, beam))
        if len(np.intersect1d(a * n + b, want[0] * n + want[1])) >= RECALL * len(want[0]):
            return a, b, beam
        beam *= 2
    return *verified(*compared(every)), ef


class Forest:
    """Union-find over a task's classes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class Shard:
    """The classes of one shard with vectors of one length: graph, found links between them, link counts."""

    def __init__(self, number: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.number, self.copies, self.exact = number, copies, vectors
        self.graph = Hnsw(vectors)
        self.count = np.zeros(len(number), np.int64)
        self.group = number.copy()
        self.inner = np.zeros((len(number), (len(number) + 7) // 8), np.uint8)  # a bit a pair, as either end may find it

    def found(self, number: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, own: bool) -> np.ndarray:
        """Take links of a block; the counts of its queries if they are of another shard."""
        if own:
            bits = np.zeros((len(number), len(self.number)), bool)
            bits[a, b] = True
            self.inner[np.searchsorted(self.number, number)] = np.packbits(bits, axis=1)
            return np.zeros(len(number), np.int64)
        self.count += np.bincount(b, weights=copies[a], minlength=len(self.count)).astype(np.int64)
        return np.bincount(a, weights=self.copies[b], minlength=len(number)).astype(np.int64)

    def joins(self, number: np.ndarray, a: np.ndarray, b: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
        """Links of a block that join two groups."""
        pairs = np.unique(np.stack([number[a], self.group[b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        tree = [(x, y) for x, y in pairs.tolist() if forest.join(x, y)]
        if tree:
            old, at = np.unique(self.group, return_inverse=True)
            self.group = np.array([forest.root(x) for x in old.tolist()])[at]
        return tree

    def counts(self) -> np.ndarray:
        """Link counts of the shard's classes once all queries have been asked: a link inside counts if either end found it."""
        n, out = len(self.number), self.count.copy()
        for k in range(0, n, BLOCK):
            rows = np.unpackbits(self.inner[k : k + BLOCK], axis=1, count=n)
            columns = np.unpackbits(self.inner[:, k // 8 : (k + BLOCK) // 8], axis=1)[:, : len(rows)]
            both = rows | columns.T
            both[np.arange(len(rows)), np.arange(k, k + len(rows))] = 0
            out[k : k + BLOCK] += both @ self.copies
        return out


def unit(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(
    vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, least_shards: int = LEAST_SHARDS, ef: int = 32
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and so do rows with a null id.  Only vectors of the same
    length are compared.  Rows with equal vectors are linked with each other and
    with all that either links with; rows that share an id but not a vector are
    told apart by their vectors, and each gets its own counts.  An empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # what is stored in single precision is sent so, and is the same number in double precision
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind).alias("v"))
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.struct(F.xxhash64("v"), F.hash("v"), F.size("v"))))
    classes = rows.where("ok").groupBy("key").agg(F.min("vec_id").alias("c"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "embed-class")
    shards = max(least_shards, math.ceil(classes.count() / shard))
    own = F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int")
    half = shards // 2  # shard i asks in i and in the half of the others that follow it; of opposite shards the lower one asks
    last = F.lit(half) if shards % 2 else F.when(own < half, half).otherwise(half - 1)
    asked = classes.select(F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.pmod(own + k, F.lit(shards)))).alias("shard"), own.alias("from"), "no", "copies", "v")
    asked = asked.select("shard", F.when(F.col("shard") == F.col("from"), 1).otherwise(2).alias("kind"), "no", "copies", "v")
    dealt = classes.select(own.alias("shard"), F.lit(0).alias("kind"), "no", "copies", "v").union(asked)
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", F.size("v"), "no")

    def run(batches):
        held: dict[int, list] = {}
        index: dict[int, Shard] = {}
        forest, beam = Forest(), ef

        def made(no: list, links: list, other: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (no, links, other)], names=["no", "links", "other"])

        for batch in batches:
            todo: dict[tuple[int, int], list] = {}
            for kind, no, copies, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind:
                    todo.setdefault((len(x), kind), []).append((no, copies, x))
                else:
                    held.setdefault(len(x), []).append((no, copies, x))
            for (d, kind), asked in todo.items():
                if d in held:
                    no, copies, x = zip(*held.pop(d), strict=True)
                    index[d] = Shard(np.array(no), np.array(copies), unit(x))
                if (here := index.get(d)) is None:
                    continue
                for k in range(0, len(asked), BLOCK):
                    no, copies, x = zip(*asked[k : k + BLOCK], strict=True)
                    no, copies = np.array(no), np.array(copies)
                    a, b, beam = search_links(here.graph, here.exact, unit(x), least, beam)
                    other = no[a] != here.number[b]
                    a, b = a[other], b[other]
                    count, tree = here.found(no, copies, a, b, kind == 1), here.joins(no, a, b, forest)
                    some = np.flatnonzero(count)
                    if len(some) or tree:
                        yield made(no[some].tolist() + [t[0] for t in tree], count[some].tolist() + [0] * len(tree), [None] * len(some) + [t[1] for t in tree])
        for here in index.values():
            count = here.counts()
            some = np.flatnonzero(count)
            yield made(here.number[some].tolist(), count[some].tolist(), [None] * len(some))

    found = materialize(dealt.select("kind", "no", "copies", "v").mapInArrow(freeing(run), "no long, links long, other long"), "embed-links")
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("no").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "c", "copies", "no").join(links, "no", "left").join(parts, F.col("no") == F.col("node"), "left")
    named = named.select("key", "c", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "no").alias("root"))
    least_id = named.groupBy("root").agg(F.min("c").alias("component_id"))
    joined = rows.select("vec_id", "key").join(named.join(least_id, "root"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
